import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventmill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x x x x x x x", "l\nl\n l\n\nl\n", "é😀 \x85 b\x0bc\xa0d",
    "# * $ %% && || << >>", "a b c d e f g h " * 40, "v w x y z 1 v w x y z 2 w x y z 1 v", "\n".join(["same line here"] * 5),
    " ".join(str(i) for i in range(5000)), " ".join(str(i % 900) for i in range(3000)),
]


def test_counts_are_those_of_plain_python(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, stats int")
    rows = quality.measured(docs.select("doc_id", "text")).select("doc_id", "stats.*").collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == counted(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_counts_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.measured(docs.select("doc_id", "text")).select("doc_id", "stats.*").collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == counted(texts[r.doc_id])


@pytest.mark.parametrize("p", [0.01, 0.2, 0.5])
def test_binomial_bound_is_exact(spark, p):
    cases = [(k, n) for n in (1, 7, 40, 300, 1000) for k in range(0, n + 1, max(1, n // 9))]
    rows = spark.createDataFrame(cases, "k long, n long")
    for r in rows.withColumn("p", quality.binomial_at_most(F.col("k"), F.col("n"), p)).collect():
        exact = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
        if r.k < r.n * p:
            assert r.p == pytest.approx(exact, rel=1e-9)
        else:
            assert r.p == 1.0


def corpus(spark, prose, n=1500):
    rows = [(i, prose(i, 40), "en") for i in range(n)]
    rows += [(10_000 + i, " ".join(w + "***" for w in prose(i, 40).split()), "en") for i in range(60)]
    rows += [(20_000 + i, prose(7_000 + i, 40).upper(), "fr") for i in range(30)]
    labels = [(i, 1) for i in range(n)] + [(10_000 + i, 0) for i in range(30)] + [(None, 1), (3, None)]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, lang string, n_words int, kept string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_certified_cutoffs_reject_junk_and_keep_good_documents(spark, prose):
    docs, labels = corpus(spark, prose)
    found = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(found) == docs.count()
    good = [found[i] for i in range(1500)]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)
    assert all(not found[10_000 + i].kept and "symbols" in found[10_000 + i].rules for i in range(60))
    # A stratum without labels has no certified cutoff.
    assert all(found[20_000 + i].kept for i in range(30))


def test_too_few_labels_certify_nothing(spark, prose):
    docs, labels = corpus(spark, prose)
    few = labels.filter("doc_id < 100")
    assert all(r.kept == (not r.base_failed) for r in quality.judge(docs, few).collect())


def test_good_documents_keep_their_columns(spark, prose):
    docs, labels = corpus(spark, prose)
    left = quality.good_documents(docs, labels)
    assert left.columns == docs.columns
    judged = {r.doc_id for r in quality.judge(docs, labels).filter("kept").collect()}
    assert {r.doc_id for r in left.collect()} == judged


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", None), (1, "", None), (2, "a " * 30, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == 4 and all(r.base_failed and not r.kept for r in got)
    assert quality.judge(docs.limit(0), labels).collect() == []


def test_a_document_is_one_draw(spark):
    """Labels and rows that come again change no cutoff; of conflicting labels the bad one holds."""
    rows = [(i, "en", 50, 0, i % 7) for i in range(400)]
    counts = spark.createDataFrame(
        [(i, s, n, r, k, 40 * n, 0, 0, 20, 0, 10, 200) for i, s, n, r, k in rows],
        "doc_id long, stratum string, n_words long, n_repeat_words long, n_symbols long, word_chars long, n_dup_lines long,"
        " unused int, n_lines long, n_marks long, n_capitals long, n_letters long",
    )
    marks = [(i, int(i % 7 < 6)) for i in range(400)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    conflict = spark.createDataFrame([(i, 1) for i, good in marks if not good] + [(9, None)], "doc_id long, quality int")

    def cuts(c, own):
        return [r.asDict() for r in quality._cutoffs_by_stratum(c, own, 0.2, 0.2).collect()]

    once = cuts(counts, labels)
    assert once and once == cuts(counts.union(counts), labels.union(labels).union(conflict))


def small_strata(spark):
    """Three languages of 200 to 260 good and 40 bad labels, and one of 20; symbols tell bad from good."""
    rows, labels = [], []
    for at, (lang, n) in enumerate([("de", 200), ("fr", 230), (None, 260), ("xx", 20)]):
        for i in range(n + 40):
            bad, doc_id = i >= n, 1000 * at + i
            rows.append((doc_id, lang, 100, 0, 60 if bad else i % 9, 400, 0, i % 5, i % 30 if bad else 0, 3 * (i % 4), 10, 400))
            labels.append((doc_id, int(not bad)))
    counts = spark.createDataFrame(
        rows,
        "doc_id long, stratum string, n_words long, n_repeat_words long, n_symbols long, word_chars long, n_dup_lines long,"
        " unused int, n_marks long, n_capitals long, n_lines long, n_letters long",
    )
    return counts, spark.createDataFrame(labels, "doc_id long, quality int")


def tail(k, n, p):
    return 1.0 if k >= n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def brute_cutoffs(rows, max_false, error):
    """The rule of `quality.cutoffs` on (stratum, good, {rule: score}) rows."""
    rules, strata = list(quality.RULES), sorted({s for s, _, _ in rows}, key=str)
    cut = {g: (quality.GRID - g) / quality.GRID for g in range(1, quality.GRID)}
    level = error / 2 / len({s for s, good, _ in rows if good})

    def worth(part, test):
        good = [test(x) for _, g, x in part if g]
        bad = [test(x) for _, g, x in part if not g]
        return (sum(bad) / len(bad) - quality.PRICE * (sum(good) / len(good)), sum(good), len(good)) if good and bad else (-1, 0, 0)

    out = {}
    for s in strata:
        mine, others = [r for r in rows if r[0] == s], [r for r in rows if r[0] != s]
        own, lent = {}, []
        for rule in rules:
            best = 0
            for g in cut:
                w, k, n = worth(mine, lambda x: x[rule] > cut[g] + 1e-9)
                if tail(k, n, max_false / len(rules)) > level / len(rules):
                    break
                if w > best:
                    best, own[rule] = w, cut[g]
            tries = [(worth(others, lambda x: x[rule] > cut[g] + 1e-9)[0], -g) for g in cut]
            w, g = max(tries)
            if w > 0:
                lent.append((-w, rule, cut[-g]))
        best, taken = 0, {}
        for j in range(1, len(lent) + 1):
            some = {rule: c for _, rule, c in sorted(lent)[:j]}
            w, k, n = worth(mine, lambda x: any(x[r] > c + 1e-9 for r, c in some.items()))
            if tail(k, n, max_false) > level:
                break
            if w > best:
                best, taken = w, some
        if own or taken:
            out[s] = own or taken
    return out


@pytest.mark.parametrize("max_false, error", [(0.05, 0.05), (0.2, 0.2), (0.5, 0.2), (0.02, 0.05)])
def test_small_strata_certify_what_the_others_propose(spark, max_false, error):
    counts, labels = small_strata(spark)
    good = {r.doc_id: r.quality == 1 for r in labels.collect()}
    scored = quality._scored(counts).collect()
    rows = [(r.stratum, good[r.doc_id], {rule: r[rule] for rule in quality.RULES}) for r in scored]
    found = {r._stratum: r._cutoffs for r in quality._cutoffs_by_stratum(counts, labels, max_false, error).collect()}
    assert found == brute_cutoffs(rows, max_false, error)
    if (max_false, error) == (0.05, 0.05):
        # 200 good labels are too few for single rules, and 20 for anything.
        assert set(found) == {"de", "fr", None} and all("symbols" in cuts for cuts in found.values())


def test_one_stratum_has_nobody_to_propose(spark):
    counts, labels = small_strata(spark)
    assert quality._cutoffs_by_stratum(counts.filter("stratum = 'de'"), labels, 0.05, 0.05).collect() == []
