import random
import re
from collections import Counter, defaultdict

import pytest

from eventmill.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string, term string, digest int, n int"
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def plain(rows, min_docs, top):
    """The contract on Python integers, over all terms of all groups."""
    langs = defaultdict(lambda: [defaultdict(Counter), Counter()])
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups, docs = langs[lang or ""]
        groups[source or ""].update(terms)
        docs.update(set(terms))
    out = set()
    for lang, (groups, docs) in langs.items():
        kept = [t for t, n in docs.items() if n >= min_docs]
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * v) for t in kept}  # noqa: B023

        whole = shares(sum(groups.values(), Counter()))
        p = {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = {o: sum(abs(p[s][t] - p[o][t]) for t in kept) for o in groups if o != s}
            terms = {t: p[s][t] - whole[t] for t in kept if groups[s][t] and p[s][t] > whole[t]}
            for part, values, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(values, key=lambda x: (-values[x], x.encode()))[:limit]  # noqa: B023
                out |= {(lang, s, part, x, values[x], k) for k, x in enumerate(ranked, 1)}
    return out


def corpus():
    draw = random.Random(4)
    words = ["the", "The", "naïve", "ÉTÉ", "été", "a-b", "x1y", "日本", "Straße"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    rows = []
    for i in range(400):
        lang = ["en", "de", None, ""][i % 4] if i % 3 else "en"
        source = "hot" if i % 3 == 0 else [None, "s1", "S1", "é", "z9"][i % 5]
        at = (len(source or "") * 13 + len(lang or "") * 29) % 100
        rows.append((" ".join(draw.choice(words[at:] + words[:20]) for _ in range(draw.randrange(60))), lang, source))
    rows += [("the end", "few", f"src{i}") for i in range(3)] + [(None, "none", "s"), ("", "none", None), ("12 34", "none", "t")]
    return rows + [("zeit " * 3000, "de", "long"), *[("again and again", "en", "twice")] * 40]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in divergence.audit(docs, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_plain_python(spark):
    rows = corpus()
    got = found(spark, rows, min_docs=10, top=7)
    assert got == plain(rows, 10, 7)
    assert {r[2] for r in got if r[0] == "none"} == {"pair"} and all(r[4] == 0 for r in got if r[0] == "none")


@pytest.mark.parametrize("bits", [1, 4])
def test_shared_digests_are_split(spark, bits):
    rows = corpus()
    assert found(spark, rows, min_docs=10, top=7, digest_bits=bits) == plain(rows, 10, 7)


def test_blocks_change_nothing(spark, monkeypatch):
    for name, value in (("BLOCK_TERMS", 16), ("BLOCK_SOURCES", 2), ("TEXT_BYTES", 500)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    assert found(spark, rows, min_docs=10, top=7) == plain(rows, 10, 7)


def test_values_tie_by_bytes_of_the_item(spark):
    rows = [("b é z a", "en", "one"), ("q", "en", "two"), ("q", "en", "three")]
    got = found(spark, rows, min_docs=1, top=3)
    assert got == plain(rows, 1, 3)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1:3] == ("one", "term")] == ["a", "b", "z"]


def test_large_counts_are_exact(spark):
    top = divergence._share
    import pyspark.sql.functions as F

    big = 9_000_000_000_000_000
    row = spark.range(1).select(top(F.lit(big), F.lit(big + 7), F.lit(3).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 5) // (big + 7 + 15)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
