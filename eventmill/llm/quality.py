"""Quality rules whose cutoffs limit the false rejection of good documents.

Every rule rejects documents on which a score is above a cutoff. The cutoffs are
not set by hand: on documents labelled good, a cutoff is certified only if an exact
binomial test shows that it rejects no more than a stated share of good documents of
its stratum. Along the grid of a rule, cutoffs are tested from the most lenient to
the strictest and testing stops at the first failure, which needs no correction;
across rules and strata the error level is divided by their number. Of the certified
cutoffs the one that separates bad from good labels best is taken. A stratum with too
few labels for that tests what the other strata's labels propose, as one rejection. All
of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.llm.common import let, word_list
from eventmill.session import stored

#: Share of a stratum's good documents that all rules together may reject.
MAX_FALSE = 0.05
#: Chance that any of the certified limits does not hold.
ERROR = 0.05
#: Cutoffs tried by every rule, as shares from 1 down to 0.
GRID = 50
#: What rejecting a share of the good documents costs against rejecting it of the bad.
PRICE = 10

#: Scores in [0, 1] by name; more is worse.
RULES = {
    "symbols": lambda c: F.try_divide(c["n_symbols"], c["n_symbols"] + c["n_words"]),
    "marks": lambda c: F.try_divide(c["n_marks"], c["n_marks"] + c["n_words"]),
    "capitals": lambda c: F.try_divide(c["n_capitals"], c["n_letters"]),
    "dup_lines": lambda c: F.try_divide(c["n_dup_lines"], c["n_lines"]),
    "repeats": lambda c: F.try_divide(c["n_repeat_words"], c["n_words"]),
}


def _repeat_words(words: Column, width: int = 5) -> Column:
    """How many words lie in windows of `width` words found twice or more.

    Windows are compared by a 64-bit hash of their words' hashes. Repeats are found
    by sorting, so the cost is n log n for any text.
    """

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))),
            lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, width)]),
        )

    def covered(found: Column) -> Column:
        def repeated(s: Column) -> Column:
            return F.transform(
                s,
                lambda e, j: F.when(
                    (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"]
                ),
            )

        def union(starts: Column) -> Column:
            return F.aggregate(
                F.transform(
                    starts,
                    lambda p, j: F.least(
                        F.lit(width), F.coalesce(F.get(starts, j + 1) - p, F.lit(width))
                    ).cast("long"),
                ),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(placed, lambda s: F.array_sort(F.array_compact(repeated(s))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(
            let(starts, union)
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), covered))


def measured(docs: DataFrame) -> DataFrame:
    """The columns of `docs` and the struct `stats` with the counts of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def gone(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    stats = let(
        word_list(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            gone(r"[^#*$%&|<>]+").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
            .cast("long")
            .alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            gone(r"[^!?]+").alias("n_marks"),
            gone(r"[^\p{Lu}]+").alias("n_capitals"),
            gone(r"[^\p{L}]+").alias("n_letters"),
        ),
    )
    # A generator keeps the optimizer from working the struct out once per field.
    return docs.select("*", F.explode(F.array(stats)).alias("stats"))


def base_failed(c) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def _log_factorial(n: Column) -> Column:
    """ln(n!), exact to about 1e-12: Stirling's series, moved up by 8."""
    x = n.cast("double") + 9
    series = (
        (x - 0.5) * F.log(x)
        - x
        + 0.9189385332046727
        + 1 / (12 * x)
        - 1 / (360 * x * x * x)
        + 1 / (1260 * F.pow(x, F.lit(5)))
    )
    for k in range(1, 9):
        series = series - F.log(n.cast("double") + k)
    return series


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X; 1 where k is at or above its mean.

    Summed downward from k. Terms below 40 standard deviations under k are less than
    the last digit of the sum and left out, so that long holdouts stay cheap.
    """
    reach = F.ceil(40 * F.sqrt(n * (p * (1 - p)))) + 50
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    first = F.exp(first + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    odds = (1 - p) / p
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(k, reach.cast("long"))),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct(
            (a["sum"] + a["term"]).alias("sum"),
            (a["term"] * ((k - i) / (n - k + i + 1)) * odds).alias("term"),
        ),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), first * total))


def _tried(labelled: DataFrame) -> DataFrame:
    """How many good and bad documents (k of n, k_bad of n_bad) each step of each rule rejects."""
    scores = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES]
    )
    # Step g stands for the cutoff (GRID - g) / GRID; a score is rejected from its first step on.
    first_step = (F.floor(GRID - (F.col("s.score") - 1e-9) * GRID) + 1).cast("int")
    counted = (
        labelled.select("stratum", "good", F.explode(scores).alias("s"))
        .groupBy("stratum", F.col("s.rule").alias("rule"), first_step.alias("step"))
        .agg(F.count_if("good").alias("good_at"), F.count_if(~F.col("good")).alias("bad_at"))
    )
    at = F.map_from_entries(F.collect_list(F.struct("step", F.struct("good_at", "bad_at"))))
    per_rule = counted.groupBy("stratum", "rule").agg(
        F.sum("good_at").alias("n"), F.sum("bad_at").alias("n_bad"), at.alias("at")
    )

    def rejected(kind: str) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.col("step")),
            F.lit(0).cast("long"),
            lambda a, i: a + F.coalesce(F.element_at("at", i)[kind], F.lit(0)),
        )

    return (
        per_rule.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(GRID - 1))))
        .withColumn("k", rejected("good_at"))
        .withColumn("k_bad", rejected("bad_at"))
        .drop("at")
    )


def _worth() -> Column:
    return F.try_divide("k_bad", "n_bad") - PRICE * F.try_divide("k", "n")


def _cutoff(step: Column) -> Column:
    return (GRID - step) / GRID


def _own_cutoffs(tried: DataFrame, max_false: float, error: float) -> DataFrame:
    """Per stratum and rule, the cutoff certified by the stratum's labels that is worth most."""
    judged = tried.withColumn("ok", binomial_at_most(F.col("k"), F.col("n"), max_false / len(RULES)) <= error / len(RULES))
    so_far = Window.partitionBy("stratum", "rule").orderBy("step")
    passed = judged.withColumn("all_ok", F.min("ok").over(so_far)).filter("all_ok")
    passed = passed.withColumn("worth", _worth()).filter("worth > 0")
    best = passed.groupBy("stratum", "rule").agg(F.max_by("step", F.struct("worth", -F.col("step"))).alias("step"))
    return best.select("stratum", "rule", _cutoff(F.col("step")).alias("cutoff"))


def _lent_cutoffs(labelled: DataFrame, tried: DataFrame, max_false: float, error: float) -> DataFrame:
    """Per stratum, cutoffs that the other strata's labels propose and its own certify.

    For each rule the step worth most on the labels of all other strata is proposed, so
    it owes nothing to the labels that test it. The rules are put in order of that worth,
    and the first one, the first two, and so on are tested as one rejection, with the
    whole of `max_false`, until a test fails. Of the sets that pass, the one that
    separates the stratum's own labels best is taken.
    """
    totals = tried.groupBy("rule", "step").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "n_bad", "k", "k_bad")])
    others = tried.join(totals, ["rule", "step"]).select(
        "stratum", "rule", "step", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in ("n", "n_bad", "k", "k_bad")]
    )
    proposed = others.withColumn("worth", _worth()).filter("worth > 0").groupBy("stratum", "rule").agg(
        F.max("worth").alias("worth"), F.max_by("step", F.struct("worth", -F.col("step"))).alias("step")
    )
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("worth"), "rule"))
    lent = stored(proposed.select("stratum", "rule", _cutoff(F.col("step")).alias("cutoff"), place.alias("place")))
    sets = lent.groupBy(F.col("stratum").alias("_stratum")).agg(
        F.collect_list(F.struct("place", "rule", "cutoff")).alias("sets")
    )
    score = F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])
    hit = F.filter("sets", lambda x: F.element_at(score, x["rule"]) > x["cutoff"] + 1e-9)
    # The place from which on a document is rejected; null if never.
    first = F.array_min(F.transform(hit, lambda x: x["place"]))
    found = labelled.join(sets, F.col("stratum").eqNullSafe(F.col("_stratum")))
    found = found.groupBy("_stratum", first.alias("first")).agg(
        F.count_if("good").alias("good_at"), F.count_if(~F.col("good")).alias("bad_at")
    )
    reached = F.col("first") <= F.col("place")
    tested = (
        lent.join(found, F.col("stratum").eqNullSafe(F.col("_stratum")))
        .groupBy("stratum", "place", "rule", "cutoff")
        .agg(
            F.sum("good_at").alias("n"),
            F.sum("bad_at").alias("n_bad"),
            F.sum(F.when(reached, F.col("good_at")).otherwise(0)).alias("k"),
            F.sum(F.when(reached, F.col("bad_at")).otherwise(0)).alias("k_bad"),
        )
    )
    so_far = Window.partitionBy("stratum").orderBy("place")
    passed = (
        tested.withColumn("ok", binomial_at_most(F.col("k"), F.col("n"), max_false) <= error)
        .withColumn("all_ok", F.min("ok").over(so_far))
        .withColumn("worth", F.when(F.col("all_ok"), _worth()))
    )
    whole = Window.partitionBy("stratum")
    last = F.max_by("place", F.when(F.col("worth") > 0, F.struct("worth", -F.col("place")))).over(whole)
    return passed.withColumn("last", last).filter("place <= last").select("stratum", "rule", "cutoff")


def cutoffs(labelled: DataFrame, max_false: float = MAX_FALSE, error: float = ERROR) -> DataFrame:
    """Certified cutoffs per stratum and rule.

    `labelled` has stratum, which may be null, `good` (boolean) and one score per rule.
    A stratum with enough good labels to certify single rules, each with its part of
    `max_false`, gets these: of the certified cutoffs of a rule that with the highest
    share of bad documents rejected, less PRICE times the share of good ones, the most
    lenient of equals; so a rule rejects no good documents for nothing. Any other stratum
    gets the cutoffs that the other strata's labels propose, if its own labels certify
    them as one rejection; that takes some 100 good labels instead of some 650. Half of
    the error goes to either kind of test, in equal parts to the strata. Rules without a
    certified cutoff, or without one that is worth anything, give no row.
    """
    tried = stored(_tried(labelled))
    strata = max(1, tried.filter("n > 0").select("stratum").distinct().count())
    own = stored(_own_cutoffs(tried, max_false, error / 2 / strata))
    lent = _lent_cutoffs(labelled, tried, max_false, error / 2 / strata)
    served = own.select(F.col("stratum").alias("_served")).distinct()
    return own.unionByName(lent.join(served, F.col("stratum").eqNullSafe(F.col("_served")), "left_anti"))


def _scored(counts: DataFrame) -> DataFrame:
    c = {name: F.col(name) for name in counts.columns}
    # Documents without words have no shares; they fail the base anyway.
    return counts.select("*", *[F.coalesce(rule(c), F.lit(0.0)).alias(name) for name, rule in RULES.items()])


def _cutoffs_by_stratum(counts: DataFrame, labels: DataFrame, max_false: float, error: float) -> DataFrame:
    """(_stratum, _cutoffs): a row per stratum, stored so that its size is known to joins."""
    # A document is one draw: bad if any of its labels says so, however often its row comes.
    marked = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
    marked = marked.agg(F.bool_and(F.col("quality") == 1).alias("good"))
    scored = _scored(counts).select("doc_id", "stratum", "n_words", "n_repeat_words", *RULES)
    scored = scored.filter(~base_failed({c: F.col(c) for c in scored.columns}))
    labelled = scored.join(marked, F.col("doc_id") == F.col("_id"))
    labelled = labelled.dropDuplicates(["doc_id", "stratum", *RULES]).select("stratum", "good", *RULES)
    found = cutoffs(stored(labelled), max_false, error)
    return stored(
        found.groupBy(F.col("stratum").alias("_stratum")).agg(
            F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs")
        )
    )


def _judged(counts: DataFrame, per_stratum: DataFrame) -> DataFrame:
    """Add `base_failed`, `rules` and `kept` to counts; documents stay where they lie."""
    rejected = F.array_compact(
        F.array(
            *[
                F.when(F.col(r) > F.element_at("_cutoffs", F.lit(r)) + 1e-9, F.lit(r))
                for r in RULES
            ]
        )
    )
    scored = _scored(counts)
    judged = scored.join(per_stratum, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return (
        judged.withColumn("base_failed", base_failed({c: F.col(c) for c in counts.columns}))
        .withColumn("rules", F.coalesce(rejected, F.array().cast("array<string>")))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0))
        .drop("_stratum", "_cutoffs", *RULES)
    )


def _counts(docs: DataFrame, stratum: str) -> DataFrame:
    one = measured(docs.select(F.col("doc_id"), F.col(stratum).alias("stratum"), F.col("text")))
    return one.select("doc_id", "stratum", "stats.*")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    max_false: float = MAX_FALSE,
    error: float = ERROR,
) -> DataFrame:
    """Per document its counts, `base_failed`, the rules that reject it, and `kept`.

    `labels` has doc_id and quality (1 is good, others bad); rows with a null in either are left
    out; a document with several labels is bad if any of them is, and rows with equal ids and
    scores count once. Strata are the values of a column
    of `docs`; null is a stratum. A stratum with too few good labels for a bound, or
    without bad ones, has no cutoffs: there only the base decides. Null and empty texts have no words and
    fail the base. Repeated rows are judged one by one; extra columns of `docs` are
    ignored; an empty table gives no rows.
    """
    counts = stored(_counts(docs, stratum))
    return _judged(counts, _cutoffs_by_stratum(counts, labels, max_false, error))


def good_documents(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    max_false: float = MAX_FALSE,
    error: float = ERROR,
) -> DataFrame:
    """The rows of `docs`, with all their columns, that `judge` keeps.

    Texts are counted twice, for the cutoffs and for the verdicts, and neither
    shuffled nor written in between.
    """
    per_stratum = _cutoffs_by_stratum(stored(_counts(docs, stratum)), labels, max_false, error)
    row = docs.select("doc_id", F.col(stratum).alias("stratum"), "text", F.struct("*").alias("_doc"))
    counts = measured(row).select("doc_id", "stratum", "stats.*", "_doc")
    return _judged(counts, per_stratum).filter("kept").select("_doc.*")
