"""URL filtering by a path-template tree with smoothed labelled purity.

The paths of a host form a tree of segments. Going down the tree, a segment that
varies - a number, a hash, a date, or a child with few pages and few labels - becomes a
wildcard. The named children that are left, however many and however deep, are put in
the order of their labelled share of bad pages, and each joins the branch of those before
it unless its share differs significantly from that branch's; children with few labels
are branches of their own. What remains are templates, and a template is rejected if
its share of good labels, smoothed towards its parents' shares, is too low. Rules by
host and path prefix come before the templates' verdicts. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.session import stored

#: A named child with this many pages or labels stays; with fewer labels it is compared with no other.
MIN_PAGES = 100
MIN_LABELS = 10
#: Names of a merged branch that are written out; of the others, their number and a hash.
SHOWN = 16
#: Two shares differ if their z score is beyond this.
Z = 2.58
#: Weight of the parent's share, in labels, and the least smoothed share of good ones.
PRIOR_LABELS = 10
MIN_PURITY = 0.5

#: Fixed values of the query's contract: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url as they are written; both empty without `://`."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none fits."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(longest_first):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(
            fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def _segments(path: Column) -> Column:
    """All segments; plainly variable ones are wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    variable = r"^(\d+(\.\w{1,5})?|\d[\d._-]+|[0-9a-fA-F-]{16,}|[^/]*\d{4,}[^/]*)$"
    return F.transform(parts, lambda s: F.when(s.rlike(variable), F.lit(WILD)).otherwise(s))


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, segments, template, n_pages, n_good, n_bad, purity): one row per distinct (host, segments).

    `pages` has host, segments and page_id, `labels` page_id and bad.
    All work is on counts per distinct path shape, combined before the shuffle.
    """
    counts = labels.groupBy(F.col("page_id").alias("_id")).agg(
        F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad")
    )
    marked = pages.join(counts, F.col("page_id") == F.col("_id"), "left")
    shapes = marked.groupBy("host", "segments").agg(
        F.count("*").alias("n_pages"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"),
    )
    shapes = shapes.withColumn("template", F.lit(""))
    level, done = 0, []
    open_ = stored(shapes)
    while True:
        done.append(open_.filter(F.size("segments") <= level))
        open_ = open_.filter(F.size("segments") > level)
        # Where a template has too little for any child of it, all that follows is wildcards.
        if not _with_evidence(open_.groupBy("host", "template")).limit(1).count():
            break
        open_ = stored(_generalise(open_, level))
        level += 1
    rest = F.repeat(F.lit("/" + WILD), F.size("segments") - level)
    found = open_.withColumn("template", F.concat("template", rest))
    for part in done:
        found = found.unionByName(part)
    return stored(found)


def _with_evidence(groups) -> DataFrame:
    """Sums of groups of shapes, where they have enough pages or labels."""
    sums = groups.agg(F.sum("n_pages").alias("pages"), F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad"))
    return sums.filter((F.col("pages") >= MIN_PAGES) | (F.col("good") + F.col("bad") >= MIN_LABELS))


def _branches_of(kinds: Column) -> Column:
    """Number the branches of children, given as their distinct counts by rising share of bad ones."""
    start = F.struct(
        F.lit(0).alias("branch"),
        F.lit(0).cast("long").alias("good"),
        F.lit(0).cast("long").alias("bad"),
        F.array().cast("array<struct<good:bigint,bad:bigint,branch:int>>").alias("out"),
    )

    def add(s: Column, x: Column) -> Column:
        n, all_n = x["good"] + x["bad"], s["good"] + s["bad"]
        both = F.try_divide(x["bad"] + s["bad"], n + all_n)
        spread = F.sqrt(both * (1 - both) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), all_n)))
        gap = F.abs(F.try_divide(x["bad"], n) - F.try_divide(s["bad"], all_n))
        opens = F.coalesce(F.try_divide(gap, spread) > Z, F.lit(False))
        branch = s["branch"] + opens.cast("int")
        named = F.struct(x["good"].alias("good"), x["bad"].alias("bad"), branch.alias("branch"))
        return F.struct(
            branch.alias("branch"),
            (F.when(opens, 0).otherwise(s["good"]) + x["good"] * x["n"]).alias("good"),
            (F.when(opens, 0).otherwise(s["bad"]) + x["bad"] * x["n"]).alias("bad"),
            F.concat(s["out"], F.array(named)).alias("out"),
        )

    return F.aggregate(kinds, start, add, lambda s: s["out"])


def _generalise(shapes: DataFrame, level: int) -> DataFrame:
    """Extend `template` by the branch of the level's segment, which all shapes have."""
    at = shapes.withColumn("segment", F.get("segments", F.lit(level)))
    nodes = stored(_with_evidence(at.filter(F.col("segment") != WILD).groupBy("host", "template", "segment")))
    enough = F.col("good") + F.col("bad") >= MIN_LABELS
    # Children with equal counts are compared once, so a parent's list stays far shorter than its labels.
    share = (F.col("bad") / (F.col("good") + F.col("bad"))).alias("share")
    kinds = nodes.filter(enough).groupBy("host", "template", "good", "bad").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("host", "template").agg(
        F.array_sort(F.collect_list(F.struct(share, "good", "bad", "n"))).alias("kinds")
    )
    numbered = kinds.select("host", "template", F.inline(_branches_of(F.col("kinds"))))
    members = stored(nodes.filter(enough).join(numbered, ["host", "template", "good", "bad"]))
    # Of a branch only the names that are written out come together, and counts of the rest.
    place = F.row_number().over(Window.partitionBy("host", "template", "branch").orderBy("segment"))
    first = members.select("host", "template", "branch", "segment", place.alias("place")).filter(F.col("place") <= SHOWN)
    first = first.groupBy("host", "template", "branch").agg(F.array_sort(F.collect_list("segment")).alias("names"))
    sizes = members.groupBy("host", "template", "branch").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("segment")).alias("hash")
    )
    more = F.concat(F.lit("|+"), (F.col("n") - SHOWN).cast("string"), F.lit("#"), F.hex("hash"))
    shown = F.concat(F.array_join("names", "|"), F.when(F.col("n") > SHOWN, more).otherwise(""))
    name = F.when(F.col("n") > 1, F.concat(F.lit("{"), shown, F.lit("}"))).otherwise(F.get("names", F.lit(0)))
    branches = first.join(sizes, ["host", "template", "branch"]).select("host", "template", "branch", name.alias("name"))
    merged = members.join(branches, ["host", "template", "branch"]).select("host", "template", "segment", "name")
    own = nodes.filter(~enough).select("host", "template", "segment", F.col("segment").alias("name"))
    joined = at.join(stored(merged.unionByName(own)), ["host", "template", "segment"], "left")
    branch = F.concat(F.lit("/"), F.coalesce("name", F.lit(WILD)))
    return joined.withColumn("template", F.concat("template", branch)).select(*shapes.columns)


def judged_templates(shapes: DataFrame) -> DataFrame:
    """Per (host, template) its counts, smoothed purity and verdict.

    The prior is the host's share of good labels, itself smoothed towards that of all
    labels; so a template without labels is judged by its host, and a host without
    any by everything.
    """
    sums = [F.sum(c).alias(c) for c in ("n_pages", "n_good", "n_bad")]
    rows = shapes.groupBy("host", "template").agg(*sums)
    hosts = rows.groupBy("host").agg(F.sum("n_good").alias("host_good"), F.sum("n_bad").alias("host_bad"))
    whole = hosts.agg(F.sum("host_good"), F.sum("host_bad")).first()
    good, bad = whole[0] or 0, whole[1] or 0
    base = F.lit((good + 1.0) / (good + bad + 1.0))
    by_host = (F.col("host_good") + PRIOR_LABELS * base) / (F.col("host_good") + F.col("host_bad") + PRIOR_LABELS)
    purity = (F.col("n_good") + PRIOR_LABELS * by_host) / (F.col("n_good") + F.col("n_bad") + PRIOR_LABELS)
    return (
        rows.join(hosts, "host")
        .withColumn("purity", purity)
        .withColumn("template_verdict", F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow"))
        .drop("host_good", "host_bad")
    )


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, purity.

    `labels` has page_id and bad (boolean); rows with a null in either are left out,
    and a page may have several. The verdict is the longest fitting rule's, else the
    template's. Null urls and urls without `://` have empty host and path and one template, `''`.
    Null or repeated page_ids are judged row by row; extra columns are ignored; an
    empty table gives no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = stored(rows.withColumn("segments", _segments(F.col("path"))))
    shapes = templates(rows, labels.filter("page_id IS NOT NULL AND bad IS NOT NULL"))
    verdicts = judged_templates(shapes).select("host", "template", "purity", "template_verdict")
    by_shape = stored(shapes.select("host", "segments", "template").join(verdicts, ["host", "template"]))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    joined = rows.join(by_shape, ["host", "segments"], "left").withColumn("found", rule)
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "template_verdict").alias("verdict"),
        "template",
        "purity",
    )
