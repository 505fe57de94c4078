"""K-d tree partitioning of documents into shards of near-equal bytes.

Nodes are split level by level at weighted medians (or, for an uneven number of
shards, at the fitting fraction) along the metadata dimension in which the node is
widest, until every leaf is one shard. A level's cuts are found by histograms of
bytes that all nodes fill together: a first one over the dimension's range, then
finer ones within the bin of the cut, until the bin holds a thousandth of a shard or
one value; rows of that value are cut by a hash. Only nodes x bins sums reach the
driver, and the tree itself is at most one cut per shard.

Documents of equal text stay together: they take the place of their first one.
Only a group that is too heavy for the balance is dealt row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.llm.common import in_hash_order
from eventmill.session import stored

BINS = 256
#: A group of equal texts above this share of a shard is dealt row by row.
GROUP_SHARE = 1 / 16
#: The bin of a cut is refined until it holds no more than this share of a shard.
TOLERANCE = 1 / 1000


def text_number(value: Column) -> Column:
    """The first six bytes of a text as a number, in the same order."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(value, F.lit("")), "utf-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


#: Metadata dimensions of documents, each a number; missing values come first.
DIMENSIONS = {
    "log_bytes": lambda: F.log2(F.col("size").cast("double")),
    "lang": lambda: text_number(F.col("lang")),
    "source": lambda: text_number(F.col("source")),
    "doc_id": lambda: F.coalesce(F.col("doc_id").cast("double"), F.lit(float(-(1 << 63)))),
}


def _grouped(rows: DataFrame, limit: float, dimensions: list[str]) -> DataFrame:
    """Rows of a light group of equal texts take the dimensions of its first row."""
    groups = rows.groupBy("text_key").agg(
        F.sum("size").alias("group_bytes"),
        F.count("*").alias("copies"),
        F.min_by(F.struct(*dimensions), F.struct("doc_id", "source_text")).alias("lead"),
    )
    groups = stored(groups.filter((F.col("copies") > 1) & (F.col("group_bytes") <= limit)))
    groups = groups.select(F.col("text_key").alias("_key"), "lead")
    joined = rows.join(groups, F.col("text_key") == F.col("_key"), "left")
    light = F.col("_key").isNotNull()
    own = F.xxhash64("text_key", "doc_id", "source_text")
    return joined.select(
        *[c for c in rows.columns if c not in dimensions],
        *[F.when(light, F.col(f"lead.{d}")).otherwise(F.col(d)).alias(d) for d in dimensions],
        F.when(light, F.xxhash64("text_key")).otherwise(own).alias("tie"),
    )


def _cut_level(rows: DataFrame, nodes: dict[int, tuple[int, int]], dimensions: list[str], grain: float):
    """Cuts of all nodes of more than one shard: node -> (dimension, value, tie)."""
    todo = [n for n, (lo, hi) in nodes.items() if hi - lo > 1]
    spans = rows.filter(F.col("node").isin(todo)).groupBy("node").agg(
        F.sum("size").alias("bytes"),
        *[f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)],
    )
    spans = {r["node"]: r for r in spans.collect()}  # a row per node, at most one per shard
    whole = {
        d: max((r[f"max_{d}"] for r in spans.values()), default=0)
        - min((r[f"min_{d}"] for r in spans.values()), default=0)
        for d in dimensions
    }
    state = {}
    for node, r in spans.items():
        lo, hi = nodes[node]
        share = ((lo + hi) // 2 - lo) / (hi - lo)

        def width(d, r=r):
            return (r[f"max_{d}"] - r[f"min_{d}"]) / whole[d] if whole[d] else 0.0

        d = max(dimensions, key=width)
        # The cut leaves `left` bytes below it; it lies in [low, high] of the dimension, or of the tie.
        state[node] = {"d": d, "left": r["bytes"] * share, "low": r[f"min_{d}"], "high": r[f"max_{d}"], "tie": None}
    cuts = {}
    while state:
        for node in [n for n, s in state.items() if s["tie"] is None and s["low"] == s["high"]]:
            state[node]["tie"] = (-(1 << 63), (1 << 63) - 1)
        part, low, high, wanted = (F.lit(None) for _ in range(4))
        inside = F.lit(False)
        for node, s in state.items():
            here = F.col("node") == node
            value = F.col(s["d"])
            if s["tie"] is None:
                span = s["high"] - s["low"]
                number = F.least(F.floor((value - s["low"]) / span * BINS), F.lit(BINS - 1))
                inside = inside | (here & value.between(s["low"], s["high"]))
            else:
                a, b = s["tie"]
                step = max(1, -(-(b - a + 1) // BINS))
                # Halved first, as the difference of two 64-bit numbers may not fit.
                number = F.floor((F.shiftright("tie", 1) - F.lit(a >> 1)) / F.lit(max(1, step >> 1)))
                number = F.greatest(F.lit(0), F.least(number, F.lit(BINS - 1)))
                inside = inside | (here & (value == s["low"]) & F.col("tie").between(a, b))
            part = F.when(here, number.cast("int")).otherwise(part)
            wanted = F.when(here, value).otherwise(wanted)
        hist = (
            rows.filter(inside)
            .withColumn("bin", part)
            .withColumn("value", wanted)
            .groupBy("node", "bin")
            .agg(
                F.sum("size").alias("bytes"),
                F.min("value").alias("low"),
                F.max("value").alias("high"),
                F.min("tie").alias("tie_low"),
                F.max("tie").alias("tie_high"),
            )
        )
        bins: dict[int, list] = {n: [] for n in state}
        for r in hist.collect():  # nodes x BINS rows at most
            bins[r["node"]].append(r)
        for node in list(state):
            s = state[node]
            for r in sorted(bins[node], key=lambda r: r["bin"]):
                if r["bytes"] <= s["left"]:
                    s["left"] -= r["bytes"]
                    best = r
                    continue
                done = r["bytes"] <= grain if s["tie"] is None else r["tie_low"] == r["tie_high"] or r["bytes"] <= grain
                if done:
                    # The bin goes to the side that it overshoots less.
                    above = s["left"] * 2 < r["bytes"]
                    if s["tie"] is None:
                        cuts[node] = (s["d"], r["low"], None) if above else (s["d"], r["high"], (1 << 63) - 1)
                    else:
                        cuts[node] = (s["d"], s["low"], (r["tie_low"] - 1) if above else r["tie_high"])
                    del state[node]
                elif s["tie"] is None:
                    s["low"], s["high"] = r["low"], r["high"]
                else:
                    s["tie"] = (r["tie_low"], r["tie_high"])
                break
            else:  # everything goes left: rounding of the share
                tie = (1 << 63) - 1
                cuts[node] = (s["d"], s["high"] if s["tie"] is None else s["low"], tie)
                del state[node]
                _ = best
    return cuts


def kd_tree(docs: DataFrame, shards: int, group_share: float = GROUP_SHARE) -> DataFrame:
    """Add nothing dropped: per document doc_id, size, text_crc32, shard, slot and the dimensions.

    Size is the text's UTF-8 bytes plus 8; a null text has no bytes and counts as
    empty. Shards are numbered along the tree. slot is the place within the shard,
    gapless from 0, in a hash order. Null values of a dimension come before all
    others; rows that are equal in all dimensions are told apart by a hash of text, doc_id and source.
    Repeated rows are rows. Extra columns are ignored; columns lang and source may be
    missing; an empty table gives no rows, and shards without rows are possible in tiny tables.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    optional = [
        (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c)
        for c in ("lang", "source")
    ]
    rows = docs.select(
        F.col("doc_id").cast("long"),
        *optional,
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("text_key"),
    )
    dimensions = list(DIMENSIONS)
    rows = stored(
        rows.select(
            F.col("doc_id").alias("id"), "size", "text_crc32", "text_key", F.col("source").alias("source_text"),
            *[value().alias(f"k_{d}") for d, value in DIMENSIONS.items()],
        ).withColumnRenamed("id", "doc_id")
    )
    dimensions = [f"k_{d}" for d in dimensions]
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    tree = stored(_grouped(rows, target * group_share, dimensions))
    nodes, leaf = {1: (0, shards)}, {}
    node = F.lit(1)
    while any(hi - lo > 1 for lo, hi in nodes.values()):
        level = tree.withColumn("node", node)
        cuts = _cut_level(level, nodes, dimensions, target * TOLERANCE)
        below = {}
        step = F.col("node")
        for n, (lo, hi) in nodes.items():
            if hi - lo == 1:
                below[n] = (lo, hi)
                continue
            mid = (lo + hi) // 2
            below[2 * n], below[2 * n + 1] = (lo, mid), (mid, hi)
            if n in cuts:
                d, value, tie = cuts[n]
                at_cut = F.lit(False) if tie is None else (F.col(d) == value) & (F.col("tie") <= tie)
                step = F.when(
                    F.col("node") == n, F.when((F.col(d) < value) | at_cut, 2 * n).otherwise(2 * n + 1)
                ).otherwise(step)
        tree = stored(level.withColumn("node", step))
        node, nodes = F.col("node"), below
    leaf = F.create_map(*[F.lit(x) for n, (lo, _) in nodes.items() for x in (n, lo)])
    placed = tree.withColumn("shard", F.element_at(leaf, node).cast("int"))
    order = F.xxhash64("text_key", "doc_id", "source_text", F.lit(6))
    columns = ["doc_id", "size", "text_crc32", "shard", *dimensions]
    return in_hash_order(
        placed, ["shard"], order, [F.col("doc_id"), F.col("text_key")], F.lit(1), "slot"
    ).select(*columns, "slot")
