"""Mixing sources to target weights by a hypergeometric splitting tree.

A source's documents are laid end to end in a hash order, as often as its target
asks; this stream is cut into blocks of equal length, so a source's quota is a whole
number of blocks. The quotas of all sources are split among the output shards by a
binary tree: each node draws, without replacement, how many of each source's blocks
go left (a multivariate hypergeometric draw), down to single shards. Every shard then
takes that many blocks from each source's permuted blocks, disjoint from all other
shards, and shuffles its pieces locally. All draws are keyed by the seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.llm.common import in_hash_order, in_range_order, word_count, word_list
from eventmill.session import stored

#: Words of a block, and blocks of an output shard.
BLOCK_WORDS = 1 << 14
SHARD_BLOCKS = 1 << 8
#: Blocks of a source that one row lists.
RUN_BLOCKS = 1 << 16
#: Output shards at most; beyond it they hold more blocks.
MAX_SHARDS = 4096
#: Documents of a shard that are written together.
SLOTS = 2048
#: No document is taken more often, and so no source.
MAX_REPEATS = 3
#: Sources whose quotas are split together; more are split bucket by bucket.
SOURCE_BUCKET = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Add `place`, `weight` and `target` to (source, source_size).

    Sources in code point order, null last, get `weights` in turn and share the sum
    of all sizes. A target stops at `max_repeats` times its source's size; the excess
    goes to the others by weight, round by round, until none is above. Only sums
    reach the driver; the rounds are at most the distinct ratios of size to weight,
    and in practice few.
    """
    code_points = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    placed = in_range_order(sizes, [], code_points, "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(placed.select("source", "source_size", "place", weight.alias("weight")))
    share = None
    limit = F.col("source_size") * max_repeats
    capped = F.lit(False)
    while True:
        sums = rows.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, limit).otherwise(0)).alias("fixed"),
            F.sum(F.when(~capped, F.col("weight")).otherwise(0)).alias("weights"),
            F.count_if(capped).alias("n"),
        ).first()
        if not sums["weights"]:
            break
        new = (sums["all"] - sums["fixed"]) / sums["weights"]
        if share is not None and new == share:
            break
        share = new
        capped = F.col("weight") * F.lit(float(share)) >= limit
    open_target = F.col("weight") * F.lit(float(share or 0.0))
    return rows.withColumn("target", F.when(capped, limit.cast("double")).otherwise(open_target))


def split_quotas(quotas: np.ndarray, shard_sizes: np.ndarray, seed: int) -> np.ndarray:
    """(source, shard) counts with the given row and column sums, by the splitting tree."""
    out = np.zeros((len(quotas), len(shard_sizes)), np.int64)
    stack = [(0, len(shard_sizes), quotas.astype(np.int64))]
    while stack:
        lo, hi, here = stack.pop()
        if hi - lo == 1:
            out[:, lo] = here
            continue
        mid = (lo + hi) // 2
        draw = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = draw.multivariate_hypergeometric(here, int(shard_sizes[lo:mid].sum()), method="marginals")
        stack += [(lo, mid, left), (mid, hi, here - left)]
    return out


def _shard_counts(quotas: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """(place, starts): the first permuted block of each shard, per source."""
    even = [total * (s + 1) // shards - total * s // shards for s in range(shards)]

    def counts_of(places: pa.ChunkedArray, counts: np.ndarray, names: list[str]) -> pa.Table:
        return pa.table([places, pa.array(list(counts), pa.list_(pa.int64()))], names=names)

    def per_bucket(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        counts = split_quotas(rows["quota"].to_numpy(), np.array(even), seed)
        return counts_of(rows["bucket"], counts, ["bucket", "sizes"])

    def per_source(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        sizes, bucket = np.array(rows["sizes"][0].as_py()), rows["bucket"][0].as_py()
        counts = split_quotas(rows["quota"].to_numpy(), sizes, seed + 1 + bucket)
        return counts_of(rows["place"], np.cumsum(counts, axis=1), ["place", "ends"])

    # One row per bucket of SOURCE_BUCKET sources: small for any number of sources.
    bucketed = quotas.withColumn("bucket", F.floor(F.col("place") / SOURCE_BUCKET))
    tops = bucketed.groupBy("bucket").agg(F.sum("quota").alias("quota"))
    sizes = tops.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(
        per_bucket, "bucket long, sizes array<long>"
    )
    return (
        bucketed.join(sizes, "bucket")
        .groupBy("bucket")
        .applyInArrow(per_source, "place long, ends array<long>")
    )


def _place_in(ends: str, value: Column) -> Column:
    """How many of the rising `ends` are at most `value`, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(ends).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(F.col(ends), mid) <= value
        open_ = s["lo"] < s["hi"]
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"),
        )

    steps = F.sequence(F.lit(0), F.lit(MAX_SHARDS.bit_length()))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    seed: int = 8,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """The pieces of the mix: every document's takes, with their shard and place.

    One row per take: row_key, doc_id, source, size (words), source_size, target,
    epoch (0 is the first reading), words (what this take has; less than size only
    for the one document where its source's target ends), block, shard and slot (the
    piece's place in its shard, gapless from 0). A document that is not taken has one row with null
    epoch, block, shard and slot and 0 words.

    A null text has no words; a null source is a source, the last. Rows with a null
    or repeated doc_id are taken one by one; row_key tells them apart. Ties in the
    hash order are broken by doc_id. Extra columns are ignored. Without words
    nothing is taken; an empty table gives no rows. Equal inputs and seeds give equal mixes.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        word_count(text).alias("size"),
        F.xxhash64("doc_id", "source", text).alias("hash"),
    )
    order = F.xxhash64("hash", F.lit(seed))
    # Equal rows are interchangeable; they are told apart by their number.
    twin = Window.partitionBy("hash", "doc_id").orderBy(F.lit(0))
    rows = stored(rows.withColumn("twin", F.row_number().over(twin)))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, max_repeats))
    placed = in_hash_order(
        rows, ["source"], order, [F.col("doc_id"), F.col("hash"), F.col("twin")], F.col("size"), "start"
    )
    t = targets.select(F.col("source").alias("_source"), "source_size", "place", "target")
    quota_words = F.round("target").cast("long")
    placed = placed.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # The stream repeats the line: a reading of a document at epoch e begins at e * source_size + start.
    epochs = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    reads = F.filter(
        F.transform(
            epochs,
            lambda e: F.struct(
                e.alias("epoch"),
                (e * F.col("source_size") + F.col("start")).alias("at"),
                F.least(
                    F.col("size"),
                    F.greatest(quota_words - e * F.col("source_size") - F.col("start"), F.lit(0)),
                ).alias("words"),
            ),
        ),
        lambda r: r["words"] > 0,
    )
    pieces = placed.select(
        F.xxhash64("hash", "doc_id", "twin").alias("row_key"),
        "doc_id", "source", "size", "source_size", "target", "place", F.explode_outer(reads).alias("read"),
    ).select(
        "row_key", "doc_id", "source", "size", "source_size", "target", "place", "read.epoch",
        F.coalesce("read.words", F.lit(0)).cast("long").alias("words"),
        F.floor(F.col("read.at") / block_words).alias("block"),
    )
    pieces = stored(pieces)

    quotas = targets.select("place", F.ceil(quota_words / block_words).alias("quota")).filter("quota > 0")
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, -(-total // shard_blocks)))
    ends = stored(_shard_counts(quotas, total, shards, seed))
    # Permuted blocks: a block's rank by hash among its source's blocks.
    # A source's blocks are listed by many tasks, a run each.
    last = F.col("quota") - 1
    runs = F.sequence(F.lit(0).cast("long"), F.floor(last / RUN_BLOCKS))
    runs = quotas.select("place", "quota", F.explode(runs).alias("run")).repartition("place", "run")
    first = F.col("run") * RUN_BLOCKS
    own = F.sequence(first, F.least(last, first + RUN_BLOCKS - 1))
    blocks = runs.select("place", F.explode(own).alias("block"))
    ranked = in_hash_order(
        blocks, ["place"], F.xxhash64("place", "block", F.lit(seed + 1)), [F.col("block")], F.lit(1), "rank"
    )
    dealt = ranked.join(ends, "place").select(
        F.col("place").alias("_place"),
        F.col("block").alias("_block"),
        _place_in("ends", F.col("rank")).alias("shard"),
    )
    shared = pieces.filter("epoch IS NOT NULL").join(
        stored(dealt), (F.col("place") == F.col("_place")) & (F.col("block") == F.col("_block"))
    )
    shuffled = Window.partitionBy("shard").orderBy(
        F.xxhash64("row_key", "epoch", F.lit(seed + 2)), "row_key", "epoch"
    )
    shared = shared.withColumn("slot", (F.row_number().over(shuffled) - 1).cast("long"))
    columns = ["row_key", "doc_id", "source", "size", "source_size", "target", "epoch", "words", "block"]
    none = pieces.filter("epoch IS NULL").select(
        *columns, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot")
    )
    return shared.select(*columns, "shard", "slot").unionByName(none)


def taken(pieces: DataFrame) -> DataFrame:
    """Per document of the mix: size, source_size, target and the words taken in all."""
    return pieces.groupBy("row_key", "doc_id", "source", "size", "source_size", "target").agg(
        F.sum("words").alias("taken"), F.count("epoch").alias("n_reads")
    )


def drawn(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The mix as documents: a row of `docs` for every take, in the order of shards and slots.

    `pieces` are those of `mix(docs)`. Joined on row_key, so rows with a null or repeated
    doc_id have their own takes; of rows with equal id, source and text each is one of these takes, in
    the order of their other columns. The text of a whole take stays as it is; a cut one has its first words, joined by blanks, and
    n_chars, where there is one, is the new text's length.
    """
    takes = pieces.filter("epoch IS NOT NULL").select(
        F.col("row_key").alias("_key"),
        F.col("words").alias("_words"),
        F.col("size").alias("_size"),
        F.col("shard").alias("_shard"),
        F.col("slot").alias("_slot"),
    )
    # The document as one column: its own columns may have any names.
    rows = docs.select(F.struct("*").alias("_doc"))
    # The hash and number of mix().
    key = F.xxhash64("_doc.doc_id", "_doc.source", F.col("_doc.text").cast("string"))
    rows = rows.withColumn("_hash", key).withColumn("_id", F.col("_doc.doc_id").cast("long"))
    # Only rows that come again meet to be numbered; all others are a first one where they lie.
    again = stored(rows.groupBy("_hash", "_id").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    numbered = rows.withColumn("_twin", F.lit(1))
    if again.limit(1).count():
        keys = again.select(F.col("_hash").alias("_h"), F.col("_id").alias("_i"))
        same = (F.col("_hash") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_i"))
        twin = F.row_number().over(Window.partitionBy("_hash", "_id").orderBy(F.to_json("_doc")))
        numbered = numbered.join(keys, same, "left_anti").unionByName(
            rows.join(keys, same, "left_semi").withColumn("_twin", twin)
        )
    rows = numbered.join(takes, F.xxhash64("_hash", "_id", "_twin") == F.col("_key"))
    run = F.floor(F.col("_slot") / SLOTS)
    rows = rows.repartition("_shard", run).sortWithinPartitions("_shard", "_slot")
    whole = F.col("_doc.text")
    cut = F.array_join(F.slice(word_list(whole), 1, F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") < F.col("_size"), cut).otherwise(whole)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
