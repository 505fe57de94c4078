"""Source divergence audit with late string materialization.

1. One pass over the texts: every Arrow batch gives a row per (lang, term) with its
   documents, its sources and their counts, stored compactly. No string of a term
   leaves a task for counting: terms go by a 64-bit digest.
2. Documents per (lang, digest) are summed; digests in too few documents can hold no
   kept term, even where several terms share one, and end here.
3. For the kept digests alone the smallest and largest string are looked up. Where
   these differ, several terms share the digest: it is split, its terms counted by
   their strings and numbered. All others are one term.
4. Counts per source and term, N, V and the probabilities are exact integers.
   Sources of a lang are compared in blocks of terms, each a small matrix.
5. Text is joined back for kept outputs only: terms from the 50th value of their group on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.session import stored

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Terms, and sources, of one block of a comparison, on average.
BLOCK_TERMS = 4096
BLOCK_SOURCES = 256
#: Bytes of text that are split into terms together.
TEXT_BYTES = 1 << 23

# Terms are runs of ASCII letters and of all beyond ASCII; only A-Z are lower-cased.
_TO_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_PARTS = "lang string, term string, docs long, sources array<string>, counts array<long>"


def _strings(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    starts = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return np.append(starts, len(sorted_keys))


def _counted(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.RecordBatch:
    """Rows of _PARTS for some documents."""
    text = pa.concat_arrays([_strings(text)])
    langs, sources = _strings(lang).dictionary_encode(), _strings(source).dictionary_encode()
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if text.buffers()[2] else b""
    clean = pa.Array.from_buffers(
        pa.large_string(), len(text), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data.translate(_TO_TERMS))]
    )
    words = pc.split_pattern(clean, " ")
    flat, doc = pc.list_flatten(words), pc.list_parent_indices(words)
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    doc = doc.filter(real).to_numpy().astype(np.int64)
    n_terms = max(1, len(coded.dictionary))
    pairs, n = np.unique(doc * n_terms + coded.indices.to_numpy(), return_counts=True)
    doc, term = pairs // n_terms, pairs % n_terms
    lang_of, source_of = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
    n_sources = max(1, len(sources.dictionary))
    key = (lang_of[doc] * n_terms + term) * n_sources + source_of[doc]
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = _runs(key)
    cells, firsts = key[starts[:-1]], starts[:-1]  # one per (lang, term, source)
    counts = np.add.reduceat(n, firsts) if len(firsts) else n
    docs = np.diff(starts)
    outer = _runs(cells // n_sources)  # one per (lang, term)
    at = cells[outer[:-1]] // n_sources
    totals = np.add.reduceat(docs, outer[:-1]) if len(at) else docs
    lists = pa.array(outer.astype(np.int32))
    return pa.record_batch(
        [
            langs.dictionary.take(pa.array(at // n_terms)).cast(pa.string()),
            coded.dictionary.take(pa.array(at % n_terms)).cast(pa.string()),
            pa.array(totals, pa.int64()),
            pa.ListArray.from_arrays(lists, sources.dictionary.take(pa.array(cells % n_sources)).cast(pa.string())),
            pa.ListArray.from_arrays(lists, pa.array(counts, pa.int64())),
        ],
        names=["lang", "term", "docs", "sources", "counts"],
    )


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + TEXT_BYTES, "right")))
            part = batch.slice(at, upto - at)
            yield _counted(*(part.column(i) for i in range(3)))
            at = upto


def _share(count: Column, total: Column, terms: Column) -> Column:
    """The probability in billionths, exactly: no product leaves 38 digits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(19,0)")
    return _whole(top, total + SMOOTHING * terms) + 1


def _whole(top: Column, bottom: Column) -> Column:
    """The integral part of a quotient; null where there is nothing to divide by."""
    return F.when(
        bottom > 0, F.call_function("div", top, bottom.cast("decimal(19,0)"))
    )


def term_counts(docs: DataFrame, min_docs: int, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): the kept terms of each lang, and their counts per source.

    kept: lang, digest, sub, term, total; counts: lang, source, digest, sub, n. A term
    is named by digest and sub: 0, or its number among the terms that share the digest.
    """
    rows = docs.select(*[F.col(c).cast("string") for c in ("text", "lang", "source")])
    digest = F.shiftrightunsigned(F.xxhash64("term"), 64 - digest_bits)
    parts = stored(rows.mapInArrow(_count_task, _PARTS)).withColumn("digest", digest)
    # A digest's documents are no fewer than those of each of its terms.
    frequent = stored(
        parts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    )
    key = ["lang", "digest"]
    ends = parts.select(*key, "term").join(frequent, key, "left_semi").groupBy(*key)
    ends = stored(ends.agg(F.min("term").alias("term"), F.max("term").alias("last")))
    single = ends.filter("term = last").select(*key, "term", F.lit(0).alias("sub"))
    cells = F.explode(F.arrays_zip("sources", "counts")).alias("cell")
    counted = (
        parts.select(*key, "sources", "counts")
        .join(ends.filter("term = last").select(*key), key, "left_semi")
        .select(*key, cells)
        .groupBy("lang", F.col("cell.sources").alias("source"), "digest")
        .agg(F.sum("cell.counts").alias("n"))
    )
    counts = counted.select("lang", "source", "digest", F.lit(0).alias("sub"), "n")
    shared = ends.filter("term <> last").select(*key)
    if shared.limit(1).count():
        several = stored(parts.join(shared, key, "left_semi"))
        enough = several.groupBy(*key, "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
        number = F.row_number().over(Window.partitionBy(*key).orderBy("term"))
        numbered = stored(enough.select(*key, "term", number.alias("sub")))
        single = single.unionByName(numbered)
        split = (
            several.select(*key, "term", cells)
            .join(numbered, [*key, "term"])
            .groupBy("lang", F.col("cell.sources").alias("source"), "digest", "sub")
            .agg(F.sum("cell.counts").alias("n"))
        )
        counts = counts.unionByName(split)
    counts = stored(counts)
    totals = counts.groupBy(*key, "sub").agg(F.sum("n").alias("total"))
    return stored(single.join(totals, [*key, "sub"])), counts


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(lang, i, j) and the rows (side, gid, at, p) of each unit, whose rows lie together."""
    now, held = None, []
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.to_numpy()
        i, j, block, *rest = (c.to_numpy().astype(np.int64) for c in batch.columns[1:])
        rows = np.stack(rest, axis=1)
        change = np.ones(len(code), bool)
        for c in (code, i, j, block):
            change[1:] &= c[1:] == c[:-1]
        starts = np.flatnonzero(~change | (np.arange(len(code)) == 0))
        for lo, hi in zip(starts, np.append(starts[1:], len(code)), strict=True):
            unit = (langs.dictionary[int(code[lo])].as_py(), int(i[lo]), int(j[lo]), int(block[lo]))
            if unit != now:
                if held:
                    yield now[:3], np.concatenate(held)
                now, held = unit, []
            held.append(rows[lo:hi])
    if held:
        yield now[:3], np.concatenate(held)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of differences between the sources of units (lang, i, j, block of terms).

    Rows with a negative term list the unit's sources, with p of a term that they lack;
    the others are the terms that they have. `seen` is the number of terms compared, and
    `gap` the difference at any other term.
    """
    names = ["lang", "a", "b", "value", "seen", "gap"]
    for (lang, i, j), rows in _units(batches):
        head = rows[rows[:, 2] < 0]
        cells = rows[rows[:, 2] >= 0]
        terms, at = np.unique(cells[:, 2], return_inverse=True)
        sides = []
        for side in (0, 1):
            mine = head[head[:, 0] == side]
            mine = mine[np.argsort(mine[:, 1])]
            table = np.repeat(mine[:, 3:], len(terms), axis=1)
            of = cells[:, 0] == side
            table[np.searchsorted(mine[:, 1], cells[of, 1]), at[of]] = cells[of, 3]
            sides.append((mine[:, 1], mine[:, 3], table))
        (left, left_p, table), (right, right_p, other) = sides[0], sides[0 if i == j else 1]
        out = []
        for gid, p, row in zip(left, left_p, table, strict=True):
            apart = right != gid
            found = [right, np.abs(other - row).sum(axis=1), np.abs(right_p - p)]
            found = [x[apart] for x in found]
            out.append(np.stack([np.full(len(found[0]), gid), *found]))
            if i != j:
                out.append(np.stack([found[0], np.full(len(found[0]), gid), *found[1:]]))
        if out:
            a, b, value, gap = np.concatenate(out, axis=1)
            seen = np.full(len(a), len(terms))
            kinds = [pa.array([lang] * len(a), pa.string())]
            yield pa.record_batch([*kinds, *[pa.array(x, pa.int64()) for x in (a, b, value, seen, gap)]], names=names)


def _pairs(groups: DataFrame, named: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, a, b, value) of all pairs of sources of a lang, both ways.

    Sources lie in blocks, and so do terms: a unit holds two blocks of sources and one of
    terms. The terms that none of its sources has all differ alike; they are added last.
    """
    unit_columns = ["lang", "i", "j", "block"]
    mine = F.transform(F.sequence(F.lit(0), F.col("s_blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("s_block")).alias("i"),
        F.greatest(x, F.col("s_block")).alias("j"),
        F.when(x < F.col("s_block"), 1).otherwise(0).alias("side"),
    ))
    each = groups.select("*", F.explode(mine).alias("u")).select("*", "u.*")
    blocks = F.sequence(F.lit(0), F.col("t_blocks") - 1)
    heads = each.select("lang", "i", "j", F.explode(blocks).alias("block"), "side", "gid", F.lit(-1).cast("long").alias("at"), "p0")
    terms = counts.join(named.select("lang", "digest", "sub", "at"), ["lang", "digest", "sub"])
    cells = terms.join(each, ["lang", "source"]).select(
        "lang", "i", "j", F.pmod("at", "t_blocks").cast("int").alias("block"), "side", "gid", "at", "p"
    )
    units = heads.union(cells).repartition(*unit_columns).sortWithinPartitions(*unit_columns, "at")
    found = units.mapInArrow(_distances, "lang string, a long, b long, value long, seen long, gap long")
    summed = found.groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("gap").alias("gap")
    )
    terms = groups.select("lang", "v").distinct()
    value = F.col("value") + (F.col("v") - F.col("seen")) * F.col("gap")
    return summed.join(terms, "lang").select("lang", "a", "b", value.alias("value"))


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, digest_bits: int = 64
) -> DataFrame:
    """How the sources of each lang differ: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters, A-Z lower-cased, and characters beyond ASCII. A lang
    keeps those in at least `min_docs` of its documents. With a count of c, N kept terms
    in all and V different ones, p = 1 + floor(10^9 (c + 5) / (N + 5 V)). Part `pair`: all
    other sources of the lang with the sum of the differences of p. Part `term`: kept
    terms that are more probable in the source than in its lang, `top` at most. Ranks go
    from 1 by value, descending, then item in byte order.

    Null text, lang and source count as ''. Every row is a document, ids are not looked
    at, so repeated rows count again. A source without kept terms has p of count 0; a
    lang without any has pairs of value 0. Ties of values go by item, and no two items
    of a group are equal. Extra columns are ignored; an empty table gives no rows.
    """
    kept, counts = term_counts(docs, min_docs, digest_bits)
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    occurring = docs.select(*blank).distinct()
    lang_sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sources = occurring.groupBy("lang").agg(F.count("*").alias("s"))
    group_sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    zero = F.lit(0).cast("long")
    s_blocks = F.ceil(F.col("s") / BLOCK_SOURCES).cast("int")
    groups = (
        occurring.join(sources, "lang")
        .join(lang_sizes, "lang", "left")
        .join(group_sizes, ["lang", "source"], "left")
        .select(
            "lang", "source",
            *[F.coalesce(c, zero).alias(c) for c in ("v", "lang_n", "own_n")],
            s_blocks.alias("s_blocks"),
            F.pmod(F.xxhash64("source"), s_blocks).cast("int").alias("s_block"),
            F.greatest(F.ceil(F.coalesce("v", zero) / BLOCK_TERMS), F.lit(1)).cast("int").alias("t_blocks"),
            F.monotonically_increasing_id().alias("gid"),
        )
    )
    p0 = F.coalesce(_share(zero, F.col("own_n"), F.col("v")), zero)
    groups = stored(groups.withColumn("p0", p0))
    named = stored(kept.withColumn("at", F.monotonically_increasing_id()))
    facts = groups.select("lang", "source", "v", "lang_n", "own_n")
    rated = counts.join(facts, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("own_n"), F.col("v")))
    rated = stored(rated)

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ids = groups.select("lang", "gid", "source")
    pairs = (
        _pairs(groups, named, rated.select("lang", "source", "digest", "sub", "p"))
        .join(ids.withColumnRenamed("gid", "a"), ["lang", "a"])
        .join(ids.select("lang", F.col("gid").alias("b"), F.col("source").alias("item")), ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    )

    key = ["lang", "digest", "sub"]
    q = _share(F.col("total"), F.col("lang_n"), F.col("v"))
    more = (
        rated.join(named.select(*key, "total"), key)
        .select("lang", "source", "digest", "sub", (F.col("p") - q).alias("value"))
        .filter("value > 0")
    )
    more = stored(more)
    # The values alone tell from where on terms can be among the first; text follows.
    by_value = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    least = more.withColumn("_place", by_value).filter(F.col("_place") <= top)
    least = least.groupBy("lang", "source").agg(F.min("value").alias("least"))
    first = more.join(least, ["lang", "source"]).filter("value >= least")
    terms = (
        first.join(named.select(*key, F.col("term").alias("item")), key)
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", place.alias("rank"))
        .filter(F.col("rank") <= top)
    )
    return pairs.unionByName(terms)
