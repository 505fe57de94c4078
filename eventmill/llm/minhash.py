"""MinHash near-dedup by an inverted join on signature coordinates.

1. Every text becomes the set of its word shingles (64-bit hashes) and a signature of
   COORDINATES minima. Texts with equal sets fall into one class; only classes go on.
2. A class is posted under its coordinate-value pairs. Two sets above the wanted
   similarity agree on at least MATCHES coordinates but for one pair in about a
   million, so it is enough to look for pairs with that many collisions. Values that
   one class alone has are dropped; a class with fewer than MATCHES others is done.
   Of the rest, ordered from rare to frequent, two such sets share one within the
   first COORDINATES - MATCHES + 1 (prefix); the frequent ones after it are skipped.
3. Collisions are counted within every remaining list, and pairs with MATCHES or more
   join their classes to candidate groups. Long lists are split into blocks: all meet
   the first, and what this leaves unconnected meets all; each unit of work returns a
   spanning forest, never all pairs.
4. Candidate groups meet with their full sets: intersections are counted exactly, by
   incidence products, and links again leave as spanning forests. Groups that are too
   large for one unit go by blocks, or by their posting lists, whichever ships less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.llm.graph import components
from eventmill.session import stored

COORDINATES = 24
#: A pair of similarity 0.85 has fewer with a chance of 1.3e-6; one of 0.8, of 4e-5.
MATCHES = 11
#: Classes, and shingles, that meet in one block of a unit of work at most, on average.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20

_M = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9]
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(_M[3])
    return x ^ (x >> _U(29))


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(_M[0]))
    return seeds[:n, None], seeds[n:, None] | _U(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles.

    ASCII letters are lower-cased; a text of fewer words is one shingle as a whole;
    without words the set is empty.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    count = len(words) - span + 1
    total = np.full(count, span, np.uint64)
    for i in range(span):
        total = _mixed(total * _U(_M[1]) + hashes[i : i + count] * _U(_M[2]))
    return np.unique(total)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Per coordinate the smallest of the set's values, with the coordinate's number above it."""
    masks, factors = _parameters(coordinates)
    least = np.full(coordinates, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        values = (shingles[None, at : at + (1 << 14)] ^ masks) * factors
        least = np.minimum(least, values.min(axis=1))
    place = np.arange(coordinates, dtype=np.uint64) << _U(48)
    return (place | (least >> _U(16))).astype(np.int64)


def _sketch_task(batches: Iterator[pa.RecordBatch], width: int, coordinates: int):
    for batch in batches:
        sizes, classes, signatures, packed = [], [], [], []
        for text in batch.column(2):
            shingles = shingle_set(text.as_py(), width)
            sizes.append(len(shingles))
            classes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            values = signature(shingles, coordinates) if len(shingles) else None
            signatures.append(values)
            packed.append(None if values is None else values.astype(np.uint32).tobytes())
        yield pa.record_batch(
            [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array(classes, pa.binary()),
                pa.array(signatures, pa.list_(pa.int64())),
                pa.array(packed, pa.binary()),
            ],
            names=["doc_id", "text_hash", "n_shingles", "cls", "signature", "packed"],
        )


def _set_task(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        sets = [shingle_set(text.as_py(), width) for text in batch.column(0)]
        yield pa.record_batch(
            [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ],
            names=["cls", "shingles"],
        )


def _forest(linked: np.ndarray, crossing: bool) -> Iterator[tuple[int, int]]:
    """A star per connected component; rows and columns are two sides if crossing."""
    rows, columns = linked.shape
    size = rows + columns if crossing else rows
    todo = np.ones(size, bool)
    while True:
        root = int(todo.argmax())
        if not todo[root]:
            return
        todo[root] = False
        front = np.array([root])
        while len(front):
            if crossing:
                reached = np.zeros(size, bool)
                left, right = front[front < rows], front[front >= rows] - rows
                reached[rows:] = linked[left].any(axis=0) if len(left) else False
                reached[:rows] = linked[:, right].any(axis=1) if len(right) else False
            else:
                reached = linked[front].any(axis=0)
            front = np.flatnonzero(reached & todo)
            todo[front] = False
            for node in front.tolist():
                yield node, root


def _collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(left), len(right)), np.uint8)
    for c in range(left.shape[1]):
        counts += left[:, c, None] == right[None, :, c]
    return counts


def _intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Exact sizes of the intersections of all pairs of sets."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.flatnonzero(np.bincount(column, minlength=len(values)) > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows = len(left)
    total = np.zeros((rows, len(right) if right is not None else rows), np.float32)
    step = max(1, min(4096, (1 << 23) // max(1, len(sets))))
    for at in range(0, len(shared), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        part = np.zeros((len(sets), min(step, len(shared) - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        total += part[:rows] @ (part[rows:] if right is not None else part).T
    return total


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Runs of rows with equal (unit, i, j): their (class, data) pairs by side."""
    now, sides = None, ([], [])
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for cls, unit, i, j, side, data in zip(*columns, strict=True):
            if (unit, i, j) != now:
                if now is not None:
                    yield now, sides
                now, sides = (unit, i, j), ([], [])
            sides[side].append((cls, data))
    if now is not None:
        yield now, sides


def _edge_task(batches: Iterator[pa.RecordBatch], linked_pairs):
    out: tuple[list, list] = ([], [])

    def batch():
        return pa.record_batch([pa.array(x, pa.binary()) for x in out], names=["a", "b"])

    for (_, i, j), (left, right) in _units(batches):
        crossing = i != j
        if len(left) < (1 if crossing else 2) or (crossing and not right):
            continue
        names = [cls for cls, _ in left + right]
        # The smallest class first, so that stars point to it.
        linked = linked_pairs([p for _, p in left], [p for _, p in right] if crossing else None)
        for node, root in _forest(linked, crossing):
            out[0].append(names[node])
            out[1].append(names[root])
        if len(out[0]) > 50_000:
            yield batch()
            out[0].clear()
            out[1].clear()
    yield batch()


def _dealt(placed: DataFrame, linked_pairs) -> DataFrame:
    """Edges within the units (unit, i, j) of rows with cls, side and data."""
    rows = placed.select("cls", "unit", "i", "j", "side", "data")
    dealt = rows.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "cls")
    return dealt.mapInArrow(lambda b: _edge_task(b, linked_pairs), "a binary, b binary")


def _linked(members: DataFrame, data: DataFrame, linked_pairs) -> DataFrame:
    """Edges with the components of all linked pairs within the units.

    `members` has cls, unit and parts, `data` cls and data. A unit of several parts is
    split into that many blocks by hash. First all blocks meet the first one; in a
    dense group this links nearly everything. What is then outside the unit's largest
    component meets all its members, block by block; pairs inside that component need
    no look, as they are connected already.
    """
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    members = members.withColumn("part", part)
    carried = members.join(data, "cls")
    met = F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    first = carried.withColumn("j", F.explode(met)).withColumn("i", F.lit(0))
    side = ((F.col("part") > 0) & (F.col("j") > 0)).cast("int")
    edges = stored(_dealt(first.withColumn("side", side), linked_pairs))
    split = stored(members.filter("parts > 1"))
    if not split.limit(1).count():
        return edges
    roots = components(edges)
    named = split.join(roots, F.col("cls") == F.col("node"), "left").select(
        "unit", "cls", "parts", F.coalesce("root", "cls").alias("root")
    )
    sizes = named.groupBy("unit", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("unit").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = stored(named.join(main, "unit").filter("root != main").select("unit", "cls", "parts"))
    blocks = rest.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("rest_parts"))
    # Blocks of the rest count downward from -1, so that they meet every block of the members.
    own = F.pmod(F.xxhash64("cls"), F.col("rest_parts")).cast("int")
    left = rest.join(blocks, "unit").join(data, "cls").select(
        "cls", "unit", (-1 - own).alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"),
        F.lit(0).alias("side"), "data",
    )
    right = split.join(blocks, "unit").join(data, "cls").select(
        "cls", "unit", F.explode(F.sequence(-F.col("rest_parts"), F.lit(-1))).alias("i"), F.col("part").alias("j"),
        F.lit(1).alias("side"), "data",
    )
    return edges.union(stored(_dealt(left.unionByName(right), linked_pairs)))


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sketches, roots): one row per document with its class, and each linked class's root."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    row_key = F.xxhash64("doc_id", "text_hash").alias("row_key")
    sketches = stored(
        rows.mapInArrow(
            lambda b: _sketch_task(b, width, COORDINATES),
            "doc_id long, text_hash long, n_shingles long, cls binary, signature array<long>, packed binary",
        )
    )
    classes = stored(
        sketches.filter("n_shingles > 0")
        .groupBy("cls")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("first"),
            F.max("n_shingles").alias("n"),
            F.first(F.struct("signature", "packed")).alias("sketch"),
        )
    )
    # Posting lists: frequencies are counted before anything is joined to them.
    posted = classes.select("cls", F.explode("sketch.signature").alias("key"))
    frequent = posted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    prefix = COORDINATES - MATCHES + 1
    ordered = F.array_sort(F.collect_list(F.struct("df", "key")))
    kept = (
        posted.join(frequent, "key")
        .groupBy("cls")
        .agg(ordered.alias("keys"))
        .filter(F.size("keys") >= MATCHES)
        .select("cls", F.slice("keys", 1, prefix - COORDINATES + F.size("keys")).alias("keys"))
    )
    listed = stored(kept.select("cls", F.explode("keys.key").alias("key")))
    lists = listed.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    postings = stored(
        listed.join(lists, "key")
        .join(classes.select("cls", "n"), "cls")
        .select(
            "cls",
            F.col("key").cast("string").alias("unit"),
            F.ceil(F.col("df") / BLOCK_ROWS).cast("int").alias("parts"),
            "n",
        )
    )

    def collide(left, right):
        a = np.frombuffer(b"".join(left), np.uint32).reshape(len(left), -1)
        b = a if right is None else np.frombuffer(b"".join(right), np.uint32).reshape(len(right), -1)
        return _collisions(a, b) >= MATCHES

    packed = classes.select("cls", F.col("sketch.packed").alias("data"))
    groups = stored(components(_linked(postings.select("cls", "unit", "parts"), packed, collide)))
    # Verification: each candidate group as one unit where it fits, else as blocks or as lists.
    grouped = groups.join(classes.select("cls", "first", "n"), F.col("node") == F.col("cls"))
    grouped = stored(grouped.select("cls", "root", "first", "n"))
    by_list = stored(postings.select("cls", "unit", "n").join(grouped.select("cls", "root"), "cls"))
    parts = F.greatest(
        F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)
    ).cast("int")
    group_size = grouped.groupBy("root").agg(parts.alias("parts"), F.count("*").alias("m"))
    list_size = by_list.groupBy("root", "unit").agg(parts.alias("list_parts"), F.count("*").alias("m"))
    list_cost = list_size.groupBy("root").agg(F.sum(F.col("m") * F.col("list_parts")).alias("cost"))
    sized = group_size.join(list_cost, "root", "left").withColumn(
        "whole", (F.col("parts") == 1) | (F.col("m") * F.col("parts") <= F.coalesce("cost", F.lit(0)))
    )
    sized = stored(sized)
    whole = grouped.join(sized.filter("whole").select("root", "parts"), "root").select(
        "cls", F.hex("root").alias("unit"), "parts"
    )
    apart = (
        by_list.join(sized.filter("NOT whole").select("root"), "root")
        .join(list_size.select("root", "unit", "list_parts"), ["root", "unit"])
        .select("cls", F.concat_ws("/", F.hex("root"), "unit").alias("unit"), F.col("list_parts").alias("parts"))
    )
    wanted = grouped.select(F.xxhash64("first.doc_id", "first.text_hash").alias("row_key"))
    texts = rows.select(row_key, "text_hash", "text").join(wanted, "row_key", "left_semi")
    texts = texts.dropDuplicates(["row_key", "text_hash"]).select("text")
    sets = stored(texts.mapInArrow(lambda b: _set_task(b, width), "cls binary, shingles binary"))

    def similar(left, right):
        a = [np.frombuffer(x, np.uint64) for x in left]
        b = None if right is None else [np.frombuffer(x, np.uint64) for x in right]
        both = _intersections(a, b)
        na = np.array([len(x) for x in a])[:, None]
        nb = na.T if b is None else np.array([len(x) for x in b])[None, :]
        return (100 * both >= percent * (na + nb - both)) & (both > 0)

    members = stored(whole.union(apart))
    data = sets.select("cls", F.col("shingles").alias("data"))
    roots = components(_linked(members, data, similar))
    return sketches, stored(roots)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of `width`-word shingles have an intersection
    of at least `percent` hundredths of their union. component_id is the smallest
    doc_id that links reach, the document itself included, and `kept` marks it; so
    one document of each group stays. Null and empty texts are linked with nothing.
    Rows with a null doc_id take part; they are kept only where no other id is
    reached. Rows with equal doc_ids are judged by their own texts and marked alike.
    Ties cannot occur; extra columns are ignored; an empty table gives no rows.
    """
    sketches, roots = link(docs, width, percent)
    firsts = sketches.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    joined = firsts.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    joined = stored(joined.select("cls", "root", "first_id"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = stored(joined.join(least, "root").select("cls", "component_id"))
    found = sketches.select("doc_id", "n_shingles", "cls").join(placed, "cls", "left")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs` of each group of near duplicates, whole.

    Of a group the row of the smallest doc_id stays, of rows with equal ids that of the
    smallest text hash, and of wholly equal rows one; a row without an id only stays
    where its group has no other. Texts without words are linked with nothing: all such
    rows stay. Extra columns are carried along, of wholly equal ids and texts those of
    any one row.
    """
    sketches, roots = link(docs, width, percent)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    firsts = sketches.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(place).alias("first"))
    grouped = firsts.join(roots, F.col("cls") == F.col("node"), "left").groupBy(F.coalesce("root", "cls").alias("root"))
    chosen = grouped.agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    rows = sketches.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n"), F.max(F.col("cls").isNull()).alias("wordless")
    )
    same = rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["text_hash"] == chosen["text_hash"])
    # Keys grow with the documents: joined by sorting at every size.
    kept = rows.filter("NOT wordless").join(chosen.hint("merge"), same, "left_semi").unionByName(rows.filter("wordless"))
    kept = stored(kept)
    own_id, own_hash = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))

    def of(keys: DataFrame) -> DataFrame:
        here = own_id.eqNullSafe(F.col("_key_id")) & (own_hash == F.col("_key_hash"))
        keys = keys.select(F.col("doc_id").alias("_key_id"), F.col("text_hash").alias("_key_hash"))
        return docs.join(keys.hint("merge"), here, "left_semi")

    repeated = kept.filter("n > 1 AND NOT wordless")
    once = of(kept.filter("n = 1 OR wordless"))
    if not repeated.limit(1).count():
        return once
    # Only texts that come again under the same id are compared as rows.
    several = of(repeated).withColumns({"_key_id": own_id, "_key_hash": own_hash})
    return once.unionByName(several.dropDuplicates(["_key_id", "_key_hash"]).select(*docs.columns))
