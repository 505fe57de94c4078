"""Embedding near-dedup on a robust-pruned flat graph.

Vectors of one label are dealt to the shards of their OVERLAP nearest centres. Every
shard builds a graph whose adjacency lists are robust-pruned (an edge goes if a kept
neighbour is closer to its end by a factor); the lists that a vector has in its shards
are united, which joins the shards' graphs to one. Every vector is then searched on the
united graph: a beam starts from the medoids of all shards at once and closes in
greedily, and from what it has reached the range is expanded: vectors within the limit,
and some way beyond, pass the search on. Found pairs are verified by their cosine in
double precision. Searches go in blocks, each beside the whole united graph.

A label whose graph is too large for that is searched by regions: a vector is in that of
the nearest of some centres, and in every other whose boundary with it is within half
the limit's distance. Of two linked vectors with different nearest centres, one is that
close to the boundary between these, so every linked pair has a region in common. A
region that no centres make small (vectors without any grouping) has its vectors in
several parts with a graph each, and is searched in all of them.

Groups so dense that most of a shard would be one of them are taken out first, by hubs: two vectors
within half the limit's angle of one hub are linked for certain (triangle
inequality), so such a ball is counted, not compared. Only vectors in the shell
around it, out to one and a half times that angle, meet its members, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.llm.graph import components
from eventmill.session import stored

#: Vectors that the cluster centres and hubs are fitted on, at most (documented bound).
SAMPLE = 8192
#: Vectors per centre.
CENTRE_ROWS = 512
#: Centres whose shards a vector is built into.
OVERLAP = 3
#: Vectors in one block of a unit of work, on average at most.
BLOCK_ROWS = 1024
#: Vectors of one united graph, and searches beside it, on average at most.
REGION_ROWS = 1 << 16
QUERY_ROWS = 8192
#: Best vectors that a search keeps in view, and of these passes on at a time.
BEAM = 64
WIDTH = 8
#: A ball of more members is counted instead of compared.
HUB_ROWS = 512
DEGREE = 24
POOL = 96
ALPHA = 1.2


def _unit_task(batches: Iterator[pa.RecordBatch]):
    """(vec_id, label, cls, vector): unit vectors as bytes; null where there is no direction."""
    for batch in batches:
        names, vectors = [], []
        for label, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = None
            if label is not None and value.is_valid and None not in (values := value.as_py()):
                x = np.asarray(values, np.float64)
                if not len(x) or not np.isfinite(x).all() or not (peak := np.abs(x).max()):
                    x = None
            if x is None:
                names.append(None)
                vectors.append(None)
                continue
            x = x / peak  # neither huge nor tiny components lose the norm
            x = x / np.sqrt(x @ x)
            data = x.tobytes()
            vectors.append(data)
            names.append(xxhash.xxh3_128_digest(data + str(label).encode()))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(vectors, pa.binary())],
            names=["vec_id", "label", "cls", "vector"],
        )


def _matrix(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def near_shards(x: np.ndarray, centres: np.ndarray, limit: float) -> np.ndarray:
    """Which centres' shards every unit vector belongs to, as booleans per vector and centre."""
    sims = x @ centres.T
    best = sims.argmax(axis=1)
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centres[best] @ centres.T))
    # Distance to the boundary between the nearest centre and another, times their gap.
    beyond = sims[np.arange(len(x)), best][:, None] - sims
    near = beyond <= gaps * math.sqrt(max(0.0, 2 - 2 * limit)) / 2 + 1e-9
    near[np.arange(len(x)), best] = True
    return near


def _thinned(x: np.ndarray, centres: np.ndarray, limit: float, count: int) -> np.ndarray:
    """As many of the centres as make the least work of `count` vectors.

    Centres within the limit of another go, as they would cut a cluster up; of the
    rest, halved again and again, the number with the smallest shards in all is taken.
    """
    left = np.ones(len(centres), bool)
    for i in range(len(centres)):
        if left[i]:
            left[i + 1 :] &= centres[i + 1 :] @ centres[i] < limit
    centres = centres[left]
    best, least = centres[:1], math.inf
    while True:
        rows = near_shards(x, centres, limit).mean(axis=0) * count
        work = float((rows * (1 + rows / REGION_ROWS)).sum())
        if work < least:
            best, least = centres, work
        if len(centres) == 1:
            return best
        centres = centres[: len(centres) // 2]


def fit(sample: dict, counts: dict, limit: float) -> dict:
    """Per (label, dimension), from sampled unit vectors: the centres of shards and of
    regions, the number of parts of a region, and hubs."""
    near = math.cos(math.acos(limit) / 2)
    out = {}
    for key, x in sample.items():
        rng = np.random.default_rng(3)
        k = int(min(max(1, counts[key] // CENTRE_ROWS), max(1, len(x) // 8), 1024))
        centres = x[rng.permutation(len(x))[:k]]
        for _ in range(4):
            best = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, best, x)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
        regions = _thinned(x, centres, limit, counts[key])
        largest = near_shards(x, regions, limit).mean(axis=0).max() * counts[key]
        parts = max(1, math.ceil(largest / REGION_ROWS))
        # Hubs: sampled vectors whose ball holds many others, the fullest first.
        share = len(x) / counts[key]
        wanted = max(8, HUB_ROWS * share)
        hubs, left = [], np.ones(len(x), bool)
        if counts[key] > HUB_ROWS:
            hits = np.zeros(len(x), np.int64)
            for at in range(0, len(x), 1024):
                hits[at : at + 1024] = (x[at : at + 1024] @ x.T >= near).sum(axis=1)
            while True:
                first = int(np.where(left, hits, 0).argmax())
                if not left[first] or hits[first] < wanted:
                    break
                covered = x @ x[first] >= near
                if (covered & left).sum() >= wanted:
                    hubs.append(x[first])
                left &= ~covered
                left[first] = False
        out[key] = (centres, regions, parts, np.array(hubs).reshape(len(hubs), x.shape[1]))
    return out


_DEALT = (
    "cls binary, label long, vector binary, copies long, ball int, builds array<int>, part int, parts int, "
    "shards array<int>, shells array<int>"
)


def _deal_task(batches: Iterator[pa.RecordBatch], model: dict, limit: float):
    """Of each class its ball, the shards that build it, its part and its regions; and the balls in whose shell it is."""
    angle = math.acos(limit)
    near, far = math.cos(angle / 2) + 1e-9, math.cos(1.5 * angle) - 1e-9
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for batch in batches:
        out = [[] for _ in kinds]
        for name, label, data in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            x = np.frombuffer(data, np.float64)
            none = np.empty((0, len(x)))
            centres, regions, parts, hubs = model.get((label, len(x)), (none, none, 1, none))
            to_hubs = hubs @ x
            ball = int(to_hubs.argmax()) if len(hubs) and to_hubs.max() >= near else None
            reach = np.flatnonzero(to_hubs >= far).tolist()
            builds = np.argsort(-(centres @ x), kind="stable")[:OVERLAP].tolist() if len(centres) else [0]
            row = (
                ball,
                builds,
                xxhash.xxh3_64_intdigest(name, 1) % parts,
                parts,
                np.flatnonzero(near_shards(x[None], regions, limit)[0]).tolist() if len(regions) else [0],
                # Of two balls, the members of the later one are the shell of the earlier.
                [h for h in reach if ball is None or h < ball],
            )
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.record_batch(
            [*batch.columns, *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
            names=[f.split()[0] for f in _DEALT.split(", ")],
        )


def robust_prune(sims: np.ndarray, distances: np.ndarray, pool: np.ndarray, degree: int = DEGREE) -> list[int]:
    """Neighbours of one vector: the closest of the pool, dropping what a kept one covers.

    `pool` holds positions ordered by falling similarity, `sims` theirs to the vector, and
    `distances` all pairwise distances.
    """
    kept, left = [], np.ones(len(pool), bool)
    own = np.sqrt(np.maximum(0, 2 - 2 * sims))
    at = 0
    while at < len(pool) and len(kept) < degree:
        if left[at]:
            kept.append(int(pool[at]))
            left &= ALPHA * distances[pool[at], pool] > own
        at += 1
    return kept


def build_graph(x: np.ndarray) -> list[list[int]]:
    """Robust-pruned adjacency lists of a block, all of it reachable from its medoid."""
    sims = x @ x.T
    distances = np.sqrt(np.maximum(0, 2 - 2 * sims))
    n = len(x)
    width = min(n - 1, POOL)
    graph = []
    for i in range(n):
        row = sims[i].copy()
        row[i] = -2
        pool = np.argpartition(-row, width - 1)[:width] if 0 < width < n - 1 else np.delete(np.arange(n), i)
        pool = pool[np.argsort(-row[pool], kind="stable")]
        graph.append(robust_prune(row[pool], distances, pool))
    for i, found in enumerate([list(g) for g in graph]):
        for j in found:
            if i not in graph[j] and len(graph[j]) < 2 * DEGREE:
                graph[j].append(i)
    return graph


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def _reach(graph: list[list[int]], start: int, seen: np.ndarray) -> None:
    seen[start] = True
    front = [start]
    while front:
        front = [j for i in front for j in graph[i] if not seen[j] and not seen.__setitem__(j, True)]


def connect(x: np.ndarray, graph: list[list[int]], start: int) -> None:
    """Link parts that the medoid cannot reach to the closest reachable vector."""
    seen = np.zeros(len(x), bool)
    _reach(graph, start, seen)
    while not seen.all():
        lost = int(np.flatnonzero(~seen)[0])
        inside = np.flatnonzero(seen)
        gate = int(inside[(x[inside] @ x[lost]).argmax()])
        graph[gate].append(lost)
        graph[lost].append(gate)
        _reach(graph, lost, seen)


def lists_of(graph: list[list[int]]) -> list[np.ndarray]:
    return [np.array(g, np.int64) for g in graph]


def range_search(
    x: np.ndarray, graph: list[np.ndarray], starts: np.ndarray, target: np.ndarray, limit: float, beam: int = BEAM
) -> np.ndarray:
    """Positions within `limit` of the target, found along the graph from `starts`.

    The beam passes on the best vectors it has seen until it has passed on all of the
    `beam` best. Then the range expands through vectors up to twice the limit's distance.
    """
    sims = np.full(len(x), -2.0)
    done = np.zeros(len(x), bool)
    best = np.unique(starts)
    sims[best] = x[best] @ target

    def pass_on(front: np.ndarray) -> np.ndarray:
        done[front] = True
        new = np.unique(np.concatenate([graph[i] for i in front.tolist()]))
        new = new[sims[new] == -2.0]
        sims[new] = x[new] @ target
        return new

    def top(of: np.ndarray, n: int) -> np.ndarray:
        return of if len(of) <= n else of[np.argpartition(-sims[of], n - 1)[:n]]

    while True:
        best = top(best, beam)
        front = top(best[~done[best]], WIDTH)
        if not len(front):
            break
        best = np.concatenate([best, pass_on(front)])
    slack = 1 - min(1.9, 4 * (1 - limit))
    front = np.flatnonzero(sims >= slack)
    while len(front := front[~done[front]]):
        new = pass_on(front)
        front = new[sims[new] >= slack]
    return np.flatnonzero(sims >= limit)


def starts_of(x: np.ndarray, graph: list[np.ndarray], medoids: np.ndarray) -> np.ndarray:
    """The medoids, and one vector of each part of the graph that they do not reach."""
    seen = np.zeros(len(x), bool)
    starts = medoids.tolist()
    front = np.unique(medoids)
    while True:
        seen[front] = True
        while len(front):
            new = np.unique(np.concatenate([graph[i] for i in front.tolist()]))
            front = new[~seen[new]]
            seen[front] = True
        if seen.all():
            return np.array(starts, np.int64)
        front = np.flatnonzero(~seen)[:1]
        starts.append(int(front[0]))


class _Block:
    """Rows of one unit of work: a shard's, or a block or two of it."""

    def __init__(self, rows: list[tuple]):
        self.names = [r[0] for r in rows]
        self.sides = np.array([r[1] for r in rows])
        self.x = _matrix([r[2] for r in rows])
        self.rest = [r[3:] for r in rows]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, _Block]]:
    """Runs of rows with equal (unit, i, j); the columns after them are cls, side, vector, ..."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True):
            if row[:3] != now:
                if rows:
                    yield now, _Block(rows)
                now, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield now, _Block(rows)


def _build_task(batches: Iterator[pa.RecordBatch]):
    for _, block in _blocks(batches):
        graph = build_graph(block.x) if len(block.x) > 1 else [[]]
        start = medoid(block.x)
        connect(block.x, graph, start)
        yield pa.record_batch(
            [
                pa.array(block.names, pa.binary()),
                pa.array([[block.names[j] for j in found] for found in graph], pa.list_(pa.binary())),
                pa.array([k == start for k in range(len(graph))], pa.bool_()),
            ],
            names=["cls", "near", "medoid"],
        )


def _stars(pairs: list[tuple[int, int]], names: list[bytes]) -> tuple[list, list]:
    """A spanning forest of the pairs."""
    up = list(range(len(names)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    a, b = [], []
    for i, j in pairs:
        ri, rj = find(i), find(j)
        if ri != rj:
            up[ri] = rj
            a.append(names[i])
            b.append(names[j])
    return a, b


def _found(names: list, counts: np.ndarray, a: list, b: list) -> pa.RecordBatch:
    """Counts of links per class, as (cls, n, null), and forest edges, as (cls, 0, other)."""
    some = np.flatnonzero(counts).tolist()
    return pa.record_batch(
        [
            pa.array([names[i] for i in some] + a, pa.binary()),
            pa.array([int(counts[i]) for i in some] + [0] * len(a), pa.int64()),
            pa.array([None] * len(some) + b, pa.binary()),
        ],
        names=["cls", "n", "other"],
    )


def _search_task(batches: Iterator[pa.RecordBatch], limit: float):
    """Links of a block of vectors (side 1) with those of a united graph (side 0)."""
    for (unit, _, _), block in _blocks(batches):
        shard = int(unit.rsplit("/", 1)[1])
        base, asking = (np.flatnonzero(block.sides == k) for k in (0, 1))
        if not len(base) or not len(asking):
            continue
        x = block.x[base]
        names = [block.names[k] for k in base.tolist()]
        place = {name: k for k, name in enumerate(names)}
        rest = [block.rest[k] for k in base.tolist()]
        graph = lists_of([[place[n] for n in near or [] if n in place] for _, _, near, _ in rest])
        starts = starts_of(x, graph, np.flatnonzero([bool(first) for *_, first in rest]))
        copies = np.array([c for c, *_ in rest])
        # A pair counts in one of the regions that it shares: the first.
        lowest = np.array([min(s) for _, s, *_ in rest])
        counts, pairs = np.zeros(len(block.names), np.int64), []
        for k in asking.tolist():
            found = range_search(x, graph, starts, block.x[k], limit)
            found = found[found != place.get(block.names[k], -1)]
            own = set(block.rest[k][1])
            if len(found) and (min(own) < shard or (lowest[found] < shard).any()):
                first = [not any(s < shard and s in own for s in rest[f][1]) for f in found.tolist()]
                found = found[np.array(first, bool)]
            counts[k] = copies[found].sum()
            pairs += [(k, int(base[f])) for f in found]
        yield _found(block.names, counts, *_stars(pairs, block.names))


def _shell_task(batches: Iterator[pa.RecordBatch], limit: float):
    for _, block in _blocks(batches):
        members, shell = np.flatnonzero(block.sides == 0), np.flatnonzero(block.sides == 1)
        if not len(members) or not len(shell):
            continue
        linked = block.x[members] @ block.x[shell].T >= limit
        copies = np.array([r[0] for r in block.rest])
        counts = np.zeros(len(block.names), np.int64)
        counts[members] = linked @ copies[shell]
        counts[shell] = linked.T @ copies[members]
        # All members are one component, so one link of each shell vector is enough.
        pairs = [(int(shell[s]), int(members[linked[:, s].argmax()])) for s in np.flatnonzero(linked.any(axis=0))]
        yield _found(block.names, counts, *_stars(pairs, block.names))


def near_duplicates(vectors: DataFrame, limit: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors are linked if their labels are equal and their cosine is at least `limit`.
    n_links counts other vectors linked directly, component_id is the smallest vec_id
    that links reach, the vector's own included, and `kept` marks it. Vectors that are null, empty, zero, or hold null or
    non-finite components, and those with a null label, are linked with nothing;
    so are vectors of different lengths with each other. Equal vectors are
    compared once and counted as often as they come. Rows with a null vec_id take part and are kept
    only where no other id is reached. Extra columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    units = stored(
        rows.mapInArrow(_unit_task, "vec_id long, label long, cls binary, vector binary")
    )
    classes = stored(
        units.filter("cls IS NOT NULL")
        .groupBy("cls", "label", "vector")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    )
    size = (F.octet_length("vector") / 8).cast("int")
    totals = classes.groupBy("label", size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))
    # The model covers the largest groups, `sample` / 8 of them; each of the others is one shard.
    counts = {(r["label"], r["size"]): r["n"] for r in totals.limit(max(1, sample // 8)).collect()}
    rate = min(1.0, sample / max(1, sum(counts.values())))
    drawn = classes.filter(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    picked: dict = {}
    for r in drawn.select("label", "vector").limit(2 * sample).collect():
        picked.setdefault((r["label"], len(r["vector"]) // 8), []).append(bytes(r["vector"]))
    model = fit({k: _matrix(v) for k, v in picked.items() if k in counts}, counts, limit)
    dealt = stored(
        classes.select("cls", "label", "vector", "copies").mapInArrow(
            lambda b: _deal_task(b, model, limit),
            _DEALT,
        )
    )
    group = F.concat_ws("/", F.col("label"), F.octet_length("vector"))

    # What is in no ball is built into shards, a block at a time, and its lists united.
    def in_units(df: DataFrame) -> DataFrame:
        return df.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "side", "cls")

    free = dealt.filter("ball IS NULL").withColumn("group", group)
    built = free.select("group", "part", "cls", "vector", F.explode("builds").alias("build"))
    built = built.withColumn("unit", F.concat_ws("/", "group", "part", "build"))
    blocks = built.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    built = built.join(blocks, "unit").select(
        "unit", block.alias("i"), block.alias("j"), "cls", F.lit(0).alias("side"), "vector"
    )
    lists = in_units(built).mapInArrow(_build_task, "cls binary, near array<binary>, medoid boolean")
    united = lists.groupBy("cls").agg(  # OVERLAP lists at most
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid")
    )
    lists = stored(free.join(united, "cls").withColumn("shard", F.explode("shards")))
    lists = lists.withColumn("unit", F.concat_ws("/", "group", "shard"))
    # Searched in blocks (i), each beside the united graph of one part (j) of its region.
    asked = lists.groupBy("unit").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("asked"))
    query = F.pmod(F.xxhash64("cls", F.lit(2)), F.col("asked")).cast("int")
    placed = lists.join(asked, "unit")
    base = placed.select(
        "unit", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("i"), F.col("part").alias("j"),
        "cls", F.lit(0).alias("side"), "vector", "copies", "shards", "near", "medoid",
    )
    asking = placed.select(
        "unit", query.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"),
        "cls", F.lit(1).alias("side"), "vector", "copies", "shards",
        F.lit(None).cast("array<binary>").alias("near"), F.lit(False).alias("medoid"),
    )
    searched = in_units(base.unionByName(asking)).mapInArrow(
        lambda b: _search_task(b, limit), "cls binary, n long, other binary"
    )

    # Balls: members are linked with each other; the shell meets them block by block.
    members = dealt.filter("ball IS NOT NULL").withColumn("unit", F.concat_ws("/", group, F.col("ball")))
    balls = stored(
        members.groupBy("unit").agg(
            F.sum("copies").alias("all"), F.count("*").alias("n"), F.min("cls").alias("root")
        )
    )
    shell = dealt.withColumn("shell", F.explode("shells")).withColumn("unit", F.concat_ws("/", group, F.col("shell")))
    shell_size = shell.groupBy("unit").agg(F.count("*").alias("n_shell"))
    sized = stored(
        balls.join(shell_size, "unit").select(
            "unit",
            F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("rows"),
            F.ceil(F.col("n_shell") / BLOCK_ROWS).cast("int").alias("columns"),
        )
    )

    def side(df: DataFrame, number: int) -> DataFrame:
        own, across = ("rows", "columns") if number == 0 else ("columns", "rows")
        block = F.pmod(F.xxhash64("cls"), F.col(own)).cast("int")
        placed = df.join(sized, "unit").withColumn("block", block)
        placed = placed.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col(across) - 1)))
        i, j = ("block", "meets") if number == 0 else ("meets", "block")
        return placed.select(
            "unit", F.col(i).alias("i"), F.col(j).alias("j"), "cls", F.lit(number).alias("side"), "vector", "copies"
        )

    met = in_units(side(members, 0).unionByName(side(shell, 1))).mapInArrow(
        lambda b: _shell_task(b, limit), "cls binary, n long, other binary"
    )
    in_ball = members.select("cls", "copies", "unit").join(balls.select("unit", "all", "root"), "unit")
    inner = in_ball.select("cls", (F.col("all") - F.col("copies")).alias("n"), F.col("root").alias("other"))
    found = stored(searched.unionByName(met).unionByName(inner))

    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    placed = (
        classes.select("cls", "copies", "first_id")
        .join(links, "cls", "left")
        .join(roots, F.col("cls") == F.col("node"), "left")
        .select(
            "cls",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "cls").alias("root"),
            "first_id",
        )
    )
    placed = stored(placed)
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = stored(placed.join(least, "root").select("cls", "n_links", "component_id"))
    return (
        units.select("vec_id", "cls")
        .join(placed, "cls", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def _audit_task(batches: Iterator[pa.RecordBatch], limit: float):
    for _, block in _blocks(batches):
        rows, queries = np.flatnonzero(block.sides == 0), np.flatnonzero(block.sides == 1)
        if len(rows) and len(queries):
            counts = (block.x[rows] @ block.x[queries].T >= limit).sum(axis=0)
            yield pa.record_batch(
                [pa.array([block.names[q] for q in queries.tolist()], pa.int64()), pa.array(counts, pa.int64())],
                names=["vec_id", "n"],
            )


def audit_recall(vectors: DataFrame, found: DataFrame, limit: float = 0.93, every: int = 20) -> DataFrame:
    """One row: n_queries, exact_links, found_links and recall of `near_duplicates`' result.

    Vectors whose id is divisible by `every` are compared with all vectors of their
    label, block by block. vec_ids are to be unique and not null here.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    units = stored(rows.mapInArrow(_unit_task, "vec_id long, label long, cls binary, vector binary"))
    units = units.filter("cls IS NOT NULL").withColumn("unit", F.concat_ws("/", "label", F.octet_length("vector")))
    asked = units.filter(F.col("vec_id") % every == 0)

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))

    sized = stored(parts(units, "rows").join(parts(asked, "columns"), "unit"))

    def side(df: DataFrame, number: int) -> DataFrame:
        own, across = ("rows", "columns") if number == 0 else ("columns", "rows")
        placed = df.join(sized, "unit").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
        placed = placed.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col(across) - 1)))
        i, j = ("block", "meets") if number == 0 else ("meets", "block")
        return placed.select("unit", F.col(i).alias("i"), F.col(j).alias("j"), "vec_id", F.lit(number).alias("side"), "vector")

    met = side(units, 0).unionByName(side(asked, 1)).repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    exact = met.mapInArrow(lambda b: _audit_task(b, limit), "vec_id long, n long").groupBy("vec_id").agg(
        (F.sum("n") - 1).alias("exact")  # without the query itself
    )
    sums = exact.join(found.select("vec_id", "n_links"), "vec_id").agg(
        F.count("*").alias("n_queries"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_links"),
        F.coalesce(F.sum("n_links"), F.lit(0)).alias("found_links"),
    )
    return sums.withColumn("recall", F.coalesce(F.try_divide("found_links", "exact_links"), F.lit(1.0)))
