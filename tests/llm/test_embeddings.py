import itertools

import numpy as np
import pytest

from eventmill.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, cls string, copies int"


def brute(rows, limit):
    def unit(x, label):
        if label is None or x is None or not x or None in x:
            return None
        x = np.array(x, np.float64)
        norm = np.linalg.norm(x)
        return x / norm if np.isfinite(norm) and norm else None

    units = [unit(np.float32(x).tolist() if x and None not in x else x, label) for _, x, label in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = units[a], units[b]
        if x is None or y is None or len(x) != len(y) or rows[a][2] != rows[b][2]:
            continue
        if x @ y >= limit:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted((rows[k][0], links[k], min(groups[find(k)])) for k in range(len(rows)))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def planted(n_groups=12, size=6, dims=16, spread=0.07):
    draw = np.random.default_rng(2)
    rows = []
    for g in range(n_groups):
        centre = draw.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            x = centre + draw.normal(size=dims) * spread
            rows.append((len(rows), x.tolist(), int(g % 3)))
    return rows


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    monkeypatch.setattr(embeddings, "CENTRE_ROWS", 12)
    rows = planted()
    found = embeddings.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == brute(rows, 0.93)


def test_dense_balls_are_counted(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "HUB_ROWS", 20)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    rows = planted(6, 8) + [(1000 + i, x, 0) for i, (_, x, _) in enumerate(planted(1, 90, spread=0.03))]
    rows += [(2000 + i, x, 0) for i, (_, x, _) in enumerate(planted(1, 30, spread=0.07))]
    found = embeddings.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == brute(rows, 0.93)


def test_vectors_without_direction_are_alone(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1),
        (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [1.0, 0.0, 0.0], 1),
        (11, [None, 1.0], 1), (2, [2.0, 0.0], 1),
    ]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table(spark, rows)).collect()}
    alone = {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)}
    assert got == alone | {(1, 2, 1, True), (2, 2, 1, False)}


def test_empty_table(spark):
    assert embeddings.near_duplicates(table(spark, [])).collect() == []


def test_range_search_reaches_every_neighbour():
    x = np.array([r[1] for r in planted(20, 10)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, start = embeddings.build_graph(x), embeddings.medoid(x)
    embeddings.connect(x, graph, start)
    arrays = embeddings.lists_of(graph)
    exact = x @ x.T >= 0.93
    found = [embeddings.range_search(x, arrays, np.array([start]), x[k], 0.93, beam=8) for k in range(len(x))]
    assert all(exact[k, f].all() for k, f in enumerate(found))
    assert sum(map(len, found)) / exact.sum() >= 0.99
    assert max(len(g) for g in graph) <= 2 * embeddings.DEGREE + len(x)


def test_audit(spark):
    rows = planted()
    vectors = table(spark, rows)
    assert embeddings.audit_recall(vectors, embeddings.near_duplicates(vectors), every=3).first().recall >= 0.9


def loose(n, dims=24, cosine=0.95, seed=6):
    """One isotropic cluster without a dense middle, among as many scattered vectors."""
    draw = np.random.default_rng(seed)
    noise = draw.normal(size=(n, dims))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    rows = np.eye(dims)[0] * np.sqrt(cosine) + noise * np.sqrt(1 - cosine)
    return [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate([rows, draw.normal(size=(n, dims))]))]


def test_a_loose_cluster_keeps_all_its_links(spark, monkeypatch):
    # Many centres for few rows, as a hot label has them.
    monkeypatch.setattr(embeddings, "CENTRE_ROWS", 8)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 64)
    monkeypatch.setattr(embeddings, "QUERY_ROWS", 50)
    rows = loose(200)
    found = embeddings.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == brute(rows, 0.93)


def test_linked_vectors_have_a_common_shard():
    draw = np.random.default_rng(5)
    for cosine in (0.9, 0.95, 0.97):
        x = np.array([r[1] for r in loose(400, cosine=cosine)])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = embeddings.near_shards(x, x[draw.permutation(len(x))[:60]], 0.93)
        assert not ((x @ x.T >= 0.93) & (near.astype(int) @ near.T == 0)).any()


def united_search(rows, limit=0.93):
    """Shards, united lists and searches of one label without Spark; links found, and looked at."""
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    drawn = x[np.random.default_rng(1).permutation(len(x))[: embeddings.SAMPLE // 10]]
    model = embeddings.fit({(0, x.shape[1]): drawn}, {(0, x.shape[1]): len(x)}, limit)
    centres, regions, parts, hubs = model[0, x.shape[1]]
    assert len(regions) == parts == 1
    builds = np.argsort(-(x @ centres.T), axis=1)[:, : embeddings.OVERLAP]
    near, medoids = [set() for _ in x], []
    for c in range(len(centres)):
        own = np.flatnonzero((builds == c).any(axis=1))
        for part in np.array_split(own, -(-len(own) // embeddings.BLOCK_ROWS)) if len(own) else []:
            graph = embeddings.build_graph(x[part])
            medoids.append(part[embeddings.medoid(x[part])])
            for k, found in zip(part, graph, strict=True):
                near[k].update(part[found].tolist())
    graph = embeddings.lists_of([sorted(n) for n in near])
    starts = embeddings.starts_of(x, graph, np.array(medoids))
    return x, graph, starts


@pytest.mark.parametrize("n", [1500, 5000])
def test_recall_and_work_of_large_labels(n, monkeypatch):
    """Pairs of near vectors among scattered ones: one in ten of a label is linked."""
    draw = np.random.default_rng(n)
    x = draw.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    twins = np.arange(n // 10)
    noise = draw.normal(size=(len(twins), 64))
    x[twins + n // 2] = x[twins] + 0.36 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    x, graph, starts = united_search([(i, v, 0) for i, v in enumerate(x)])
    exact = x[twins] @ x.T >= 0.93
    found = [embeddings.range_search(x, graph, starts, x[k], 0.93) for k in twins]
    assert all(exact[k, f].all() for k, f in enumerate(found))
    assert sum(map(len, found)) >= 0.98 * exact.sum() > 1.5 * len(twins)


def test_regions_and_parts_lose_no_link(spark, monkeypatch):
    """A label beyond one united graph: scattered vectors, without any grouping, in several parts."""
    monkeypatch.setattr(embeddings, "REGION_ROWS", 100)
    monkeypatch.setattr(embeddings, "QUERY_ROWS", 64)
    monkeypatch.setattr(embeddings, "CENTRE_ROWS", 40)
    rows = loose(120) + [(1000 + r[0], r[1], 0) for r in planted(40, 3, dims=24, spread=0.03)]
    found = embeddings.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == brute(rows, 0.93)
