import numpy as np
import pytest

from eventmill.llm import mixing

SCHEMA = "doc_id long, source string, text string, size int, block string, n_chars long"


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and left * weight[s] >= most * sizes[s] * total} if total else set()
        if not new:
            return {s: most * sizes[s] if s in capped else left * weight[s] / total for s in names}
        capped |= new


@pytest.fixture
def corpus(prose):
    sizes = {"a": 40, "b": 3, "é": 12, "B": 9, None: 6, "": 1}
    rows = [(100 * k + i, s, prose(100 * k + i, 5 + (i * 7) % 60)) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return rows + [(900, "a", None), (901, "a", ""), (None, "a", prose(3, 20)), (0, "a", prose(4, 11)), (0, "a", prose(4, 11))]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", len(r[2] or "")) for r in rows], SCHEMA)


def test_sources_meet_their_targets(spark, corpus):
    pieces = mixing.mix(table(spark, corpus), block_words=64, shard_blocks=4)
    found = mixing.taken(pieces).collect()
    assert len(found) == len(corpus)
    sizes = {}
    for _, source, text in corpus:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted = targets(sizes)
    for source, target in wanted.items():
        rows = [r for r in found if r.source == source]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[source] for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= 0.5 + 1e-6
    assert all(0 <= r.taken <= 3 * r.size for r in found)


def test_shards_are_even_and_disjoint(spark, corpus):
    pieces = mixing.mix(table(spark, corpus), block_words=64, shard_blocks=4).filter("epoch IS NOT NULL").collect()
    keys = [(r.row_key, r.epoch) for r in pieces]
    assert len(set(keys)) == len(keys)
    shards = {}
    for r in pieces:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) == set(range(len(shards)))
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len({(r.source, r.block) for r in rows}) <= 4
    owner = {}
    for r in pieces:
        assert owner.setdefault((r.source, r.block), r.shard) == r.shard


def test_reruns_and_partitionings_agree(spark, corpus):
    docs = table(spark, corpus)
    runs = [sorted(map(str, mixing.mix(d, block_words=64).collect())) for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1]


def test_splitting_tree_keeps_row_and_column_sums():
    quotas, shards = np.array([50, 0, 7, 1000]), np.array([300, 300, 300, 157])
    counts = mixing.split_quotas(quotas, shards, 1)
    assert (counts.sum(axis=1) == quotas).all() and (counts.sum(axis=0) == shards).all()
    assert abs(int(counts[3, 0]) - 1000 * 300 / 1057) < 40


def test_many_sources_are_split_in_buckets(spark, prose, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCE_BUCKET", 4)
    rows = [(i, f"s{i % 11:02}", prose(i, 30)) for i in range(66)]
    pieces = mixing.mix(table(spark, rows), block_words=32, shard_blocks=8)
    totals = {}
    for r in mixing.taken(pieces).collect():
        totals.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(n - target) <= 0.5 + 1e-6 for n, target in totals.values())


def test_drawn_documents(spark, prose):
    rows = [(i, f"s{i % 3}", prose(i, 10 + i)) for i in range(30)]
    docs = table(spark, rows)
    pieces = mixing.mix(docs, block_words=64)
    mixed = mixing.drawn(docs, pieces)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text) and rows[r.doc_id][2].startswith(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r.doc_id: r.taken for r in mixing.taken(pieces).collect() if r.taken}


def test_nothing_to_take(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    found = mixing.taken(mixing.mix(table(spark, [(1, "a", None), (2, None, "")]))).collect()
    assert [(r.size, r.taken) for r in found] == [(0, 0), (0, 0)]


def test_drawn_rows_are_the_takes_of_null_and_repeated_ids(spark):
    rows = [(i if i % 3 else None, f"w{i} " * 20, "ab"[i % 2]) for i in range(30)] + [(7, "same words " * 9, "a")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = mixing.mix(docs).persist()
    want = pieces.filter("epoch IS NOT NULL").groupBy("doc_id", "source").count().collect()
    found = mixing.drawn(docs, pieces).groupBy("doc_id", "source").count().collect()
    assert sorted(map(str, found)) == sorted(map(str, want)) and any(r.doc_id is None for r in want)
