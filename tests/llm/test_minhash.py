import itertools
import random
import re

import numpy as np
import pytest

from eventmill.llm import minhash
from eventmill.llm.graph import components

SCHEMA = "doc_id long, text string, cls string, n int, unit string"


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[find(a)] = find(b)
    groups = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(sets[k][0])
    return sorted((sets[k][0], len(sets[k][1]), min(groups[find(k)])) for k in range(len(sets)))


def edited(text, number, edits):
    draw = random.Random(number)
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture
def corpus(prose):
    base = prose(1, 120)
    rows = [(k, prose(100 + k, 80)) for k in range(20)]
    rows += [(100 + k, edited(base, k, k % 9)) for k in range(60)]
    rows += [(200, base), (201, base), (202, base.upper()), (203, f"  {base}\n")]
    rows += [(300, ""), (301, None), (302, " \n"), (303, "two words"), (304, "Two  words"), (305, "one")]
    return rows


def test_links_are_those_of_all_pairs(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)  # hot lists and groups go by blocks
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in corpus], SCHEMA)
    found = minhash.near_duplicates(docs, 3, 85).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found)
    assert got == brute(corpus, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_null_ids_and_repeated_rows(spark, prose):
    text = prose(5, 40)
    rows = [(None, text), (7, text), (7, text), (7, prose(6, 40)), (None, prose(8, 30)), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(None, 7, False), (7, 7, True), (7, 7, True), (7, 7, True), (None, None, True), (None, None, True)], key=str
    )


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_document_of_each_group_stays(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in corpus], SCHEMA)
    left = minhash.without_near_duplicates(docs, 3, 85)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in brute(corpus, 3, 85)})


def test_signatures_agree_as_often_as_sets_do():
    draw = np.random.default_rng(1)
    shared, own = draw.integers(0, 1 << 63, 850, np.uint64), draw.integers(0, 1 << 63, 150, np.uint64)
    a = minhash.signature(np.unique(np.concatenate([shared, own[:75]])), 512)
    b = minhash.signature(np.unique(np.concatenate([shared, own[75:]])), 512)
    assert abs((a == b).mean() - 0.85) < 0.06


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)}
    assert len(found) == 71


def test_survivors_by_row(spark, prose):
    """Repeated rows, near copies under one id, and rows without ids: one row a group."""
    w, x, y = prose(1, 300), prose(2, 300), prose(3, 300)
    near = w + " extra"
    rows = [(1, w), (1, w), (2, near), (1, near), (None, w), (None, x), (None, y), (None, y), (7, ""), (7, ""), (None, None)]
    docs = spark.createDataFrame([(*r, k, 5, "c") for k, r in enumerate(rows)], "doc_id long, text string, row int, n int, cls string").repartition(3)
    left = minhash.without_near_duplicates(docs).collect()
    assert left[0].asDict().keys() == {"doc_id", "text", "row", "n", "cls"}
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted(
        [(1, w), (None, x), (None, y), (7, ""), (7, ""), (None, None)], key=str
    ) or sorted(((r.doc_id, r.text) for r in left), key=str) == sorted(
        [(1, near), (None, x), (None, y), (7, ""), (7, ""), (None, None)], key=str
    )
    assert minhash.without_near_duplicates(docs.limit(0)).collect() == []
