import zlib

from eventmill.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, shard int, node int, tie string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def corpus(prose):
    rows = [(i, prose(i, 20 + (i * 13) % 200), ["en", "de", None][i % 3], f"src{i % 7}") for i in range(900)]
    rows += [(2000 + i, prose(1, 30), "en", f"src{i % 7}") for i in range(5)]
    rows += [(3000 + i, prose(2, 50), "en", "src0") for i in range(400)]  # a third of the rows is one text
    return rows + [(4000, None, None, None), (4001, "", "en", "x"), (None, "é", "fr", "y"), (5, "twice", "en", "z"), (5, "twice", "en", "z")]


def test_bytes_are_near_equal_and_slots_gapless(spark, prose):
    rows = corpus(prose)
    found = sharding.kd_tree(table(spark, rows), 24).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == want
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) == set(range(24))
    sums = [sum(r.size for r in x) for x in shards.values()]
    assert max(sums) - min(sums) < 0.25 * sum(sums) / 24
    for x in shards.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))


def test_light_groups_of_equal_texts_stay_together(spark, prose):
    rows = corpus(prose)
    found = sharding.kd_tree(table(spark, rows), 4).collect()
    assert len({r.shard for r in found if r.doc_id is not None and 2000 <= r.doc_id < 2005}) == 1
    assert len({r.shard for r in found if r.doc_id is not None and 3000 <= r.doc_id < 3400}) > 1


def test_reruns_and_partitionings_agree(spark, prose):
    docs = table(spark, corpus(prose))
    runs = [sorted(str(r) for r in sharding.kd_tree(d, 6).collect()) for d in (docs, docs.repartition(3))]
    assert runs[0] == runs[1]


def test_tiny_tables(spark):
    assert sharding.kd_tree(table(spark, []), 24).collect() == []
    one = sharding.kd_tree(table(spark, [(1, "a", "en", "s")]), 24).collect()
    assert len(one) == 1 and one[0].slot == 0 and 0 <= one[0].shard < 24
    same = sharding.kd_tree(table(spark, [(None, None, None, None)] * 10), 3).collect()
    assert sorted(r.slot for r in same if r.shard == same[0].shard) == list(range(sum(r.shard == same[0].shard for r in same)))


def test_columns_may_be_missing(spark):
    docs = spark.createDataFrame([(i, "a" * i) for i in range(40)], "doc_id long, text string")
    assert sharding.kd_tree(docs, 4).count() == 40
