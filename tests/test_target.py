"""The target as a log of segments, and the memory of landed pages."""

import os

import pytest
from pyspark.sql import functions as F

from eventmill.schema import RECORD_FIELDS
from eventmill.streaming import incremental, target

SOURCE = "source_ord int, name string, url string, parser string, kind string"


def events(spark, *titles, day="2031-03-09"):
    fields = {"partner": "P", "start_date": day, "kind": "event"}
    rows = [(t, *[fields.get(c, "") for c in RECORD_FIELDS if c != "title"]) for t in titles]
    rest = [c for c in RECORD_FIELDS if c != "title"]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["title", *rest])).select(*RECORD_FIELDS)


def kept(spark, path):
    return sorted(r.title for r in target.read_target(spark, path).collect())


def test_segments_are_merged_and_what_a_batch_lists_stays_flat(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(target, "MERGE", 2)
    path, folders = str(tmp_path), []
    for k in range(7):
        day = f"2031-{1 + k % 2:02d}-05"
        # One record of the batch before, in another case, and two new ones.
        known = [f"T{2 * k - 4}"] if k > 1 else []
        got = target.upsert(events(spark, f"t{2 * k}", f"t{2 * k + 1}", *known, day=day), path, k)
        assert tuple(got.first()) == (2, len(known))
        version = target.read_version(spark, path)
        folders.append(len(target.paths_of(path, version, [day[:7]])))
        assert sum(s.rows for s in version.segments) == 2 * k + 2
    assert kept(spark, path) == sorted(f"t{i}" for i in range(14))
    # 7 = 4 + 2 + 1 batches
    assert [s.level for s in version.segments] == [2, 1, 0]
    assert max(folders) <= 3
    on_disk = [f for f in os.listdir(path) if f.startswith("segment=")]
    assert len(on_disk) <= len(version.segments) + len(version.retired)


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(target, "VERSIONS", 2)
    for k in range(3):
        target.upsert(events(spark, f"t{k}"), str(tmp_path), k)
    left = sorted(f for f in os.listdir(tmp_path / "_log") if not f.startswith("."))
    assert left == ["1.json", "2.json", "last"]


def test_a_batch_run_again_is_told_its_first_counts(spark, tmp_path):
    path = str(tmp_path)
    assert tuple(target.upsert(events(spark, "a", "A", "b"), path, 7, "r").first()) == (2, 1)
    assert tuple(target.upsert(events(spark, "c"), path, 8, "r").first()) == (1, 0)
    assert tuple(target.upsert(events(spark, "a", "A", "b"), path, 7, "r").first()) == (2, 1)
    assert kept(spark, path) == ["A", "b", "c"]


def test_a_batch_that_fails_before_its_version_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    target.upsert(events(spark, "a"), path, 0)
    with monkeypatch.context() as broken:
        broken.setattr(target, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            target.upsert(events(spark, "b"), path, 1)
    assert kept(spark, path) == ["a"]
    assert tuple(target.upsert(events(spark, "b"), path, 1).first()) == (1, 0)
    assert kept(spark, path) == ["a", "b"]


def test_of_two_writers_the_later_one_sees_what_the_first_added(spark, tmp_path, monkeypatch):
    path, real, done = str(tmp_path), target.commit, []

    def late(session, where, version):
        if not done:  # the other writer comes in between
            done.append(1)
            target.upsert(events(spark, "a", "b"), path, 0, "other")
        return real(session, where, version)

    monkeypatch.setattr(target, "commit", late)
    assert tuple(target.upsert(events(spark, "B", "c"), path, 0, "mine").first()) == (1, 1)
    assert kept(spark, path) == ["a", "b", "c"]
    assert len([f for f in os.listdir(path) if f.startswith("segment=")]) == 2


def test_a_torn_version_is_no_version(spark, tmp_path):
    path = str(tmp_path)
    target.upsert(events(spark, "a"), path, 0)
    (tmp_path / "_log" / "1.json").write_text('{"number": 1, "seg')
    assert target.read_version(spark, path).number == 0
    assert kept(spark, path) == ["a"]


@pytest.mark.parametrize("most", [0, 1000])
def test_lookups_and_whole_key_columns_agree(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(target, "LOOKUP_KEYS", most)
    path = str(tmp_path)
    batches = [(None, (2, 0)), ("", (0, 2)), ("2031-02-01", (2, 0))]  # null and '' are one key
    for k, (day, counts) in enumerate(batches):
        assert tuple(target.upsert(events(spark, "a", "b", day=day), path, k).first()) == counts
    both = events(spark, "a", "c", day="").union(events(spark, "B", "d", day="2031-02-01"))
    assert tuple(target.upsert(both, path, 9).first()) == (2, 2)
    rows = target.read_target(spark, path)
    assert set(r.month[:4] for r in rows.select("month").distinct().collect()) == {"2031", "none"}


def test_small_batches_push_their_keys_to_the_files(spark, tmp_path):
    path = str(tmp_path)
    target.upsert(events(spark, *[f"t{i}" for i in range(50)]), path, 0)
    version = target.read_version(spark, path)
    fresh = target.keyed(events(spark, "T7", "new")).withColumns({"key_hash": target.key_hash(), "month": F.lit("2031-03")})
    known = target.known_keys(spark, path, version, fresh, 2)
    assert [r._k_low_title for r in known.collect()] == ["t7"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(key_hash" in plan


def test_a_page_landed_in_two_files_is_read_once(spark, tmp_path):
    registry = spark.createDataFrame([(0, "L", "https://l.org", "generic_links", None)], SOURCE)
    landing, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def land(*pages):
        rows = spark.createDataFrame(list(pages), incremental.PAGES_SCHEMA)
        rows.repartition(len(pages)).write.mode("append").parquet(landing)
        run = incremental.extract_stream(spark, landing, registry, out, progress, "2031-01-05T00:00:00+00:00")
        run.awaitTermination()
        counts = target.read_version(spark, out).counts.values()
        failed = incremental.read_failures(spark, out).count()
        return kept(spark, out), sum(a for a, _ in counts), sum(b for _, b in counts), failed

    page = "<a href='/x'>{} May 3</a>"
    fair, gone, lost = (1, "https://l.org", page.format("Fair")), (2, "https://u.org", "x"), (3, "https://l.org", None)
    assert land(fair, (9, *fair[1:]), gone, lost) == (["Fair"], 1, 0, 2)
    # After a restart the state still knows them; only the walk is worked off.
    assert land(fair, gone, lost, (4, "https://l.org", page.format("Walk"))) == (["Fair", "Walk"], 2, 0, 2)
