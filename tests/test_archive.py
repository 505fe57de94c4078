"""Archive files, deliveries and the table function of page elements."""

import gzip
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.functions.tables import register_tables
from eventmill.operators import shape
from eventmill.operators.tree import with_tree
from eventmill.sinks import delivery
from eventmill.sinks.delivery import deliver, read_deliveries
from eventmill.sources import archive
from eventmill.sources.archive import read_archive, save_archive
from eventmill.sources.manifest import manifests

SCHEMA = "page_id long, url string, html string, owner string"
ODD = [
    (1, "https://a.example/1", "<p>plain</p>", "x"),
    (None, None, None, None),
    (2, "https://a.example/2", "", "x"),
    (3, "", "Grüße 你好 \U0001f600\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n", "x"),
    (1, "https://a.example/1", "<p>plain</p>", "x"),
    (4, "  blanks around  ", "\r\n\r\n", "x"),
    (5, "https://a.example/long", "y" * 3_000_000, "x"),
]


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "url", "html").collect()), key=repr)


def test_archives_give_back_every_page(spark, tmp_path):
    pages = spark.createDataFrame(ODD, SCHEMA)
    path = str(tmp_path / "web")
    save_archive(pages.repartition(2), path, split_bytes=1000)
    assert rows_of(read_archive(spark, path)) == sorted([(i, u, h) for i, u, h, _ in ODD], key=repr)
    save_archive(pages.limit(1), path)
    assert read_archive(spark, path).count() == len(ODD) + 1
    save_archive(pages.limit(1), path, mode="overwrite")
    assert read_archive(spark, path).count() == 1


def test_an_empty_archive(spark, tmp_path):
    save_archive(spark.createDataFrame([], SCHEMA), str(tmp_path / "web"))
    assert read_archive(spark, str(tmp_path / "web")).collect() == []


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(400).selectExpr("id as page_id", "concat('https://a.example/', id) url", "repeat('z', 500) html")
    path = str(tmp_path / "web")
    save_archive(pages.coalesce(1), path, split_bytes=20_000)
    assert len([f for f in os.listdir(path) if f.endswith(".warc")]) == 1
    back = read_archive(spark, path).withColumn("task", F.spark_partition_id())
    assert back.select("task").distinct().count() > 10
    assert back.select("page_id").distinct().count() == back.count() == 400


def test_headers_travel_and_cannot_add_records(spark, tmp_path):
    path = str(tmp_path / "web")
    row = (1, "https://a.example/\r\nX: y", {"ETag": "a\nb", "Content-Encoding": "gzip"}, "t")
    save_archive(spark.createDataFrame([row], "page_id long, url string, headers map<string,string>, html string"), path)
    back = read_archive(spark, path).first()
    assert (back.url, back.html, back.headers["ETag"]) == ("https://a.example/%0D%0AX: y", "t", "a%0Ab")
    assert "Content-Encoding" not in back.headers


def test_archives_of_other_makers(spark, tmp_path):
    body = "caf\xe9".encode("latin-1")
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + body
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Target-URI: http://b.example/\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n"
    info = record % (b"warcinfo", 4, b"a: b")
    (tmp_path / "crawl.warc.gz").write_bytes(
        gzip.compress(info) + gzip.compress(record % (b"response", len(content), content))
    )
    (tmp_path / "other.warc").write_bytes(info + record % (b"response", len(content), content))
    assert rows_of(read_archive(spark, str(tmp_path))) == [(None, "http://b.example/", "café")] * 2


def test_a_torn_archive_is_an_error():
    import io

    record = archive.record_bytes(1, "u", None, "text")
    with pytest.raises(ValueError, match="ends within"):
        list(archive.read_records(io.BytesIO(record[:-6])))
    with pytest.raises(ValueError, match="no archive record"):
        list(archive.read_records(io.BytesIO(b"junk\n" + record)))


def test_deliveries_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100).selectExpr("id", "cast(id as string) as body").repartition(3)
    deliver(rows, path, "2026-06-11")
    deliver(rows.limit(7), path, "2026-06-11")
    deliver(rows.limit(3), path, "2026-06-12")
    by_day = {r["delivery"]: r["count"] for r in read_deliveries(spark, path).groupBy("delivery").count().collect()}
    assert by_day == {"2026-06-11": 7, "2026-06-12": 3}


def test_a_task_that_is_run_again_leaves_no_row_twice(spark, tmp_path):
    """The first attempt writes its whole file, but dies before the job hears of it."""
    path, batch = str(tmp_path / "out"), pa.record_batch({"id": pa.array([1, 2, 3])})
    schema = T.StructType([T.StructField("id", T.LongType())])
    writer = delivery._Writer(path, "day", schema)
    writer.write(iter([batch]))
    again = writer.write(iter([batch]))
    assert len(os.listdir(f"{path}/data")) == 2
    writer.commit([again, writer.write(iter([]))])
    assert sorted(r.id for r in read_deliveries(spark, path).collect()) == [1, 2, 3]
    pages = str(tmp_path / "web")
    writer = archive._Writer(pages, 100, False)
    row = {"page_id": 1, "url": "u", "headers": None, "html": "t"}
    writer.write(iter([row]))
    writer.commit([writer.write(iter([row]))])
    assert rows_of(read_archive(spark, pages)) == [(1, "u", "t")]


def test_a_job_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    deliver(spark.range(4), path, "day")
    bad = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        deliver(bad, path, "day")
    assert sorted(r.id for r in read_deliveries(spark, path).collect()) == [0, 1, 2, 3]
    assert list(manifests(path)) == ["day"]


def test_empty_and_unknown_deliveries(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        read_deliveries(spark, path)
    deliver(spark.createDataFrame([], "a int, b string"), path, "none")
    assert read_deliveries(spark, path, "none").columns == ["a", "b", "delivery"]
    with pytest.raises(ValueError):
        deliver(spark.range(1), path, "../up")


def test_elements_by_sql_are_those_of_the_columns(spark):
    pages = [(1, "<div class=' a b '><p id=x>t<br>u</p></div><a href='/1' class>n</a>"), (2, None), (3, ""), (4, "no tag")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    df.createOrReplaceTempView("sql_pages")
    register_tables(spark)
    got = spark.sql("SELECT p.page_id, e.* FROM sql_pages p, LATERAL page_elements(p.html) e")
    want = shape.elements(with_tree(df))
    assert set(got.columns) == set(want.columns)
    key = lambda df: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())
    assert key(got.select(*want.columns)) == key(want)
    with pytest.raises(Exception, match="reads text"):
        spark.sql("SELECT * FROM page_elements(5)").collect()
