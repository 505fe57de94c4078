"""Settings, stored tables and bucketed pages."""

import pytest
from pyspark.sql import functions as F

from eventmill.plans.scrape import source_pages
from eventmill.session import SETTINGS, shared_folder, stored, use_settings
from eventmill.sources.pages import save_bucketed


def test_settings_are_set(spark):
    use_settings(spark)
    assert all(spark.conf.get(k) == v for k, v in SETTINGS.items())


def test_stored_tables_lie_in_the_shared_folder(spark):
    df = spark.range(10).withColumn("x", F.array("id"))
    kept = stored(df)
    assert kept.schema.simpleString() == df.schema.simpleString() and kept.count() == 10
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert all(f.startswith("file:") for f in kept.inputFiles())


def test_a_cluster_must_name_the_shared_folder():
    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return None

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_bucketed_pages_meet_a_large_registry_in_place(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS b LOCATION '{tmp_path}'")
    pages = spark.createDataFrame([(i, f"https://s{i}.org", "<p>x</p>") for i in range(20)], "page_id long, url string, html string")
    registry = spark.createDataFrame(
        [(i, f"S{i}", f"https://s{i}.org", "generic_links", None) for i in range(20)],
        "source_ord long, name string, url string, parser string, kind string",
    )
    try:
        save_bucketed(pages, "b.pages", 4)
        save_bucketed(registry, "b.registry", 4)
        joined = source_pages(spark.table("b.pages"), spark.table("b.registry").hint("merge"))
        assert joined.count() == 20
        joined = joined.select("html", "partner")
        joined.collect()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP DATABASE b CASCADE")


def test_pages_are_never_sent_to_all_tasks(spark):
    """However small Spark takes the pages to be beside the registry."""
    pages = spark.sql(
        """SELECT * FROM VALUES (1, 'https://s1.org', '<p>x</p>'), (2, 'https://none.org', '<p>y</p>'),
           (3, NULL, '<p>z</p>'), (4, 'https://s1.org', NULL) AS pages(page_id, url, html)"""
    )
    registry = spark.range(2_000_000).selectExpr(
        "id AS source_ord", "concat('S', id) AS name", "if(id = 7, NULL, concat('https://s', id, '.org')) AS url",
        "'generic_links' AS parser", "CAST(NULL AS string) AS kind",
    )
    joined = source_pages(pages, registry)
    assert "BuildLeft" not in joined._jdf.queryExecution().executedPlan().toString()
    few = source_pages(pages, registry.filter("source_ord < 10"))
    assert sorted((r.page_id, r.partner, r.html) for r in few.collect()) == [(1, "S1", "<p>x</p>"), (4, "S1", None)]
