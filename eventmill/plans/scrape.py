"""Listing job (E1, E3; S5, S6): registry x pages -> records and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.functions.urls import url_parts
from eventmill.operators.extractors import extract_items
from eventmill.operators.records import dedupe, to_records
from eventmill.operators.tree import with_tree
from eventmill.schema import Options
from eventmill.sources.registry import validate_registry


def source_pages(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Pages of registered sources, with what the layouts need of the source.

    The join carries no hint: a registry read from a file has a known size, and
    Spark broadcasts it below its threshold. A registry beyond that is joined
    by hash, where AQE splits a source that holds much of the pages. The pages are the
    kept side of an outer join, which is never the one that is sent to all tasks: Spark
    takes a column of html to be twenty bytes wide. The comparison behind it, which a
    missing source does not pass, leaves the pages without one out.
    """
    sources = registry.select(
        F.col("name").alias("partner"),
        F.col("url").alias("source_url"),
        "parser",
        "kind",
        F.col("source_ord").cast("long").alias("source_ord"),
        url_parts(F.col("url")).alias("base"),
    )
    landed = pages.select(F.col("page_id").cast("long"), F.col("url").alias("page_url"), "html")
    landed = landed.filter(F.col("page_url").isNotNull())
    told = landed.join(sources, F.col("page_url") == F.col("source_url"), "left")
    return told.filter(F.col("page_url").eqNullSafe(F.col("source_url"))).drop("page_url")


def scrape(
    pages: DataFrame,
    registry: DataFrame,
    scraped_at: str,
    opts: Options = Options(),
    layouts: list[str] | None = None,
    on_error: str = "quarantine",
) -> DataFrame:
    """One pass over the pages: records before dedupe, and unreadable pages.

    Unreadable pages are the rows with an `error`. Faulty sources take no part; with
    ``on_error="fail"`` the first one ends the job.
    """
    good, _ = validate_registry(registry, on_error)
    trees = with_tree(source_pages(pages, good))
    return extract_items(trees, scraped_at, opts, layouts)


def records_of(scraped: DataFrame) -> DataFrame:
    return scraped.filter(F.col("error").isNull()).drop("error")


def extract(
    pages: DataFrame,
    registry: DataFrame,
    scraped_at: str,
    opts: Options = Options(),
    layouts: list[str] | None = None,
    on_error: str = "quarantine",
) -> DataFrame:
    """Distinct records of all pages, in the 13 record columns."""
    scraped = scrape(pages, registry, scraped_at, opts, layouts, on_error)
    return to_records(dedupe(records_of(scraped)))


def failures(scraped: DataFrame, pages: DataFrame, registry: DataFrame) -> DataFrame:
    """(partner, error) of every source that gave nothing because of a fault.

    `scraped` is the output of ``scrape``; keep it (a table or a checkpoint) to
    read both its records and its failures without a second pass.
    """
    good, bad = validate_registry(registry)
    unreadable = scraped.filter(F.col("error").isNotNull()).select("partner", "error")
    # Only addresses of registered sources leave the scan, once each.
    landed = pages.join(good.select("url"), "url", "left_semi").select("url").distinct()
    absent = good.join(landed, "url", "left_anti").select(
        F.col("name").alias("partner"), F.lit("no page").alias("error")
    )
    faulty = bad.select(F.col("name").alias("partner"), "error")
    return unreadable.unionByName(absent).unionByName(faulty)
