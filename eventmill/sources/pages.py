"""Landed pages (S1): the tables that stand in for fetched text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "url") -> None:
    """Keep pages, or a registry, as a table bucketed and sorted by address.

    Tables of equal bucket counts are joined where they lie: a registry beyond the
    broadcast threshold then meets its pages without an exchange of page text.
    """
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)
