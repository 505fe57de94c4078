"""Record files and outbox tables (K1-K5)."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.operators.records import board_items, import_batches, with_rank
from eventmill.schema import RECORD_FIELDS, RECORD_SCHEMA
from eventmill.session import stored

FORMATS = ("csv", "json")
# Written as a plain csv module would: quotes doubled, blanks left blank.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "lineSep": "\r\n",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def choose_format(path: str, fmt: str | None = None) -> str:
    """The format asked for, else the one the path ends in, else csv."""
    chosen = fmt or PurePosixPath(path).suffix.removeprefix(".") or "csv"
    if chosen not in FORMATS:
        raise ValueError(f"unsupported output format: {chosen}")
    return chosen


def save(records: DataFrame, path: str, fmt: str | None = None) -> None:
    """Write the record columns; JSON is one object per line (`save_array`: one array)."""
    out = records.select(*RECORD_FIELDS).write.mode("overwrite")
    if choose_format(path, fmt) == "csv":
        out.options(**CSV_OPTIONS).csv(path)
    else:
        out.json(path)


def save_array(records: DataFrame, path: str) -> None:
    """Write the records as one JSON array, a record in each line, in the run's order.

    Every task writes a range of the array: the parts, one after the other by their
    numbers, are the whole text. No records give an array without any.
    """
    ranked = with_rank(records, first=None).withColumn("_text", F.to_json(F.struct(*RECORD_FIELDS), {"ignoreNullFields": "false"}))
    ranked = stored(ranked.select("rank", "_text"))
    # The last record's rank, one row; a record that another follows ends in a comma.
    last = ranked.agg(F.coalesce(F.max("rank"), F.lit(-1)).alias("_last"))
    comma = F.when(F.col("rank") < F.col("_last"), ",").otherwise("")
    lines = ranked.crossJoin(F.broadcast(last)).select("rank", F.concat("_text", comma).alias("value"))
    # Brackets stand before rank 0 and behind every rank.
    frame = records.sparkSession.createDataFrame([(-1, "["), (2**62, "]")], "rank long, value string")
    whole = lines.unionByName(frame).repartitionByRange("rank").sortWithinPartitions("rank")
    whole.select("value").write.mode("overwrite").text(path)


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of an array that `save_array` wrote, read line by line by many tasks."""
    line = F.rtrim(F.col("value"), F.lit(","))
    rows = spark.read.text(path).filter(~F.col("value").isin("[", "]"))
    return rows.select(F.from_json(line, RECORD_SCHEMA).alias("r")).select("r.*")


def save_import_outbox(records: DataFrame, path: str, run_date: str) -> None:
    """Import request bodies for a delivery job to post, one folder per day."""
    batches = import_batches(records).withColumn("run_date", F.lit(run_date))
    _replace_days(batches, path)


def save_board_outbox(records: DataFrame, path: str, run_date: str, board_id: str) -> None:
    """Board items for a delivery job to post, one folder per day."""
    items = board_items(records).select(
        F.lit(board_id).alias("board_id"), "item_name", "column_values"
    )
    _replace_days(items.withColumn("run_date", F.lit(run_date)), path)


def _replace_days(df: DataFrame, path: str) -> None:
    """Write a day again without touching the other days."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )
