"""Operators on records (R1-R12, I2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventmill.functions.text import blank_to_null, format_time
from eventmill.schema import ORDER, RECORD_FIELDS
from eventmill.session import stored

IMPORT_BATCH = 500  # Fixed value: records per import request.
KEY = ["partner", "low_title", "start_date", "url"]

# Column ids of the event board.
BOARD_COLUMNS = {
    "date": "date_mm4w9x8p",
    "title": "text_mm4whrb1",
    "details": "text_mm4wpkzw",
    "link": "link_mm4w7r6",
}


def _order_columns(records: DataFrame) -> list[str]:
    """Place of a record in the run; all its columns where that was dropped."""
    return [c for c in ORDER if c in records.columns] or records.columns


def to_records(records: DataFrame) -> DataFrame:
    return records.select(*RECORD_FIELDS)


def dedupe(records: DataFrame) -> DataFrame:
    """First record of each (partner, title in any case, start date, url).

    An aggregate, not a window: copies are reduced before the shuffle, so a key
    that holds much of the data sends one row per task.
    """
    key = [F.col("partner"), F.lower("title").alias("low_title"), F.col("start_date"), F.col("url")]
    rest = [c for c in records.columns if c not in ("partner", "start_date", "url")]
    place = F.struct(*_order_columns(records))
    firsts = records.groupBy(*key).agg(F.min_by(F.struct(*rest), place).alias("first"))
    return firsts.select("partner", "start_date", "url", "first.*").select(*records.columns)


def incoming(records: DataFrame, today: str) -> DataFrame:
    """Events from `today` on; a blank or impossible date is no date."""
    day = F.try_to_date(blank_to_null(F.col("start_date")), "yyyy-MM-dd")
    return records.filter((F.col("kind") == "event") & (day >= F.lit(today).cast("date")))


def by_start_date(records: DataFrame) -> DataFrame:
    order = [c for c in _order_columns(records) if c != "start_date"]
    return records.orderBy("start_date", *order)


def import_columns(records: DataFrame) -> list[Column]:
    """The 13 columns with blanks for what is missing; kind defaults to event."""
    have = set(records.columns)

    def column(name: str) -> Column:
        value = F.col(name) if name in have else F.lit(None).cast("string")
        if name == "kind":
            value = blank_to_null(value)
        return F.coalesce(value, F.lit("event" if name == "kind" else "")).alias(name)

    return [column(c) for c in RECORD_FIELDS]


def to_import(records: DataFrame) -> DataFrame:
    return records.select(*import_columns(records))


def with_rank(records: DataFrame, first: str | None = "start_date") -> DataFrame:
    """Add `rank`, the 0-based place by start date over the whole table.

    Without a `first` column it is the place in the run.

    Rows are sorted in range partitions, which split a day however many events
    it has, and each partition's rows are counted on from the partitions before
    it. Only the counts (one per partition) come together.
    """
    order = [*([first] if first else []), *[c for c in _order_columns(records) if c != first]]
    spread = records.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition in its upper and the row in its lower 33 bits.
    seat = F.monotonically_increasing_id()
    # Range bounds come from a sample: keep this outcome, so that counts and
    # ranks speak of the same partitions, also after a task is run again.
    seated = stored(
        spread.withColumn("_seat", seat)
        .withColumn("_part", F.shiftrightunsigned("_seat", 33))
        .withColumn("_row", F.col("_seat").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_seat")
    )
    counts = seated.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    return (
        seated.join(F.broadcast(starts), "_part")
        .withColumn("rank", F.col("_start") + F.col("_row"))
        .drop("_part", "_row", "_start")
    )


def import_batches(records: DataFrame, size: int = IMPORT_BATCH) -> DataFrame:
    """Request bodies of `size` records each, in start-date order."""
    placed = with_rank(records).select(
        F.floor(F.col("rank") / size).cast("long").alias("batch_no"),
        "rank",
        F.struct(*import_columns(records)).alias("record"),
    )
    batches = placed.groupBy("batch_no").agg(
        F.count("*").alias("n_records"),
        F.sort_array(F.collect_list(F.struct("rank", "record"))).alias("ranked"),
    )
    records_in_order = F.transform("ranked", lambda r: r["record"]).alias("records")
    return batches.select(
        "batch_no", "n_records", F.to_json(F.struct(records_in_order)).alias("body")
    )


def import_totals(results: DataFrame) -> DataFrame:
    """Sums of the import responses' `imported` and `skipped`; missing is 0."""
    totals = [
        F.coalesce(F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))), F.lit(0)).alias(c)
        for c in ("imported", "skipped")
    ]
    return results.agg(*totals)


def event_details() -> Column:
    """Text block of a record: one line per fact, absent facts left out.

    The labels, here and of the link of a board item, are fixed values.
    """

    def line(label: str, value: Column, gap: bool = False) -> Column:
        lead = ("\n" if gap else "") + label
        return F.when(value != "", F.concat(F.lit(lead), value))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Partner: "), F.col("partner")),
        F.concat(F.lit("Date: "), F.col("start_date")),
        line("Time: ", format_time(F.col("start_time"), F.col("end_time"))),
        line("Location: ", F.col("location")),
        line("", F.col("description"), gap=True),
        line("Source page: ", F.col("source_url"), gap=True),
    )


def board_items(records: DataFrame, columns: dict[str, str] = BOARD_COLUMNS) -> DataFrame:
    """One board item per record: its name and the JSON of its column values."""
    date, url = F.col("start_date"), F.col("url")
    values = F.struct(
        F.col("title").alias(columns["title"]),
        event_details().alias(columns["details"]),
        # NULL fields do not appear in the JSON.
        F.when(date != "", F.struct(date.alias("date"))).alias(columns["date"]),
        F.when(url != "", F.struct(url.alias("url"), F.lit("Event link").alias("text"))).alias(
            columns["link"]
        ),
    )
    carried = [c for c in ORDER if c in records.columns]
    return records.select(
        *carried, F.col("title").alias("item_name"), F.to_json(values).alias("column_values")
    )


def source_counts(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records per source name, sources without any included."""
    counts = records.groupBy("partner").agg(F.count("*").alias("n_records"))
    names = registry.select(F.col("name").alias("partner")).distinct()
    return names.join(counts, "partner", "left").select(
        "partner", F.coalesce("n_records", F.lit(0)).alias("n_records")
    )


def run_summary(
    registry: DataFrame,
    scraped: DataFrame | int,
    submitted: DataFrame | int,
    results: DataFrame,
    failures: DataFrame,
) -> DataFrame:
    """One row of counts about a run, and whether the run counts as failed.

    Records are counted here, or were counted (an int) when they were written. The
    failures themselves stay a table: their number grows with the sources.
    """
    summary = registry.agg(F.count("*").alias("sources"))
    for name, rows in [("scraped", scraped), ("submitted", submitted), ("", results), ("failed", failures)]:
        if isinstance(rows, int):
            summary = summary.withColumn(name, F.lit(rows).cast("long"))
        else:
            summary = summary.crossJoin(rows.agg(F.count("*").alias(name)) if name else import_totals(rows))
    return summary.withColumn("run_failed", (F.col("failed") > 0) & (F.col("scraped") == 0))


def keyed(records: DataFrame) -> DataFrame:
    """Add the parts of the record key as `_k_` columns; what is missing is blank."""
    parts = {c: F.lower("title") if c == "low_title" else F.col(c) for c in KEY}
    return records.withColumns({f"_k_{c}": F.coalesce(v, F.lit("")) for c, v in parts.items()})


def new_records(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose key the `known` records do not have (I2)."""
    names = [f"_k_{c}" for c in KEY]
    fresh = keyed(dedupe(records))
    return fresh.join(keyed(known).select(*names), names, "left_anti").drop(*names)
