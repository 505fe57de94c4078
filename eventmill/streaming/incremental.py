"""Repeated runs (I1): each landed page is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventmill.plans.scrape import records_of, scrape
from eventmill.schema import Options
from eventmill.session import stored
from eventmill.sources.registry import validate_registry
from eventmill.streaming.target import read_target, upsert

__all__ = ["PAGES_SCHEMA", "batch_failures", "extract_stream", "read_failures", "read_target", "unseen", "upsert"]

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
FAILURE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("partner", "url", "error", "run")]
    + [T.StructField("batch_id", T.LongType())]
)
#: Folder of failures within a target; readers of the records pass over it.
FAILURES = "_failures"
#: How long a page that has been read is remembered, so that it is not read again.
REMEMBER = "30 days"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_failures(spark: SparkSession, target: str) -> DataFrame:
    """(partner, url, error, run, batch_id) of all landed pages that gave no records by a fault."""
    return _read(spark, f"{target}/{FAILURES}", FAILURE_SCHEMA)


def _write(rows: DataFrame, path: str, *by: str) -> None:
    """Replace what the same run and batch wrote before, and nothing else."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)


def batch_failures(batch: DataFrame, scraped: DataFrame, registry: DataFrame) -> DataFrame:
    """(partner, url, error) of the batch's pages that gave nothing because of a fault:
    unreadable ones, those of faulty sources, and those of no source at all."""
    good, bad = validate_registry(registry)
    unreadable = scraped.filter(F.col("error").isNotNull()).select(
        "partner", F.col("source_url").alias("url"), "error"
    )
    landed = batch.select("url").distinct()
    rest = landed.join(good.select("url"), "url", "left_anti")
    faulty = bad.select("url", F.col("name").alias("partner"), "error")
    lost = rest.join(faulty, "url", "left").select(
        "partner", "url", F.coalesce("error", F.lit("unknown source")).alias("error")
    )
    return unreadable.unionByName(lost)


def unseen(pages: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """Pages of a stream whose address and text have not come within `remember`.

    The state holds the address and a digest of the text of each page, never the text,
    and forgets them after that time on the clock of the stream's batches, by which no
    page is ever late. A page with the same text under another page_id is the same page.
    """
    marked = pages.withColumns(
        {
            "_landed": F.current_timestamp(),
            "_address": F.coalesce("url", F.lit("")),
            "_digest": F.coalesce(F.sha2("html", 256), F.lit("")),
        }
    )
    first = marked.withWatermark("_landed", remember).dropDuplicatesWithinWatermark(["_address", "_digest"])
    return first.select(*pages.columns)


def extract_stream(
    spark: SparkSession,
    landing: str,
    registry: DataFrame,
    target: str,
    checkpoint: str,
    scraped_at: str,
    opts: Options = Options(),
    remember: str | None = REMEMBER,
) -> StreamingQuery:
    """Work off the pages that landed since the last start, then stop.

    A page that landed before with the same text, in whatever file, is passed over for
    as long as `remember` says (None: every landed page is read). Extraction is row-wise
    and dedupe runs against the target, so every micro-batch is an ordinary batch job.
    Records carry the id of the stream, which the progress folder keeps across restarts;
    a new progress folder is a new run and remembers nothing. Pages that fail are written
    to the target's failures.
    """
    pages = spark.readStream.schema(PAGES_SCHEMA).parquet(landing)
    if remember:
        pages = unseen(pages, remember)

    def work(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        if remember:
            batch = stored(batch)  # taken from the state once
        scraped = stored(scrape(batch, registry, scraped_at, opts))
        upsert(records_of(scraped), target, batch_id, run)
        failed = batch_failures(batch, scraped, registry)
        marked = failed.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id)})
        _write(marked, f"{target}/{FAILURES}", "run", "batch_id")

    writer = pages.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    # What is to be forgotten goes with the next pages, not in a batch without any.
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
