"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this kind wants on a cluster. Sizes of tasks and joins are
# left to AQE; pages are large rows, so Arrow batches are bounded by bytes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM does not compile methods beyond this size; such stages then run as
    # smaller generated pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Key lookups of this many values go to the files' statistics and filters.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
}


def local_session(cores: str | int = "*", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("eventmill")
    builder = builder.config("spark.ui.enabled", "false")
    # Building large expressions is twice as fast without call-site capture.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": "8", **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_settings(spark: SparkSession) -> SparkSession:
    """Give a cluster's own session the settings of this library's jobs."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name under the one the cluster names in spark.checkpoint.dir.

    Executors and driver see the same files there. Only a session on one machine
    may lack the setting (a test); it gets a temporary folder for its lifetime.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="eventmill-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/eventmill-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back from there.

    This cuts the lineage, outlives lost executors, and gives the optimizer a
    table with sizes and columns to prune.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
