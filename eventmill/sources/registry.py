"""The table of sources (S2-S4): who publishes where, in which layout."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.schema import REGISTRY_SCHEMA
from eventmill.session import stored

CONFIG_SCHEMA = T.StructType([T.StructField("partners", T.ArrayType(REGISTRY_SCHEMA))])


@F.udf(T.StringType())
def _yaml_to_json(config):
    import yaml  # only needed where a registry is kept as YAML

    return json.dumps(yaml.safe_load(config) or {}, default=str)


def save_registry(registry: DataFrame, path: str) -> None:
    """Write a registry of any size as JSON lines, one source each, in its order.

    Every task writes the sources of one range of `source_ord`.
    """
    ordered = registry.repartitionByRange("source_ord").sortWithinPartitions("source_ord")
    ordered.select(*REGISTRY_SCHEMA.names).write.mode("overwrite").json(path)


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Sources of JSON lines, read split by split.

    Names of files and places in them give the order: lines are numbered within each
    task's stretch of a file, and a stretch goes on from what lies before it.
    """
    lines = spark.read.schema(REGISTRY_SCHEMA).json(path)
    # Numbers of tasks change from one reading to the next: these are kept.
    seated = stored(
        lines.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seat"),
        )
    )
    counts = seated.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_seat").alias("_first"))
    ahead = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_file", "_block", (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_start"))
    placed = seated.join(starts, ["_file", "_block"])
    return placed.select((F.col("_seat") + F.col("_start")).alias("source_ord"), *REGISTRY_SCHEMA.names)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a config file, JSON or YAML: an object with a `partners` list.

    The position in the list becomes `source_ord`. No list, no sources. A file or folder
    in `.jsonl` holds one source in each line, in the order of names and lines; it is
    read by as many tasks as it is large, and may hold any number.
    """
    if path.rstrip("/").endswith(".jsonl"):
        return _read_lines(spark, path)
    if path.endswith((".yaml", ".yml")):
        text = spark.read.text(path, wholetext=True)
        parsed = F.from_json(_yaml_to_json("value"), CONFIG_SCHEMA)
        config = text.select(parsed.alias("config")).select("config.*")
    else:
        config = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
    return config.select(F.posexplode("partners").alias("source_ord", "source")).select(
        "source_ord", "source.*"
    )


def with_source_order(registry: DataFrame, *by: str) -> DataFrame:
    """Give a registry table that has no list order one, by its own columns."""
    keys = [F.col(c) for c in by or ("name", "url")]
    return registry.withColumn("source_ord", F.xxhash64(*keys))


def select_sources(registry: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Sources with one of these names in any case; no names means all."""
    if not names:
        return registry
    return registry.filter(F.lower("name").isin([n.lower() for n in names]))


def registry_error() -> Column:
    """What is wrong with a source, NULL if nothing."""
    from eventmill.operators.extractors import EXTRACTORS

    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("name", "parser", "url")])
    )
    unknown = F.concat(F.lit("unknown parser: "), F.col("parser"))
    return F.when(
        F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))
    ).when(~F.col("parser").isin(list(EXTRACTORS)), unknown)


def validate_registry(registry: DataFrame, on_error: str = "quarantine"):
    """Split a registry into (usable sources, faulty sources with `error`).

    With ``on_error="fail"`` the first faulty source ends the job instead.
    """
    checked = registry.withColumn("error", registry_error())
    if on_error == "fail":
        stop = F.raise_error(F.concat(F.lit("bad source: "), F.col("error")))
        guard = F.when(F.col("error").isNotNull(), stop.cast("boolean")).otherwise(F.lit(True))
        checked = checked.filter(guard)
    elif on_error != "quarantine":
        raise ValueError(f"on_error must be 'quarantine' or 'fail', not {on_error!r}")
    good = checked.filter(F.col("error").isNull()).drop("error")
    return good, checked.filter(F.col("error").isNotNull())
