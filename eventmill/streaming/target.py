"""The target of repeated runs (I2): a log of segments that are merged as they gather.

    target/_log/<version>.json   the live segments; one small file is one state
    target/_log/last             the number of a late version, to start looking from
    target/segment=…/month=…     records sorted by the hash of their key

A batch adds one segment and then a version that names it. It reads one version, and of
the segments only the months that it has records of; undated records are dealt to
folders by hash. A small batch looks its keys up through the files' own statistics and
Bloom filters. When MERGE segments of a level have gathered they become one of the next
level, so the live ones grow with the logarithm of the batches, and what a batch lists
does not grow with history. Folders that were merged stay for one more merge, so readers
of an earlier version finish.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.operators.records import KEY, dedupe, keyed, to_records
from eventmill.schema import ORDER, RECORD_FIELDS
from eventmill.session import stored

#: Segments of a level that become one of the next.
MERGE = 8
#: Keys of a batch that are looked up one by one; a larger batch reads the key columns.
LOOKUP_KEYS = 1000
#: Batches whose counts a version remembers, for a batch that is run again.
REMEMBERED = 200
#: Versions that are kept for readers.
VERSIONS = 20
#: Folders that records without a month are dealt to.
UNDATED = 16
NO_MONTH = "none"

TARGET_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in RECORD_FIELDS]
    + [
        T.StructField("run", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("key_hash", T.LongType()),
        T.StructField("month", T.StringType()),
    ]
)
_KEYS = [f"_k_{c}" for c in KEY]


@dataclass(frozen=True)
class Segment:
    name: str
    level: int
    rows: int
    months: list[str]


@dataclass(frozen=True)
class Version:
    """One state of a target. `counts`: (imported, skipped) of late batches."""

    number: int = -1
    segments: list[Segment] = field(default_factory=list)
    retired: list[str] = field(default_factory=list)
    counts: dict[str, list[int]] = field(default_factory=dict)


class _Folder:
    """Small files under a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        try:
            stream = self._files.open(self._at(name))
        except Py4JJavaError as error:
            if "FileNotFoundException" in str(error.java_exception):
                return None
            raise
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool) -> bool:
        """False if the file is there and must not be replaced."""
        try:
            stream = self._files.create(self._at(name), replace)
        except Py4JJavaError as error:
            if not replace and "AlreadyExists" in str(error.java_exception):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self._files.delete(self._at(name), True)


def _parsed(text: str | None) -> Version | None:
    """A version, or None where there is none or its file is still being written."""
    try:
        told = json.loads(text or "null")
    except ValueError:
        return None
    if told is None:
        return None
    return Version(**{**told, "segments": [Segment(**s) for s in told["segments"]]})


def read_version(spark: SparkSession, target: str) -> Version:
    """The newest version: found from the hint on, without listing anything."""
    folder = _Folder(spark, target)
    hint = folder.read("_log/last")
    version = _parsed(folder.read(f"_log/{hint}.json")) if hint else None
    version = version or Version()
    while (later := _parsed(folder.read(f"_log/{version.number + 1}.json"))) is not None:
        version = later
    return version


def commit(spark: SparkSession, target: str, version: Version) -> bool:
    """Make this the newest version; False if another writer was first."""
    folder = _Folder(spark, target)
    if not folder.write(f"_log/{version.number}.json", json.dumps(asdict(version)), False):
        return False
    folder.write("_log/last", str(version.number), True)
    folder.delete(f"_log/{version.number - VERSIONS}.json")
    return True


def key_hash() -> Column:
    return F.xxhash64(*_KEYS)


def _month() -> Column:
    day = F.substring("start_date", 1, 7)
    undated = F.concat(F.lit(f"{NO_MONTH}-"), F.pmod(key_hash(), F.lit(UNDATED)).cast("string"))
    return F.when(day.rlike(r"^\d{4}-\d\d$"), day).otherwise(undated)


def paths_of(target: str, version: Version, months: list[str]) -> list[str]:
    """The folders that can hold records of these months."""
    wanted = set(months)
    return [f"{target}/{s.name}/month={m}" for s in version.segments for m in s.months if m in wanted]


def known_keys(spark: SparkSession, target: str, version: Version, fresh: DataFrame, n: int) -> DataFrame:
    """Keys of the target that the records `fresh`, n of them, may have."""
    months = [r[0] for r in fresh.select("month").distinct().collect()]  # months, not records
    paths = paths_of(target, version, months)
    fields = [f for f in TARGET_SCHEMA.fields if f.name in ("partner", "title", "start_date", "url", "key_hash")]
    kept = spark.read.schema(T.StructType(fields)).parquet(*paths) if paths else spark.createDataFrame([], T.StructType(fields))
    if paths and n <= LOOKUP_KEYS:
        # Pushed to the files: only pages whose bounds and filters allow one of these are read.
        kept = kept.filter(F.col("key_hash").isin([r[0] for r in fresh.select("key_hash").collect()]))
    return keyed(kept).select("key_hash", *_KEYS)


def _write(rows: DataFrame, path: str, n: int) -> list[str]:
    """Write a segment in order of month and key hash; returns its months."""
    ordered = rows.select(*TARGET_SCHEMA.names).repartitionByRange("month", "key_hash")
    writer = ordered.sortWithinPartitions("month", "key_hash").write.mode("overwrite").partitionBy("month")
    writer = writer.option("parquet.bloom.filter.enabled#key_hash", "true")
    writer.option("parquet.bloom.filter.expected.ndv#key_hash", str(max(64, min(n, 1_000_000)))).parquet(path)
    found = rows.sparkSession.read.schema(TARGET_SCHEMA).parquet(path).select("month").distinct()
    return sorted(r[0] for r in found.collect())


def _read(spark: SparkSession, target: str, segments: list[Segment]) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], TARGET_SCHEMA)
    rows = spark.read.schema(TARGET_SCHEMA).option("basePath", target)
    return rows.parquet(*[f"{target}/{s.name}" for s in segments]).select(*TARGET_SCHEMA.names)


def upsert(records: DataFrame, target: str, batch_id: int, run: str = "manual") -> DataFrame:
    """Add the records the target does not have; returns (imported, skipped).

    A batch of a run that is in already is not added again: its counts are those of the
    first time (of the last REMEMBERED batches; an older one finds all its records known).
    A batch that failed on the way left no version, so nothing of it is seen. If another
    writer was first, the batch is compared anew with what that one has added.
    """
    spark, mark = records.sparkSession, f"{run}/{batch_id}"
    version = read_version(spark, target)
    schema = "imported long, skipped long"
    if mark in version.counts:
        return spark.createDataFrame([tuple(version.counts[mark])], schema)
    place = [c for c in ORDER if c in records.columns]
    batch = stored(records.select(*place, *RECORD_FIELDS))
    marks = {"run": F.lit(run), "batch_id": F.lit(batch_id).cast("long"), "key_hash": key_hash()}
    fresh = stored(keyed(dedupe(batch)).withColumns(marks).withColumn("month", _month()))
    seen, n = batch.count(), fresh.count()
    while True:
        known = known_keys(spark, target, version, fresh, n)
        new = stored(fresh.join(known, ["key_hash", *_KEYS], "left_anti"))
        imported = new.count()
        segments = version.segments
        if imported:
            name = f"segment={uuid.uuid4().hex}"
            segments = [*segments, Segment(name, 0, imported, _write(new, f"{target}/{name}", imported))]
        counts = dict(list(version.counts.items())[1 - REMEMBERED :]) | {mark: [imported, seen - imported]}
        if commit(spark, target, Version(version.number + 1, segments, version.retired, counts)):
            break
        if imported:
            _Folder(spark, target).delete(name)
        version = read_version(spark, target)
    merge(spark, target)
    return spark.createDataFrame([(imported, seen - imported)], schema)


def merge(spark: SparkSession, target: str, least: int | None = None) -> int:
    """Make one segment of each level that has `least` or more; returns how many were made."""
    least, made = least or MERGE, 0
    while True:
        version = read_version(spark, target)
        levels: dict[int, list[Segment]] = {}
        for s in version.segments:
            levels.setdefault(s.level, []).append(s)
        full = next((lvl for lvl, own in sorted(levels.items()) if len(own) >= least), None)
        if full is None:
            return made
        old = levels[full]
        name, n = f"segment={uuid.uuid4().hex}", sum(s.rows for s in old)
        months = _write(_read(spark, target, old), f"{target}/{name}", n)
        segments = [s for s in version.segments if s not in old] + [Segment(name, full + 1, n, months)]
        after = Version(version.number + 1, segments, [s.name for s in old], version.counts)
        folder = _Folder(spark, target)
        if commit(spark, target, after):
            made += 1
            for gone in version.retired:
                folder.delete(gone)
        else:
            folder.delete(name)


def read_target(spark: SparkSession, target: str) -> DataFrame:
    """Records kept so far, each with its run, batch and month; none before the first run."""
    return _read(spark, target, read_version(spark, target).segments).drop("key_hash")


def target_records(spark: SparkSession, target: str) -> DataFrame:
    return to_records(read_target(spark, target))
