"""Deliveries (K4, K5): rows that a posting job finds once each, or not at all.

Tasks write Parquet files of their own and tell the job their names; the job's one commit
names them all in the manifest of its delivery. A task that failed, was run again or ran
twice at once leaves files that no manifest names. A delivery that is written again takes
the place of its earlier files by one rename; others are not touched.
"""

from __future__ import annotations

import json
import re

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from eventmill.operators.records import board_items, import_batches
from eventmill.sources.manifest import Written, drop_files, manifests, new_name, open_folder, put_manifest


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, delivery: str, schema: T.StructType):
        self.path, self.delivery, self.schema = path, delivery, schema

    def write(self, iterator) -> Written:
        files, root = open_folder(self.path)
        files.create_dir(f"{root}/data", recursive=True)
        name, out, n = f"data/{new_name('.parquet')}", None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            out = out or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=files)
            out.write_batch(batch)
            n += batch.num_rows
        if out is None:
            return Written([])
        out.close()
        return Written([{"name": name, "rows": n}])

    def commit(self, messages) -> None:
        told = {"schema": self.schema.json(), "files": [f for m in messages for f in m.files]}
        put_manifest(self.path, self.delivery, told)

    def abort(self, messages) -> None:
        drop_files(self.path, messages)


class Delivery(DataSource):
    """``df.write.format("delivery").option("delivery", name).mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "delivery"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a delivery replaces only itself: write it in mode append")
        return _Writer(self.options["path"], self.options["delivery"], schema)


def deliver(rows: DataFrame, path: str, delivery: str) -> None:
    """Write the rows of one delivery, seen all together once the job is done."""
    if not re.fullmatch(r"[\w-][\w.-]*", delivery):
        raise ValueError(f"not a name for a delivery: {delivery!r}")
    rows.sparkSession.dataSource.register(Delivery)
    rows.write.format("delivery").mode("append").option("delivery", delivery).save(path)


def read_deliveries(spark: SparkSession, path: str, delivery: str | None = None) -> DataFrame:
    """Rows of all deliveries of a folder, or of one, with the column `delivery`.

    The files are plain Parquet, so filters and columns reach their scan.
    """
    found = {k: told for k, told in manifests(path).items() if delivery in (None, k)}
    if not found:
        raise FileNotFoundError(f"no delivery in {path}" + (f": {delivery}" if delivery else ""))
    united = None
    for key, told in found.items():
        schema = T.StructType.fromJson(json.loads(told["schema"]))
        names = [f"{path.rstrip('/')}/{f['name']}" for f in told["files"]]
        rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
        rows = rows.withColumn("delivery", F.lit(key))
        united = rows if united is None else united.unionByName(rows, allowMissingColumns=True)
    return united


def deliver_imports(records: DataFrame, path: str, run_date: str) -> None:
    """The import request bodies of a day."""
    deliver(import_batches(records), path, run_date)


def deliver_board(records: DataFrame, path: str, run_date: str, board_id: str) -> None:
    """The board items of a day."""
    items = board_items(records).select(F.lit(board_id).alias("board_id"), "item_name", "column_values")
    deliver(items, path, run_date)
