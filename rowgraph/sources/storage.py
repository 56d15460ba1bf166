"""Where extraction results are kept between builds.

``ExtractionStore`` holds one Parquet dataset a watch, replaced as a whole by
each maintenance run: the new version is written beside the old one and the
old one goes only when the new one is complete, so a failed run loses nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowgraph.runtime import ensure_checkpoint_dir

SCHEMA = "source_pk string, row_ord struct<number:long,name:string>, surfaces array<string>, body string, print long"


class ExtractionStore:
    """Versions of the extraction of each watch under one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{ensure_checkpoint_dir(spark)}/extraction-{uuid.uuid4().hex}"
        self._current: dict[int, str] = {}

    def read(self, watch_id: int) -> DataFrame:
        path = self._current.get(watch_id)
        return self.spark.read.schema(SCHEMA).parquet(path) if path else self.spark.createDataFrame([], SCHEMA)

    def replace(self, watch_id: int, rows: DataFrame) -> None:
        path = f"{self.folder}/{watch_id}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        old, self._current[watch_id] = self._current.get(watch_id), path
        if old:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
