"""Helpers that several operators of this folder use."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from foliospark import scale


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw(column: pa.Array) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of anything but the six ASCII white space characters, A-Z lower-cased."""
    return text.lower().split()


def strings(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


class Stage:
    """Tables written to the shared folder during one operator, to be dropped once their readers are done."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def keep(self, df: DataFrame, name: str = "llm") -> DataFrame:
        """Write ``df`` and go on from the written rows; a lost executor costs a re-read."""
        path = scale.fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that no frame still to be run reads."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_path)
            at.getFileSystem(conf).delete(at, True)
