"""Small states that live queries replace batch by batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A reader that has just found the newest version still finds its files two writes later.
KEPT = 3


@dataclass(frozen=True)
class Versions:
    """A table kept as numbered versions in folders ``version=N``; the highest one holds.

    Version N is made from the highest one below N, so making it again gives the same
    result, and a batch that is repeated after a restart finds the state it began from.
    The last ``kept`` versions stay, so neither the folders nor a read grow with the
    number of batches.
    """

    path: str
    schema: T.StructType
    kept: int = KEPT

    def __post_init__(self):
        if self.kept < 2:
            raise ValueError("a batch that is repeated needs the version before it")

    def read(self, spark: SparkSession, below: int | None = None) -> DataFrame:
        """The newest version, or the newest below a number; empty when there is none."""
        numbered = T.StructType([*self.schema.fields, T.StructField("version", T.LongType())])
        try:
            versions = spark.read.schema(numbered).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.schema)
        if below is not None:
            versions = versions.where(F.col("version") < below)
        newest = versions.agg(F.max("version").alias("v")).first()["v"]
        return versions.where(F.col("version") == F.lit(newest)).drop("version")

    def newest(self, spark: SparkSession) -> int | None:
        return max(self._numbers(spark), default=None)

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        spark = rows.sparkSession
        for old in self._numbers(spark):
            if old <= version - self.kept:
                fs, folder = self._folder(spark, f"{self.path}/version={old}")
                fs.delete(folder, True)

    def _folder(self, spark: SparkSession, path: str):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder

    def _numbers(self, spark: SparkSession) -> list[int]:
        fs, folder = self._folder(spark, self.path)
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
