"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptledger.session import prepare, shared_dir

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; also ships this package to the Python workers."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and go on from the copy.

    What follows reads files, so a lost executor costs no more than its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is executed inside hands Python at most so many rows at a time, which bounds
    a worker's memory where rows hold texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def n_words(text: Column) -> Column:
    """Number of words in the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """Length in UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def ranged(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Range-sort into partitions numbered in order by ``_part``, written once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return staged(split, name)


def with_prefix(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Global running sums, exclusive of the row itself, of a ``ranged`` table.

    ``sums`` maps a new column to the column it adds up. Only one row per range
    goes through a window of its own; the rows are summed inside their range.
    """
    per_part = df.groupBy("_part").agg(*(F.sum(c).alias(f"_all_{n}") for n, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part", *(F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums)
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()))
    # One row per range: bounded by the number of partitions.
    out = out.join(F.broadcast(offsets), "_part")
    for n in sums:
        out = out.withColumn(n, F.col(f"_off_{n}") + F.col(f"_in_{n}")).drop(f"_off_{n}", f"_in_{n}")
    return out
