"""Writers and readers of audit ledgers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from promptledger.functions.findings import literal
from promptledger.operators.ledger import json_ready
from promptledger.operators.stats import RING_CAPACITY, ring
from promptledger.schemas import LEDGER, LEDGER_FINDINGS, MONEY, table
from promptledger.session import cut_lineage
from promptledger.sources.versions import Versions

EVENT = "audit.request"
#: Folder names of numbered batches.
BATCH = "batch"
DEFAULT_TABLE = "audit_records"


class Sink(Protocol):
    """Anything that can take a batch of ledger records.

    A sink with ``write_batch(ledger, number)`` gives the same result however often a
    batch of one number is written, so a batch that failed half way can be repeated.
    """

    def write(self, ledger: DataFrame) -> None: ...


def write_numbered(sink: Sink, ledger: DataFrame, number: int) -> None:
    """Write a numbered batch; a sink that knows no numbers appends it."""
    numbered = getattr(sink, "write_batch", None)
    if numbered is None:
        sink.write(ledger)
    else:
        numbered(ledger, number)


def _batch_folder(path: str, number: int) -> str:
    """Spark's writers show the files of a folder only once all of them are whole."""
    return f"{path.rstrip('/')}/{BATCH}={number}"


def _load(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A Parquet folder, or None when nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


@dataclass(frozen=True)
class JsonLines:
    """One JSON object per record, appended; money is text, unset members are null."""

    path: str

    def write(self, ledger: DataFrame) -> None:
        lines = json_ready(ledger)
        lines.write.mode("append").option("ignoreNullFields", "false").json(self.path)

    def write_batch(self, ledger: DataFrame, number: int) -> None:
        lines = json_ready(ledger).write.mode("overwrite").option("ignoreNullFields", "false")
        lines.json(_batch_folder(self.path, number))

    def stream(self, ledger: DataFrame) -> DataStreamWriter:
        writer = json_ready(ledger).writeStream.format("json").option("path", self.path)
        return writer.option("ignoreNullFields", "false")


#: Copies of one record without an id that are numbered from one row at a time.
COPIES = 4_096


def record_keys(ledger: DataFrame) -> DataFrame:
    """One row per record, with ``record_key``.

    The key is the request id; of records that share one the earliest stays. A record
    without an id is known by its content and its number among equal ones, so all
    stay and get the same keys whenever the same batch is written. Copies collapse on
    the map side first, whatever share of the rows they have.
    """
    content = F.sha2(F.to_json(F.struct(*ledger.columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    named = ledger.withColumn("_key", F.coalesce("request_id", F.concat(F.lit("content-"), content)))
    last = F.lit(2**63 - 1).cast("long")
    picked = named.groupBy("_key").agg(
        F.min_by(F.struct(*ledger.columns), F.coalesce("arrival_seq", last)).alias("_row"), F.count("*").alias("_n")
    )
    times = F.when(F.col("_row.request_id").isNull(), F.col("_n")).otherwise(1)
    blocks = picked.withColumn("_times", times).withColumn(
        "_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"), F.lit(COPIES).cast("long")))
    )
    stop = F.least(F.col("_from") + (COPIES - 1), "_times")
    numbered = blocks.withColumn("_no", F.explode(F.sequence("_from", stop)))
    key = F.when(F.col("_row.request_id").isNull(), F.concat("_key", F.lit("-"), F.col("_no").cast("string")))
    return numbered.select("_row.*", F.coalesce(key, "_key").alias("record_key"))


@dataclass(frozen=True)
class LedgerTable:
    """Parquet by day under ``path/table``, in buckets by record key; a record is stored once.

    Keys the table already holds (see :func:`record_keys`) are skipped by an anti join
    with the key column alone. Batch and table are joined bucket by bucket, so what was
    stored before is not shuffled. Writing a batch again adds nothing, and adds what is
    missing where a write was cut short. A copy of a key may be ``days_back`` days
    younger than the first at most; the default looks at all days. Records without a
    day are always looked at, and a batch that holds one is held against all days.

    The table is known to the session's catalog as ``catalog_name``; data and buckets
    lie in the folder, so any session finds them. ``buckets`` holds for a table's life.
    """

    path: str
    table: str = DEFAULT_TABLE
    findings_as_json: bool = True
    days_back: int | None = None
    buckets: int = 16

    def __post_init__(self):
        if not re.fullmatch(r"\w*[^\W_]\w*", self.table):
            raise ValueError("a table name has letters, digits and underscores only")
        if self.buckets < 1:
            raise ValueError("a table has one bucket at least")

    @property
    def folder(self) -> str:
        return f"{self.path.rstrip('/')}/{self.table}"

    @property
    def catalog_name(self) -> str:
        return f"ledger_{hashlib.sha256(self.folder.encode()).hexdigest()[:24]}"

    def _columns(self) -> list[T.StructField]:
        text = lambda f: T.StructField(f.name, T.StringType())
        stored = [text(f) if f.name == "findings" and self.findings_as_json else f for f in LEDGER.fields]
        return [*stored, T.StructField("record_key", T.StringType()), T.StructField("day", T.DateType())]

    def _open(self, spark: SparkSession) -> DataFrame:
        """The table as the catalog knows it, with the days that other sessions added."""
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self._columns())
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.catalog_name} ({columns}) USING parquet PARTITIONED BY (day) "
            f"CLUSTERED BY (record_key) INTO {self.buckets} BUCKETS LOCATION {literal(self.folder)}"
        )
        if _load(spark, self.folder, table(record_key=T.StringType())) is not None:
            spark.catalog.recoverPartitions(self.catalog_name)
        return spark.table(self.catalog_name)

    def missing(self, ledger: DataFrame) -> DataFrame:
        """The records that the table doesn't hold, in its columns and buckets."""
        fresh = record_keys(ledger.select(*LEDGER.names)).withColumn("day", F.to_date("timestamp"))
        if self.findings_as_json:
            fresh = fresh.withColumn("findings", F.to_json("findings"))
        held = self._open(ledger.sparkSession)
        if self.days_back is not None:
            fresh = cut_lineage(fresh)
            days = fresh.agg(F.min("day").alias("first"), F.expr("bool_or(day IS NULL)").alias("unknown")).first()
            if days["first"] is not None and not days["unknown"]:
                recent = F.col("day") >= F.date_sub(F.lit(days["first"]), self.days_back)
                held = held.where(recent | F.col("day").isNull())
        in_buckets = fresh.repartition(self.buckets, "record_key")
        new = in_buckets.join(held.select("record_key"), "record_key", "left_anti")
        return new.select(*(f.name for f in self._columns()))

    def write(self, ledger: DataFrame) -> None:
        self.missing(ledger).write.insertInto(self.catalog_name)

    def write_batch(self, ledger: DataFrame, number: int) -> None:
        """Keys tell what is stored already, whatever the number."""
        self.write(ledger)


@dataclass(frozen=True)
class LogEvents:
    """Structured log lines: event, level, then the record's members."""

    path: str

    def _lines(self, ledger: DataFrame) -> DataFrame:
        event = F.struct(F.lit(EVENT).alias("event"), F.lit("info").alias("level"), "*")
        line = F.to_json(event, {"ignoreNullFields": "false"})
        return json_ready(ledger).select(line.alias("value"))

    def write(self, ledger: DataFrame) -> None:
        self._lines(ledger).write.mode("append").text(self.path)

    def write_batch(self, ledger: DataFrame, number: int) -> None:
        self._lines(ledger).write.mode("overwrite").text(_batch_folder(self.path, number))

    def stream(self, ledger: DataFrame) -> DataStreamWriter:
        return self._lines(ledger).writeStream.format("text").option("path", self.path)


@dataclass(frozen=True)
class Ring:
    """The last records, replaced version by version (see :class:`Versions`)."""

    path: str
    capacity: int = RING_CAPACITY

    def __post_init__(self):
        if self.capacity <= 0:
            raise ValueError("capacity must be positive")

    @property
    def versions(self) -> Versions:
        return Versions(self.path, LEDGER)

    def read(self, spark: SparkSession, below: int | None = None) -> DataFrame:
        return self.versions.read(spark, below)

    def write(self, ledger: DataFrame, version: int | None = None) -> None:
        spark = ledger.sparkSession
        if version is None:
            last = self.versions.newest(spark)
            version = 0 if last is None else last + 1
        merged = self.read(spark, version).unionByName(ledger.select(*LEDGER.names))
        self.versions.write(ring(merged, self.capacity), version)

    def write_batch(self, ledger: DataFrame, number: int) -> None:
        self.write(ledger, number)


@dataclass(frozen=True)
class Discard:
    """Computes the records and drops them."""

    def write(self, ledger: DataFrame) -> None:
        ledger.write.mode("append").format("noop").save()


@dataclass(frozen=True)
class FanOut:
    """Every sink gets every record, in order; one that fails stops no other.

    The records are computed once, in the shared folder, and each sink reads
    that copy.
    """

    sinks: Sequence[Sink]

    def __post_init__(self):
        if not self.sinks:
            raise ValueError("give at least one sink")

    def write(self, ledger: DataFrame) -> list[tuple[Sink, Exception]]:
        return self._each(ledger, lambda sink, stored: sink.write(stored))

    def write_batch(self, ledger: DataFrame, number: int) -> list[tuple[Sink, Exception]]:
        """Write a numbered batch. After a failure it can be written again: sinks that had it
        are left as they were, the one that failed gets it whole."""
        return self._each(ledger, lambda sink, stored: write_numbered(sink, stored, number))

    def _each(self, ledger: DataFrame, write) -> list[tuple[Sink, Exception]]:
        stored = cut_lineage(ledger) if len(self.sinks) > 1 else ledger
        failed = []
        for sink in self.sinks:
            try:
                write(sink, stored)
            except Exception as error:  # noqa: BLE001 - reported to the caller
                failed.append((sink, error))
        return failed


def choose_sinks(
    enabled: bool = True,
    ring_path: str | None = None,
    ring_capacity: int = RING_CAPACITY,
    json_path: str | None = None,
    table_path: str | None = None,
    log_path: str | None = None,
) -> Sink:
    """The sinks that the settings name; a disabled ledger is discarded."""
    if not enabled:
        return Discard()
    sinks: list[Sink] = []
    if ring_path:
        sinks.append(Ring(ring_path, ring_capacity))
    if json_path:
        sinks.append(JsonLines(json_path))
    if table_path:
        sinks.append(LedgerTable(table_path))
    if log_path:
        sinks.append(LogEvents(log_path))
    return FanOut(sinks) if sinks else Discard()


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines ledger, with money exact again."""
    fields = [
        T.StructField(f.name, T.StringType()) if f.name == "estimated_cost_usd" else f
        for f in LEDGER.fields
    ]
    raw = spark.read.schema(T.StructType(fields)).json(path)
    money = F.col("estimated_cost_usd").try_cast(MONEY)
    return raw.withColumn("estimated_cost_usd", money).select(*LEDGER.names)


def read_table(
    spark: SparkSession, path: str, table: str = DEFAULT_TABLE, findings_as_json: bool = True
) -> DataFrame:
    """Records of a ledger table; filters on ``day`` prune folders."""
    fields = [
        T.StructField(f.name, T.StringType()) if f.name == "findings" and findings_as_json else f
        for f in LEDGER.fields
    ]
    folder = LedgerTable(path, table).folder
    schema = T.StructType([*fields, T.StructField("day", T.DateType())])
    rows = spark.read.schema(schema).parquet(folder)
    if findings_as_json:
        rows = rows.withColumn("findings", F.from_json("findings", LEDGER_FINDINGS))
    return rows
