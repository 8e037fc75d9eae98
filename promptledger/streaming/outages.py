"""Upstream outages over a stream of calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptledger.operators.outages import (
    FAILURE_THRESHOLD,
    RANGE_SIZE,
    long_runs,
    number_failures,
)
from promptledger.schemas import OUTAGE_STATE
from promptledger.sources.versions import Versions


@dataclass(frozen=True)
class OutageTracker:
    """Follows runs of failures across micro-batches.

    Each batch runs the table operator over its calls, spread over ranges of
    arrival numbers; between batches only one row per provider is kept, as a
    version numbered by the batch (the last few of them). Ended outages of batch N go to
    ``path/ended/batch=N``. Writing a batch again gives the same files.
    """

    path: str
    threshold: int = FAILURE_THRESHOLD
    range_size: int = RANGE_SIZE

    @property
    def versions(self) -> Versions:
        return Versions(f"{self.path}/state", OUTAGE_STATE)

    def state(self, spark: SparkSession, below: int | None = None) -> DataFrame:
        """The unfinished run of each provider (failures 0: none)."""
        return self.versions.read(spark, below)

    def ended(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/ended").drop("batch")

    def open(self, spark: SparkSession) -> DataFrame:
        """Outages that have not ended."""
        return self.state(spark).where(F.col("failures") >= self.threshold).drop("after_seq")

    def write(self, calls: DataFrame, batch_id: int) -> None:
        spark = calls.sparkSession
        held = self.state(spark, batch_id)
        numbered = number_failures(calls, self.range_size, held)
        opened = held.select(
            "provider", F.col("after_seq").alias("h_after"),
            F.col("opened_seq").alias("h_opened_seq"), F.col("opened_ts").alias("h_opened_ts"),
        )
        runs = long_runs(numbered, self.threshold).join(opened, "provider", "left")
        goes_on = F.col("after_seq").eqNullSafe(F.col("h_after"))
        runs = runs.select(
            "provider", "after_seq", "failures",
            F.coalesce("opened_seq", F.when(goes_on, F.col("h_opened_seq"))).alias("opened_seq"),
            F.coalesce("opened_ts", F.when(goes_on, F.col("h_opened_ts"))).alias("opened_ts"),
            "closed_seq", "closed_ts",
        )
        runs.where(F.col("closed_seq").isNotNull()).drop("after_seq").write.mode(
            "overwrite"
        ).parquet(f"{self.path}/ended/batch={batch_id}")
        self.versions.write(self._next_state(numbered, runs, held).coalesce(1), batch_id)

    def _next_state(self, numbered: DataFrame, runs: DataFrame, held: DataFrame) -> DataFrame:
        """One row per provider; a provider without calls keeps its row."""
        last = numbered.groupBy("provider").agg(
            F.max(F.when(~F.col("failed"), F.col("arrival_seq"))).alias("ok_seq"),
            F.max_by(
                F.when(F.col("failed"), F.col("nth")).otherwise(0), F.col("arrival_seq")
            ).alias("failures"),
        )
        still = runs.where(F.col("closed_seq").isNull()).select("provider", "opened_seq", "opened_ts")
        seen = last.join(still, "provider", "left").join(
            held.select("provider", F.col("after_seq").alias("held_ok")), "provider", "left"
        )
        return seen.select(
            "provider", F.coalesce("ok_seq", "held_ok").alias("after_seq"),
            "failures", "opened_seq", "opened_ts",
        ).unionByName(held.join(last.select("provider"), "provider", "left_anti"))

    def start(self, calls: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = calls.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        if once:
            return writer.trigger(availableNow=True).start()
        return writer.start()
