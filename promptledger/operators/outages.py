"""Upstream outages: runs of consecutive failures per provider.

The calls of a provider are one long sequence, and a provider may hold most of
all rows, so the sequence is cut into ranges of arrival numbers. Each range is
scanned on its own; only one small row per range is carried across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAILURE_THRESHOLD = 5
RANGE_SIZE = 250_000


def number_failures(
    calls: DataFrame, range_size: int = RANGE_SIZE, carried: DataFrame | None = None
) -> DataFrame:
    """Add to every call the success before it and its place in the run of failures.

    ``calls`` has provider, arrival_seq (unique), ts, failed. ``after_seq`` names
    the run (NULL before any success); ``nth`` counts the failures of the run up
    to and including the call. ``carried`` holds at most one unfinished run per
    provider from earlier input: provider, after_seq, failures.
    """
    in_part = Window.partitionBy("provider", "part").orderBy("arrival_seq")
    so_far = in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_part.rowsBetween(Window.unboundedPreceding, -1)
    ok = ~F.col("failed")
    numbered = (
        calls.select(
            "provider", "arrival_seq", "ts", "failed",
            F.floor(F.col("arrival_seq") / range_size).alias("part"),
        )
        .withColumn("fails", F.sum(F.col("failed").cast("long")).over(so_far))
        .withColumns(
            {
                "part_after": F.max(F.when(ok, F.col("arrival_seq"))).over(before),
                "fails_at_ok": F.max(F.when(ok, F.col("fails"))).over(before),
            }
        )
    )
    carry = _carry_between_ranges(numbered, carried)
    return numbered.join(carry, ["provider", "part"]).select(
        "provider", "arrival_seq", "ts", "failed",
        F.coalesce("part_after", "earlier_ok").alias("after_seq"),
        (
            F.col("fails")
            - F.coalesce("fails_at_ok", F.lit(0))
            + F.when(F.col("part_after").isNull(), F.col("carry_in")).otherwise(0)
        ).alias("nth"),
    )


def _carry_between_ranges(numbered: DataFrame, carried: DataFrame | None) -> DataFrame:
    """Per range: the last success before it and the failures since then.

    Works on one row per (provider, range).
    """
    ok = ~F.col("failed")
    ranges = numbered.groupBy("provider", "part").agg(
        F.max(F.when(ok, F.col("arrival_seq"))).alias("range_ok"),
        F.max("fails").alias("all_fails"),
        F.max(F.when(ok, F.col("fails"))).alias("fails_to_ok"),
    )
    earlier = Window.partitionBy("provider").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    tail = F.col("all_fails") - F.coalesce("fails_to_ok", F.lit(0))
    ranges = ranges.withColumn("tails", F.coalesce(F.sum(tail).over(earlier), F.lit(0)))
    ranges = ranges.withColumns(
        {
            "earlier_ok": F.max("range_ok").over(earlier),
            "tails_at_ok": F.max(F.when(F.col("range_ok").isNotNull(), F.col("tails"))).over(earlier),
        }
    )
    since = F.col("tails") - F.coalesce("tails_at_ok", F.lit(0))
    if carried is None:
        return ranges.select("provider", "part", "earlier_ok", since.alias("carry_in"))
    held = carried.select(
        "provider", F.col("after_seq").alias("held_ok"), F.col("failures").alias("held")
    )
    return ranges.join(held, "provider", "left").select(
        "provider", "part",
        F.coalesce("earlier_ok", "held_ok").alias("earlier_ok"),
        (
            since + F.when(F.col("earlier_ok").isNull(), F.coalesce("held", F.lit(0))).otherwise(0)
        ).alias("carry_in"),
    )


def long_runs(numbered: DataFrame, threshold: int = FAILURE_THRESHOLD) -> DataFrame:
    """Runs of at least ``threshold`` failures, one row each.

    Only calls past the threshold are shuffled. An opening in earlier input
    leaves opened_* NULL; a run that goes on leaves closed_* NULL.
    """
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    failed = F.col("failed")
    opening = failed & (F.col("nth") == threshold)
    return (
        numbered.where(F.col("nth") >= threshold)
        .groupBy("provider", "after_seq")
        .agg(
            F.max("nth").alias("failures"),
            F.max(F.when(opening, F.col("arrival_seq"))).alias("opened_seq"),
            F.max(F.when(opening, F.col("ts"))).alias("opened_ts"),
            F.max(F.when(~failed, F.col("arrival_seq"))).alias("closed_seq"),
            F.max(F.when(~failed, F.col("ts"))).alias("closed_ts"),
        )
    )


def outages(
    calls: DataFrame, threshold: int = FAILURE_THRESHOLD, range_size: int = RANGE_SIZE
) -> DataFrame:
    """From the threshold-th failure in a row to the next success (NULL: still open)."""
    return long_runs(number_failures(calls, range_size), threshold).drop("after_seq")
