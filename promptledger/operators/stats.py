"""Cost and security statistics over an audit ledger.

Any DataFrame with the ledger columns is a source: a table, a stream batch, a
ring of the last records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.operators.ledger import plain_decimal
from promptledger.schemas import LEDGER_FINDINGS, MONEY

RING_CAPACITY = 1_000
RECENT_DEFAULT = 50
RECENT_MAX = 1_000
DASHBOARD_ROWS = 25
STALE_SECONDS = 15
REFRESH_SECONDS = 5
ALERT_RATE = 0.1

BY_MIDDLEWARE = "rejecting_middleware"
BY_MODEL = "model"
BY_SCANNER = "scanner"


def summary_columns() -> list[Column]:
    """The aggregates of the summary; each is partial before the shuffle."""
    rejected = F.count_if(F.col("verdict") != "allowed")
    total = F.count("*")
    return [
        total.alias("total_requests"),
        F.count_if(F.col("verdict") == "allowed").alias("allowed"),
        rejected.alias("rejected"),
        F.coalesce(F.try_divide(rejected, total), F.lit(0.0)).alias("rejection_rate"),
        F.coalesce(F.sum("estimated_cost_usd"), F.lit(0)).cast(MONEY).alias(
            "total_estimated_cost_usd"
        ),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    ]


def summary(ledger: DataFrame) -> DataFrame:
    """One row of totals; all zeros for an empty ledger."""
    return ledger.agg(*summary_columns())


def category_marks(ledger: DataFrame) -> DataFrame:
    """(by, category, place): what a record adds to the three breakdowns, one row each."""
    mark = lambda by, category, nth: F.struct(
        F.lit(by).alias("by"), category.alias("category"),
        F.struct(F.col("arrival_seq"), nth.alias("finding_no")).alias("place"),
    )
    one = F.lit(0)
    marks = F.concat(
        F.array(mark(BY_MIDDLEWARE, F.col(BY_MIDDLEWARE), one), mark(BY_MODEL, F.col(BY_MODEL), one)),
        F.transform(
            F.coalesce("findings", F.array().cast(LEDGER_FINDINGS)),
            lambda f, i: mark(BY_SCANNER, f["scanner"], i),
        ),
    )
    return ledger.select(F.inline(marks)).where(F.col("category").isNotNull())


def category_counts(ledger: DataFrame) -> DataFrame:
    """(by, category, n, first_place) of all three breakdowns: counts and first places merge,
    so a stream keeps one short row per category."""
    return category_marks(ledger).groupBy("by", "category").agg(
        F.count("*").alias("n"), F.min("place").alias("first_place")
    )


def ranked_categories(counts: DataFrame, by: str) -> DataFrame:
    """One breakdown of the counts: most first, ties by first seen."""
    if by not in (BY_MIDDLEWARE, BY_MODEL, BY_SCANNER):
        raise ValueError(f"unknown breakdown: {by}")
    chosen = counts.where(F.col("by") == by).orderBy(F.desc("n"), F.asc("first_place"))
    return chosen.select("category", "n", F.col("first_place.arrival_seq").alias("first_seen"))


def breakdown(ledger: DataFrame, by: str, ordered: bool = True) -> DataFrame:
    """Counts per middleware, model or scanner: most first, ties by first seen."""
    if by == BY_SCANNER:
        seen = ledger.select(
            "arrival_seq", F.posexplode("findings").alias("finding_no", "finding")
        ).select(
            F.col("finding.scanner").alias("category"),
            F.struct("arrival_seq", "finding_no").alias("place"),
        )
    elif by in (BY_MIDDLEWARE, BY_MODEL):
        seen = ledger.select(
            F.col(by).alias("category"), F.struct("arrival_seq").alias("place")
        ).where(F.col("category").isNotNull())
    else:
        raise ValueError(f"unknown breakdown: {by}")
    counted = seen.groupBy("category").agg(
        F.count("*").alias("n"),
        F.min("place.arrival_seq").alias("first_seen"),
        *([F.min("place").alias("first_place")] if by == BY_SCANNER else []),
    )
    if not ordered:
        return counted.select("category", "n", "first_seen")
    tie = "first_place" if by == BY_SCANNER else "first_seen"
    return counted.orderBy(F.desc("n"), F.asc(tie)).select("category", "n", "first_seen")


def shares(counted: DataFrame) -> DataFrame:
    """Each category's count as a percentage of the largest one."""
    largest = counted.agg(F.max("n").alias("largest")).scalar()
    return counted.withColumn("share_of_max", F.col("n") / largest * 100)


def ring(ledger: DataFrame, capacity: int = RING_CAPACITY) -> DataFrame:
    """The last records by arrival, newest first."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    return ledger.orderBy(F.desc("arrival_seq")).limit(capacity)


def recent(ledger: DataFrame, limit: int = RECENT_DEFAULT) -> DataFrame:
    """The newest records; the limit is 1 to 1000."""
    if not 1 <= limit <= RECENT_MAX:
        raise ValueError(f"limit must be between 1 and {RECENT_MAX}")
    return ring(ledger, limit)


def alert_level(rejection_rate: Column) -> Column:
    return (
        F.when(rejection_rate > ALERT_RATE, "danger").when(rejection_rate > 0, "warn").otherwise("ok")
    )


def age_label(timestamp: Column, as_of: Column) -> Column:
    """just now / s / m / h ago; the future counts as now."""
    millis = F.greatest(F.unix_millis(as_of) - F.unix_millis(timestamp), F.lit(0))

    def ago(unit_ms: int, unit: str) -> Column:
        return F.concat(F.floor(millis / unit_ms).cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(millis < 1_000, "just now")
        .when(millis < 60_000, ago(1_000, "s"))
        .when(millis < 3_600_000, ago(60_000, "m"))
        .otherwise(ago(3_600_000, "h"))
    )


def is_stale(last_refresh: Column, as_of: Column) -> Column:
    return F.unix_millis(as_of) - F.unix_millis(last_refresh) > STALE_SECONDS * 1_000


def recent_table(ledger: DataFrame, as_of: Column, rows: int = DASHBOARD_ROWS) -> DataFrame:
    """The nine display fields of the newest records."""
    lines = F.transform(
        "findings",
        lambda f: F.concat(f["scanner"], F.lit("/"), f["kind"], F.lit(" · "), f["preview"]),
    )
    newest = recent(ledger, rows)
    dash = F.lit("—")
    return newest.select(
        "arrival_seq",
        age_label(F.col("timestamp"), as_of).alias("age"),
        "provider", "model", "verdict",
        F.coalesce("rejecting_middleware", F.lit("")).alias("rejecting_middleware"),
        F.coalesce(F.format_number("token_count", 0), dash).alias("tokens"),
        F.coalesce(
            F.concat(F.lit("$"), plain_decimal(F.col("estimated_cost_usd"))), dash
        ).alias("cost"),
        F.concat(F.format_string("%.2f", "latency_ms"), F.lit(" ms")).alias("latency"),
        F.array_join(lines, "\n").alias("findings"),
    )
