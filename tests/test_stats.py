import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from promptledger.operators import stats
from records import START, finding, frame, record, rejected


def ordered(df):
    return [(r["category"], r["n"]) for r in df.collect()]


def test_summary_of_nothing(spark):
    row = stats.summary(frame(spark)).first()
    assert tuple(row) == (0, 0, 0, 0.0, Decimal(0), 0.0)


def test_summary(spark):
    costs = [record(i, estimated_cost_usd=Decimal("0.1")) for i in range(10)]
    row = stats.summary(frame(spark, *costs, rejected(10), rejected(11), latency_last := record(12, estimated_cost_usd=None, latency_ms=14.5))).first()
    assert (row["total_requests"], row["allowed"], row["rejected"]) == (13, 11, 2)
    assert row["rejection_rate"] == pytest.approx(2 / 13) and latency_last
    assert row["total_estimated_cost_usd"] == Decimal(1)
    assert row["avg_latency_ms"] == pytest.approx((12 * 1.5 + 14.5) / 13)


def test_breakdowns_most_first_then_first_seen(spark):
    models = "aaabbbbbcd"
    rows = [record(i, model=m) for i, m in enumerate(models)]
    assert ordered(stats.breakdown(frame(spark, *reversed(rows)), stats.BY_MODEL)) == [
        ("b", 5), ("a", 3), ("c", 1), ("d", 1),
    ]
    mixed = frame(spark, record(0), rejected(1, "tokenomics"), rejected(2), rejected(3))
    assert ordered(stats.breakdown(mixed, stats.BY_MIDDLEWARE)) == [("secret_scan", 2), ("tokenomics", 1)]
    found = frame(
        spark, record(1, findings=[finding("z"), finding("a")]), record(0), record(2, findings=[finding("b"), finding("b")])
    )
    assert ordered(stats.breakdown(found, stats.BY_SCANNER)) == [("b", 2), ("z", 1), ("a", 1)]
    with pytest.raises(ValueError):
        stats.breakdown(found, "colour")


def test_shares(spark):
    rows = [record(i, model=m) for i, m in enumerate("aaaab")]
    out = stats.shares(stats.breakdown(frame(spark, *rows), stats.BY_MODEL, ordered=False))
    assert {r["category"]: r["share_of_max"] for r in out.collect()} == {"a": 100.0, "b": 25.0}
    assert stats.shares(stats.breakdown(frame(spark), stats.BY_MODEL)).count() == 0


def test_recent_and_ring(spark):
    df = frame(spark, *[record(i, timestamp=START - dt.timedelta(days=i)) for i in range(60)])
    assert [r["arrival_seq"] for r in stats.recent(df).collect()] == list(range(59, 9, -1))
    assert stats.ring(df, 3).count() == 3
    assert stats.summary(stats.ring(df, 7)).first()["total_requests"] == 7
    for bad in (0, -1, 1001):
        with pytest.raises(ValueError):
            stats.recent(df, bad)
    with pytest.raises(ValueError):
        stats.ring(df, 0)


@pytest.mark.parametrize("rate, level", [(0.0, "ok"), (0.0001, "warn"), (0.1, "warn"), (0.1001, "danger")])
def test_alert_level(spark, rate, level):
    assert spark.range(1).select(stats.alert_level(F.lit(rate))).first()[0] == level


@pytest.mark.parametrize(
    "millis, age, stale",
    [
        (-5000, "just now", False), (0, "just now", False), (999, "just now", False), (1000, "1s ago", False),
        (15_000, "15s ago", False), (15_001, "15s ago", True), (59_999, "59s ago", True), (60_000, "1m ago", True),
        (3_599_999, "59m ago", True), (3_600_000, "1h ago", True), (90_000_000, "25h ago", True),
    ],
)
def test_age(spark, millis, age, stale):
    then, now = F.timestamp_millis(F.lit(10**12)), F.timestamp_millis(F.lit(10**12 + millis))
    row = spark.range(1).select(stats.age_label(then, now), stats.is_stale(then, now)).first()
    assert tuple(row) == (age, stale)


def test_recent_table(spark):
    df = frame(spark, record(1, token_count=12345, findings=[finding(), finding()]), rejected(2))
    rows = stats.recent_table(df, F.lit(START + dt.timedelta(seconds=62))).collect()
    assert [r["arrival_seq"] for r in rows] == [2, 1]
    assert rows[0].asDict() == {
        "arrival_seq": 2, "age": "1m ago", "provider": "openai", "model": "gpt-4o", "verdict": "rejected",
        "rejecting_middleware": "secret_scan", "tokens": "—", "cost": "—", "latency": "1.50 ms", "findings": "",
    }
    assert (rows[1]["tokens"], rows[1]["cost"]) == ("12,345", "$0.00000015")
    assert rows[1]["findings"] == "pii_scan/pii_email_address · a***b\npii_scan/pii_email_address · a***b"
