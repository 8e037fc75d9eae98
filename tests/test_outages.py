import random

import pytest
from pyspark.sql import functions as F

from promptledger.operators import outages
from promptledger.streaming.outages import OutageTracker

CALL = "provider string, arrival_seq long, failed boolean"


def brute(rows, threshold):
    """A counter per provider, as calls come in."""
    found, count, current = [], {}, {}
    for provider, seq, failed in sorted(rows, key=lambda r: r[1]):
        if failed:
            count[provider] = count.get(provider, 0) + 1
            if count[provider] == threshold:
                current[provider] = seq
        else:
            if provider in current:
                found.append((provider, count[provider], current.pop(provider), seq))
            count[provider] = 0
    found += [(p, count[p], seq, None) for p, seq in current.items()]
    return sorted(found, key=str)


def random_calls(seed, n=400):
    rng = random.Random(seed)
    rows, seq, failing = [], 0, {"a": False, "b": False}
    for _ in range(n):
        seq += rng.choice([1, 1, 2, 7])
        provider = "a" if rng.random() < 0.8 else "b"
        if rng.random() < 0.1:
            failing[provider] = not failing[provider]
        rows.append((provider, seq, failing[provider] ^ (rng.random() < 0.05)))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, CALL)
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("arrival_seq")))


def found(df):
    rows = df.select("provider", "failures", "opened_seq", "closed_seq", "opened_ts", "closed_ts").collect()
    for r in rows:
        assert int(r["opened_ts"].timestamp()) - 1_700_000_000 == r["opened_seq"]
        assert (r["closed_ts"] is None) == (r["closed_seq"] is None)
    return sorted((tuple(r)[:4] for r in rows), key=str)


@pytest.mark.parametrize("range_size", [1, 3, 10, 100, 250_000])
@pytest.mark.parametrize("threshold", [1, 5])
def test_runs_across_ranges(spark, range_size, threshold):
    for seed in range(2):
        rows = random_calls(seed)
        got = outages.outages(frame(spark, rows).repartition(4), threshold, range_size)
        assert found(got) == brute(rows, threshold)


def test_one_endless_outage_and_none(spark):
    rows = [("a", i, True) for i in range(1000)] + [("b", 2000 + i, False) for i in range(50)]
    assert found(outages.outages(frame(spark, rows), 5, 64)) == [("a", 1000, 4, None)]
    assert found(outages.outages(frame(spark, rows[:4]), 5)) == []
    with pytest.raises(ValueError):
        outages.outages(frame(spark, rows), 0)


def test_no_window_over_all_calls_of_a_provider(spark):
    plan = outages.outages(frame(spark, random_calls(1)))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and "arrival_seq" in line.split("windowspec")[-1]]
    assert windows and all("part#" in line for line in windows)


@pytest.mark.parametrize("sizes", [(100, 100, 100, 100), (1, 3, 390, 6)])
def test_tracker_over_batches_equals_the_table_run(spark, tmp_path, sizes):
    rows = random_calls(7)
    tracker = OutageTracker(str(tmp_path / "t"), threshold=3, range_size=50)
    start = 0
    for batch, size in enumerate(sizes):
        part = frame(spark, rows[start : start + size])
        tracker.write(part, batch)
        if batch == 1:
            tracker.write(part, batch)
        start += size
    ended = tracker.ended(spark).select("provider", "failures", "opened_seq", "closed_seq")
    still = tracker.open(spark).selectExpr("provider", "failures", "opened_seq", "CAST(NULL AS BIGINT) AS closed_seq")
    got = sorted((tuple(r) for r in ended.unionByName(still).collect()), key=str)
    assert got == brute(rows, 3)


def test_a_quiet_provider_keeps_its_state(spark, tmp_path):
    tracker = OutageTracker(str(tmp_path / "t"), threshold=2)
    tracker.write(frame(spark, [("a", 1, True), ("a", 2, True)]), 0)
    tracker.write(frame(spark, [("b", 3, False)]), 1)
    assert [r["provider"] for r in tracker.open(spark).collect()] == ["a"]
    tracker.write(frame(spark, [("a", 4, True), ("a", 5, False)]), 2)
    assert tracker.open(spark).count() == 0
    (row,) = tracker.ended(spark).collect()
    assert (row["failures"], row["opened_seq"], row["closed_seq"]) == (3, 2, 5)
