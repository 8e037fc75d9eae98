import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import SECRETS
from promptledger.operators import ledger
from promptledger.sources import ledgers
from records import finding, frame, record, rejected


def ids(df):
    return sorted(r["request_id"] for r in df.collect())


# ---------------------------------------------------------------- operators


def test_first_record_of_an_id_wins_even_when_one_id_has_most_rows(spark):
    hot = [record(i, request_id="hot", model=f"m{i}") for i in range(400, 0, -1)]
    out = ledger.first_per_request(frame(spark, *hot, record(900)).repartition(8))
    rows = {r["request_id"]: r for r in out.collect()}
    assert set(rows) == {"hot", "id-900"} and rows["hot"]["model"] == "m1"
    assert out.columns == frame(spark, record(1)).columns


def calls(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "call_seq long, request_id string, upstream_status_code int, upstream_error string, latency_ms double",
    )


def test_upstream_outcomes(spark):
    decisions = frame(
        spark, record(1, upstream_status_code=None), record(2, upstream_status_code=None),
        rejected(3), record(4, upstream_status_code=None), record(5, request_id="id-1"),
    )
    out = ledger.attach_upstream(
        decisions,
        calls(
            spark, (1, "id-1", 200, None, 7.0), (2, "id-1", 500, None, 9.0),
            (3, "id-2", None, "refused", 8.0), (4, "id-3", 200, None, 6.0), (5, "other", 200, None, 1.0),
        ),
    )
    rows = {r["request_id"]: r for r in out.collect()}
    assert len(rows) == out.count() == 4
    got = {k: (r["upstream_status_code"], r["upstream_error"], r["latency_ms"]) for k, r in rows.items()}
    assert got == {
        "id-1": (200, None, 7.0), "id-2": (None, "refused", 8.0),
        "id-3": (None, None, 1.5), "id-4": (None, None, 1.5),
    }
    assert rows["id-2"]["verdict"] == "allowed"
    status = {r[0]: r[1] for r in out.select("request_id", ledger.response_status(out)).collect()}
    assert status == {"id-1": 200, "id-2": 502, "id-3": 403, "id-4": None}


def test_malformed_token_notes_give_null(spark):
    def figures(select):
        df = spark.range(1).selectExpr(select)
        tokens, spent = ledger.token_figures(df)
        return tuple(df.select(tokens, spent).first())

    assert figures("struct(5 AS token_count, '0.5' AS estimated_cost_usd) AS tokenomics") == (5, Decimal("0.5"))
    assert figures("struct('5' AS token_count, 'x' AS estimated_cost_usd) AS tokenomics") == (None, None)
    assert figures("'text' AS tokenomics") == (None, None)
    assert figures("1 AS other") == (None, None)


@pytest.mark.parametrize(
    "amount, text", [("0", "0"), ("0.00000015", "0.00000015"), ("12.500", "12.5"), ("1234567", "1234567"), ("100", "100")]
)
def test_plain_decimal(spark, amount, text):
    df = spark.range(1).select(ledger.plain_decimal(F.lit(amount).cast("decimal(38,18)")))
    assert df.first()[0] == text


def test_leak_check_finds_each_kind(spark):
    rows = [record(i, upstream_error=f"got {value} back") for i, value in enumerate(SECRETS.values())]
    assert ledger.leaks(frame(spark, *rows, record(99))).count() == len(SECRETS)


# ---------------------------------------------------------------- sinks


def sample(spark):
    return frame(
        spark, record(1, findings=[finding()], model="größe"), rejected(2, findings=[finding("secret_scan")]),
        record(3, estimated_cost_usd=None), record(4, request_id="id-1", model="later"),
    )


def test_json_lines(spark, tmp_path):
    sink = ledgers.JsonLines(str(tmp_path / "j"))
    sink.write(sample(spark))
    sink.write(frame(spark, record(9)))
    lines = [json.loads(r.value) for r in spark.read.text(sink.path).collect()]
    assert len(lines) == 5
    one = next(line for line in lines if line["arrival_seq"] == 1)
    assert one["estimated_cost_usd"] == "0.00000015" and one["rejecting_middleware"] is None
    assert one["findings"] == [finding()] and one["model"] == "größe"
    back = ledgers.read_json_lines(spark, sink.path).where("arrival_seq <= 4").orderBy("arrival_seq")
    assert back.collect() == sample(spark).orderBy("arrival_seq").collect()


@pytest.mark.parametrize("as_json", [True, False])
@pytest.mark.parametrize("days_back", [None, 1])
def test_table_stores_an_id_once(spark, tmp_path, as_json, days_back):
    sink = ledgers.LedgerTable(str(tmp_path), "my_table", as_json, days_back)
    sink.write(sample(spark))
    sink.write(frame(spark, record(5, request_id="id-2"), record(6)))
    rows = ledgers.read_table(spark, sink.path, sink.table, as_json)
    assert ids(rows) == ["id-1", "id-2", "id-3", "id-6"]
    first = rows.where("request_id = 'id-1'").first()
    assert first["model"] == "größe" and first["findings"][0].asDict() == finding()
    assert first["estimated_cost_usd"] == Decimal("0.00000015")
    plan = rows.where("day = DATE '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


@pytest.mark.parametrize("name", ["a b", "x;drop", "", "_", "a-b"])
def test_table_names(name):
    with pytest.raises(ValueError):
        ledgers.LedgerTable("p", name)


def test_log_events(spark, tmp_path):
    sink = ledgers.LogEvents(str(tmp_path / "l"))
    sink.write(sample(spark))
    events = [json.loads(r.value) for r in spark.read.text(sink.path).collect()]
    assert {(e["event"], e["level"]) for e in events} == {("audit.request", "info")}
    assert list(events[0])[:2] == ["event", "level"] and events[0]["estimated_cost_usd"] in ("0.00000015", None)


def test_ring_keeps_the_last(spark, tmp_path):
    ring = ledgers.Ring(str(tmp_path / "r"), 2)
    assert ring.read(spark).count() == 0
    ring.write(frame(spark, record(1), record(2), record(3)))
    assert ids(ring.read(spark)) == ["id-2", "id-3"]
    ring.write(frame(spark, record(4)))
    ring.write(frame(spark, record(4)), version=1)
    assert ids(ring.read(spark)) == ["id-3", "id-4"]
    with pytest.raises(ValueError):
        ledgers.Ring("x", 0)


class Broken:
    def write(self, records):
        raise OSError("disk full")


class Kept:
    """A sink as a user would write it."""

    def __init__(self):
        self.seen = []

    def write(self, records):
        self.seen = ids(records)


def test_fan_out_isolates_failures(spark, tmp_path):
    before, after = Kept(), Kept()
    failed = ledgers.FanOut([before, Broken(), after]).write(frame(spark, record(1), record(2)))
    assert before.seen == after.seen == ["id-1", "id-2"]
    assert [type(s) for s, _ in failed] == [Broken] and "disk full" in str(failed[0][1])
    with pytest.raises(ValueError):
        ledgers.FanOut([])


def test_fan_out_computes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def touch(value):
        seen.add(1)
        return value

    records = frame(spark, record(1), record(2)).withColumn("model", touch("model"))
    ledgers.FanOut([Kept(), Kept(), ledgers.Discard()]).write(records)
    assert seen.value == 2


def test_sink_choice():
    assert isinstance(ledgers.choose_sinks(enabled=False, json_path="j"), ledgers.Discard)
    assert isinstance(ledgers.choose_sinks(), ledgers.Discard)
    chosen = ledgers.choose_sinks(ring_path="r", ring_capacity=5, json_path="j", table_path="t", log_path="l")
    assert chosen.sinks == [
        ledgers.Ring("r", 5), ledgers.JsonLines("j"), ledgers.LedgerTable("t"), ledgers.LogEvents("l"),
    ]


@pytest.mark.parametrize("days_back", [None, 1])
def test_records_without_a_time_or_an_id(spark, tmp_path, days_back):
    sink = ledgers.LedgerTable(str(tmp_path), days_back=days_back)
    rows = frame(spark, record(1), record(2)).withColumn("timestamp", F.lit(None).cast("timestamp"))
    for _ in range(2):
        sink.write(rows)
    assert ids(ledgers.read_table(spark, sink.path)) == ["id-1", "id-2"]
    nameless = frame(spark, record(3), record(4)).withColumn("request_id", F.lit(None).cast("string"))
    assert ledger.first_per_request(nameless).count() == 2


def _history_is_shuffled(df):
    """Whether an exchange stands between the join and the table's scan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*!()0123456789"))
    (at,) = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
    above, found = depth(lines[at]), False
    for line in reversed(lines[:at]):
        if depth(line) < above:
            above = depth(line)
            if "Join" in line:
                return found
            found = found or "Exchange" in line
    raise AssertionError("no join above the scan")


@pytest.mark.parametrize("days_back", [None, 1])
def test_table_writes_again_add_nothing(spark, tmp_path, days_back):
    sink = ledgers.LedgerTable(str(tmp_path), days_back=days_back, buckets=4)
    named = frame(spark, *[record(i) for i in range(20)])
    nameless = named.withColumn("request_id", F.lit(None).cast("string"))
    timeless = nameless.withColumn("timestamp", F.lit(None).cast("timestamp"))
    equal = nameless.limit(1).withColumn("arrival_seq", F.lit(None).cast("long"))
    many = equal.crossJoin(spark.range(ledgers.COPIES + 5)).drop("id")
    batches = [named, nameless, timeless, many, named.unionByName(nameless).unionByName(timeless)]
    for _ in range(2):
        for batch in batches:
            sink.write(batch)
    stored = ledgers.read_table(spark, sink.path)
    assert stored.where("request_id IS NOT NULL").count() == 20
    assert stored.where("request_id IS NULL AND day IS NOT NULL AND arrival_seq IS NOT NULL").count() == 20
    assert stored.where("day IS NULL").count() == 20
    assert stored.where("arrival_seq IS NULL").count() == ledgers.COPIES + 5
    if days_back is None:  # the few rows of two days are broadcast
        assert not _history_is_shuffled(sink.missing(named))


def test_table_outlives_its_session(spark, tmp_path):
    sink = ledgers.LedgerTable(str(tmp_path), buckets=3)
    rows = frame(spark, *[record(i) for i in range(30)]).withColumn(
        "timestamp", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("arrival_seq") * 40_000)
    )
    sink.write(rows.where("arrival_seq < 20"))
    spark.sql(f"DROP TABLE {sink.catalog_name}")  # what a new session's catalog knows
    sink.write(rows)
    assert ids(ledgers.read_table(spark, sink.path)) == sorted(f"id-{i}" for i in range(30))


def test_a_write_cut_short_is_made_whole(spark, tmp_path):
    sink = ledgers.LedgerTable(str(tmp_path), buckets=2)
    rows = frame(spark, *[record(i, request_id=None if i % 3 else f"id-{i}") for i in range(30)])
    sink.write(rows.where("arrival_seq < 11"))  # as much as became visible
    sink.write(rows)
    assert ledgers.read_table(spark, sink.path).count() == 30
    assert sink.missing(rows).count() == 0 and sink.missing(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ledgers.LedgerTable("p", buckets=0)
