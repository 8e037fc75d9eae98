"""The guardrail over a stream of requests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from promptledger.operators import stats
from promptledger.operators.ledger import build_ledger, in_time
from promptledger.operators.normalise import normalise
from promptledger.operators.stats import REFRESH_SECONDS, summary_columns
from promptledger.plans.chain import Chain
from promptledger.schemas import CATEGORY_COUNTS
from promptledger.sources.ledgers import FanOut, Sink, write_numbered
from promptledger.sources.versions import Versions


def decide_requests(requests: DataFrame, chain: Chain, source: str = "live") -> DataFrame:
    """Requests to decisions; the same plan for a table and for a stream."""
    return chain.decide(normalise(requests, chain.routes, source))


def ledger_of(requests: DataFrame, chain: Chain, source: str = "live") -> DataFrame:
    """Requests to audit records."""
    return build_ledger(decide_requests(requests, chain, source), chain.names)


def once_per_request(ledger: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop later copies of a request id that arrive within the delay.

    Copies in one micro-batch have no order among themselves; a ledger table
    sink, which orders them by arrival, keeps the first.
    """
    return ledger.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["request_id"])


def attach_upstream(
    decisions: DataFrame, calls: DataFrame, delay: str = "1 hour", answer_within: str = "1 hour"
) -> DataFrame:
    """Left outer stream join of decisions with their upstream calls.

    A decision without a call comes out once the watermark passes its time
    limit. What is still waiting when the input ends is added by
    :func:`unmatched_decisions`.
    """
    left = once_per_request(decisions, delay).alias("d")
    right = (
        calls.select(
            F.col("request_id").alias("call_id"), F.col("ts").alias("call_ts"),
            F.col("upstream_status_code").alias("call_status"),
            F.col("upstream_error").alias("call_error"), F.col("latency_ms").alias("call_latency"),
        )
        .withWatermark("call_ts", delay)
        .dropDuplicatesWithinWatermark(["call_id"])
    )
    answers = F.col("call_id") == F.col("request_id")
    sent = F.col("verdict") == "allowed"
    bound = in_time(F.col("timestamp"), F.col("call_ts"), answer_within)
    joined = left.join(right, answers & sent & bound, "left_outer")
    return joined.withColumns(
        {
            "upstream_status_code": F.when(F.col("call_error").isNull(), F.col("call_status")),
            "upstream_error": F.col("call_error"),
            "latency_ms": F.coalesce("call_latency", "latency_ms"),
        }
    ).select(*decisions.columns)


def unmatched_decisions(decisions: DataFrame, recorded: DataFrame) -> DataFrame:
    """Closing pass over tables: decisions the outer join still held back."""
    return decisions.join(recorded.select("request_id"), "request_id", "left_anti")


def start_sinks(
    ledger: DataFrame, sinks: Mapping[str, Sink], checkpoints: str, once: bool = False
) -> dict[str, StreamingQuery]:
    """One query and one checkpoint per sink, so a failed one catches up later.

    File sinks use Spark's own exactly-once writers; any other sink is written
    batch by batch.
    """
    started = {}
    for name, sink in sinks.items():
        if hasattr(sink, "stream"):
            writer = sink.stream(ledger)
        else:
            writer = ledger.writeStream.foreachBatch(lambda df, number, sink=sink: _batch(sink, df, number))
        writer = writer.option("checkpointLocation", f"{checkpoints}/{name}").queryName(name)
        started[name] = _triggered(writer, once).start()
    return started


def _batch(sink: Sink, ledger: DataFrame, number: int) -> None:
    """One batch into a sink; of several sinks, one that fails fails the batch after the
    others have it, and the batch is repeated on the next start."""
    if isinstance(sink, FanOut):
        failed = sink.write_batch(ledger, number)
        if failed:
            raise failed[0][1]
    else:
        write_numbered(sink, ledger, number)


def _triggered(writer: DataStreamWriter, once: bool) -> DataStreamWriter:
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{REFRESH_SECONDS} seconds")


def live_summary(ledger: DataFrame) -> DataFrame:
    """The running summary as a streaming aggregate (update or complete mode)."""
    return ledger.groupBy().agg(*summary_columns())


def start_summary(
    ledger: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Refresh the summary every five seconds; version N is the state after batch N."""

    return _start_totals(live_summary(ledger), path, checkpoint, once)


def live_breakdowns(ledger: DataFrame) -> DataFrame:
    """Running counts of all three breakdowns as one streaming aggregate; orders are
    taken when it is read (``stats.ranked_categories``)."""
    return stats.category_counts(ledger)


def start_breakdowns(
    ledger: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Refresh the breakdowns every five seconds; version N is the state after batch N."""
    return _start_totals(live_breakdowns(ledger), path, checkpoint, once)


def read_breakdown(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The newest state of one breakdown, in its order."""
    return stats.ranked_categories(Versions(path, CATEGORY_COUNTS).read(spark), by)


def _start_totals(totals: DataFrame, path: str, checkpoint: str, once: bool) -> StreamingQuery:
    versions = Versions(path, totals.schema)
    writer = (
        totals.writeStream.outputMode("complete")
        .foreachBatch(versions.write)
        .option("checkpointLocation", checkpoint)
    )
    return _triggered(writer, once).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped in the progress reports still held."""
    return sum(
        state.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for state in progress["stateOperators"]
    )
