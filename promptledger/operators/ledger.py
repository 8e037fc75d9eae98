"""The audit ledger: one record per decided request."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptledger.functions.findings import has_marker
from promptledger.functions.rules import CATALOGUE, SecretRule
from promptledger.schemas import LEDGER, LEDGER_FINDINGS, MONEY, empty, nothing
from promptledger.session import settle

UPSTREAM_COLUMNS = ("request_id", "upstream_status_code", "upstream_error", "latency_ms")


def _ledger_finding(scanner: str, f: Column) -> Column:
    return F.struct(
        F.lit(scanner).alias("scanner"), f["kind"].alias("kind"), f["label"].alias("label"),
        f["severity"].alias("severity"), f["preview"].alias("preview"),
    )


def flatten_findings(df: DataFrame, stages: Sequence[str]) -> Column:
    """Findings of all stages in chain order, with the stage as scanner.

    Spans are left out (a rewrite makes them meaningless) and so are findings
    that lack a key.
    """
    lists = []
    for name in stages:
        note = df.schema[name].dataType
        if not isinstance(note, T.StructType) or "findings" not in note.names:
            continue
        named = F.transform(F.col(f"{name}.findings"), partial(_ledger_finding, name))
        lists.append(F.coalesce(named.cast(LEDGER_FINDINGS), empty(LEDGER_FINDINGS)))
    if not lists:
        return empty(LEDGER_FINDINGS)
    return F.filter(
        F.concat(*lists),
        lambda f: f["kind"].isNotNull() & f["label"].isNotNull()
        & f["severity"].isNotNull() & f["preview"].isNotNull(),
    )


def token_figures(df: DataFrame, stage: str = "tokenomics") -> tuple[Column, Column]:
    """Token count and cost of the token stage; absent or malformed gives NULL."""
    absent = nothing("int"), nothing(MONEY)
    if stage not in df.columns or not isinstance(df.schema[stage].dataType, T.StructType):
        return absent
    note = df.schema[stage].dataType
    tokens, spent = absent
    if "token_count" in note.names and isinstance(note["token_count"].dataType, T.IntegralType):
        tokens = F.col(f"{stage}.token_count").cast("int")
    if "estimated_cost_usd" in note.names:
        spent = F.col(f"{stage}.estimated_cost_usd").try_cast(MONEY)
    return tokens, spent


def build_ledger(decided: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Decided rows to audit records; error rows leave none.

    An upstream failure keeps the verdict: only a stage rejects. Columns
    latency_ms, upstream_status_code and upstream_error are used when present.
    """
    tokens, spent = token_figures(decided)
    given = {
        "timestamp": F.col("arrival_ts"),
        "reject_reason": F.col("reject.reason"),
        "reject_status_code": F.col("reject.status_code"),
        "token_count": tokens,
        "estimated_cost_usd": spent,
        "findings": flatten_findings(decided, stages),
        "latency_ms": F.col("latency_ms") if "latency_ms" in decided.columns else F.lit(0.0),
    }
    for name in ("upstream_status_code", "upstream_error"):
        if name not in decided.columns:
            given[name] = F.lit(None)
    return decided.where(F.col("error_code").isNull()).select(
        *[
            given.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in LEDGER.fields
        ]
    )


def first_per_request(df: DataFrame, key: str = "request_id", order: str = "arrival_seq") -> DataFrame:
    """The earliest row of each key.

    Copies of one key collapse on the map side before the shuffle, so a key
    that a third of the rows share costs no more than any other. Rows without a
    key are no copies of each other and all stay.
    """
    rest = [c for c in df.columns if c != key]
    lone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    picked = df.withColumn("_lone", lone).groupBy(key, "_lone").agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    )
    return picked.select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in df.columns])


def attach_upstream(decisions: DataFrame, calls: DataFrame, answer_within: str | None = None) -> DataFrame:
    """Add the upstream outcome to allowed decisions; rejected ones were never sent.

    Both sides are reduced to one row per request first, so every decision
    comes out exactly once. ``answer_within`` (such as ``1 hour``) bounds the time from
    the decision's ``timestamp`` to the call's ``ts``, as the stream form does; a call
    outside it is no answer.
    """
    outcome = first_per_request(calls, order="call_seq").select(
        "request_id",
        F.col("upstream_status_code").alias("_status"),
        F.col("upstream_error").alias("_error"),
        F.col("latency_ms").alias("_latency"),
        *([F.col("ts").alias("_ts")] if answer_within else []),
    )
    joined = first_per_request(decisions).join(outcome, "request_id", "left")
    sent = F.col("verdict") == "allowed"
    if answer_within:
        sent = sent & F.coalesce(in_time(F.col("timestamp"), F.col("_ts"), answer_within), F.lit(False))
    failed = F.col("_error").isNotNull()
    return joined.withColumns(
        {
            "upstream_status_code": F.when(sent & ~failed, F.col("_status")),
            "upstream_error": F.when(sent, F.col("_error")),
            "latency_ms": F.coalesce(F.when(sent, F.col("_latency")), F.col("latency_ms")),
        }
    ).select(*decisions.columns)


def in_time(decided: Column, called: Column, answer_within: str) -> Column:
    """Whether a call is the answer to a decision: not before it, and not too long after."""
    return (called >= decided) & (called <= decided + F.expr(f"INTERVAL {answer_within}"))


def response_status(decided: DataFrame) -> Column:
    """404 or 400 for bad requests, the reject status, 502, or the upstream's own."""
    columns = set(decided.columns)
    error = F.col("error_status") if "error_status" in columns else nothing("int")
    if "error_code" in columns:
        error = F.coalesce(error, F.when(F.col("error_code").isNotNull(), 500))
    refused = (
        F.col("reject.status_code") if "reject" in columns else F.col("reject_status_code")
    )
    return F.coalesce(
        error, refused, F.when(F.col("upstream_error").isNotNull(), 502),
        F.col("upstream_status_code"),
    ).cast("int")


def leaks(table: DataFrame, rules: Sequence[SecretRule] = CATALOGUE) -> DataFrame:
    """Rows of any table whose JSON form holds a catalogue secret; must be empty."""
    whole = settle(table.select(F.to_json(F.struct("*")).alias("record")), "record")
    hit = F.lit(False)
    for rule in rules:
        hit = hit | (
            has_marker(F.col("record"), rule.markers)
            & F.col("record").rlike("(?U)" + rule.pattern)
        )
    return whole.where(hit)


def json_ready(ledger: DataFrame) -> DataFrame:
    """Money as text, so no reader turns it into a binary fraction."""
    return ledger.withColumn("estimated_cost_usd", plain_decimal(F.col("estimated_cost_usd")))


def plain_decimal(amount: Column) -> Column:
    """Digits without an exponent and without trailing zeros."""
    digits = F.format_string("%s", F.format_number(amount, 18))
    bare = F.replace(digits, F.lit(","), F.lit(""))
    return F.when(
        amount.isNotNull(), F.rtrim(F.rtrim(bare, F.lit("0")), F.lit("."))
    )
