"""Batch reports: per-file results, text lines, totals and the exit gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptledger.operators.ledger import plain_decimal


def _note_json(df: DataFrame, name: str) -> Column:
    """A stage's notes for display: spans as pairs, money as text."""
    note = df.schema[name].dataType
    members = []
    for member in note.names:
        value = F.col(f"{name}.{member}")
        if member == "findings":
            value = F.transform(
                value,
                lambda f: F.struct(
                    f["kind"].alias("kind"), f["label"].alias("label"),
                    f["preview"].alias("preview"), f["severity"].alias("severity"),
                    F.array(f["span_start"], f["span_end"]).alias("span"),
                ),
            )
        elif isinstance(note[member].dataType, T.DecimalType):
            value = plain_decimal(value)
        members.append(value.alias(member))
    return F.when(F.col(name).isNotNull(), F.struct(*members))


def annotations_json(df: DataFrame, stages: Sequence[str]) -> Column:
    """Notes of the stages that ran, as one JSON object."""
    if not stages:
        return F.lit("{}")
    return F.to_json(F.struct(*[_note_json(df, s).alias(s) for s in sorted(stages)]))


def file_results(decided: DataFrame, stages: Sequence[str]) -> DataFrame:
    """One row per readable file: verdict, stage, notes and reject as JSON."""
    return decided.where(F.col("error_code").isNull()).select(
        "position", F.col("label").alias("file"), "verdict", "rejecting_middleware",
        annotations_json(decided, stages).alias("annotations"),
        F.to_json("reject").alias("reject"),
    )


def batch_summary(decided: DataFrame) -> DataFrame:
    """scanned / allowed / rejected over the readable files."""
    read = F.col("error_code").isNull()
    return decided.agg(
        F.count_if(read).alias("scanned"),
        F.count_if(read & F.col("reject").isNull()).alias("allowed"),
        F.count_if(read & F.col("reject").isNotNull()).alias("rejected"),
    )


def _finding_line(f: Column) -> Column:
    return F.concat(
        F.lit("    - "), F.coalesce(f["label"], f["kind"]),
        F.lit(" severity="), f["severity"], F.lit(" preview="), f["preview"],
    )


def _rejecting_findings(df: DataFrame, stages: Sequence[str]) -> Column:
    """Report lines for the findings of the stage that rejected."""
    lines = F.array().cast("array<string>")
    for name in stages:
        if "findings" in df.schema[name].dataType.names:
            lines = F.when(
                F.col("rejecting_middleware") == name,
                F.coalesce(F.transform(F.col(f"{name}.findings"), _finding_line), F.array()),
            ).otherwise(lines)
    return lines


def _verdict_line(subject: Column) -> Column:
    failed = F.concat(
        subject, F.lit(": FAIL ("), F.col("rejecting_middleware"), F.lit(": "),
        F.col("reject.reason"), F.lit(")"),
    )
    return F.when(F.col("reject").isNull(), F.concat(subject, F.lit(": PASS"))).otherwise(failed)


def without_prompts(decided: DataFrame, stages: Sequence[str]) -> DataFrame:
    """What reports need of decided files: no prompt, no body."""
    kept = ("position", "label", "error_code", "verdict", "reject", "rejecting_middleware")
    return decided.select(*kept, *stages)


def report_lines(decided: DataFrame, stages: Sequence[str]) -> DataFrame:
    """The text report as rows, the totals line last.

    Order by position, file and line_no when writing; nothing is sorted before.
    ``decided`` is read twice, so store it first, but for the prompts
    (``session.cut_lineage`` of ``without_prompts``).
    """
    lines = F.when(
        F.col("error_code").isNull(),
        F.concat(F.array(_verdict_line(F.col("label"))), _rejecting_findings(decided, stages)),
    )
    body = decided.select(
        "position", F.col("label").alias("file"), F.posexplode(lines).alias("line_no", "line")
    )
    totals = batch_summary(decided).select(
        F.lit(2**63 - 1).alias("position"),
        F.lit("").alias("file"),
        F.lit(0).alias("line_no"),
        F.concat(
            F.lit("summary: scanned="), F.col("scanned").cast("string"),
            F.lit(" allowed="), F.col("allowed").cast("string"),
            F.lit(" rejected="), F.col("rejected").cast("string"),
        ).alias("line"),
    )
    return body.unionByName(totals)


def decision_json(decided: DataFrame, stages: Sequence[str]) -> Column:
    """One decision as a JSON object with its four keys in order."""
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    return F.concat(
        F.lit('{"annotations":'), annotations_json(decided, stages),
        F.lit(',"reject":'), F.coalesce(F.to_json("reject"), F.lit("null")),
        F.lit(',"rejecting_middleware":'), quoted(F.col("rejecting_middleware")),
        F.lit(',"verdict":'), quoted(F.col("verdict")), F.lit("}"),
    )


def _stage_lines(df: DataFrame, name: str) -> Column:
    """The figures and findings of one stage that ran."""
    note = df.schema[name].dataType
    figures = []
    for member in ("token_count", "estimated_cost_usd", "finding_count"):
        if member in note.names:
            value = F.col(f"{name}.{member}")
            if isinstance(note[member].dataType, T.DecimalType):
                value = plain_decimal(value)
            figures.append(F.concat(F.lit(f"{member}="), value.cast("string")))
    head = F.concat(F.lit(f"  [{name}] "), F.concat_ws(" ", *figures))
    lines = F.array(head) if figures else F.array().cast("array<string>")
    if "findings" in note.names:
        found = F.transform(F.col(f"{name}.findings"), _finding_line)
        lines = F.concat(lines, F.coalesce(found, F.array()))
    return F.when(F.col(name).isNotNull(), lines).otherwise(F.array())


def decision_text(decided: DataFrame, stages: Sequence[str]) -> Column:
    """One decision as text: verdict, detail, then a line per stage and finding."""
    detail = F.when(
        F.col("reject").isNotNull(), F.array(F.concat(F.lit("  "), F.col("reject.detail")))
    ).otherwise(F.array())
    lines = F.concat(
        F.array(_verdict_line(F.lit("guardrail"))), detail,
        *[_stage_lines(decided, s) for s in stages],
    )
    return F.array_join(lines, "\n")


def _gate(among: Column) -> Column:
    """The gate of the rows that a condition names, as an aggregate."""
    some = lambda c: F.coalesce(F.bool_or(among & c), F.lit(False))
    return F.when(some(F.col("error_code").isNotNull()), 2).when(some(F.col("reject").isNotNull()), 1).otherwise(0)


def gate(decided: DataFrame) -> DataFrame:
    """0 all clean, 1 something rejected, 2 something unreadable."""
    return decided.agg(_gate(F.lit(True)).alias("gate"))


def gates(decided: DataFrame, batches: Mapping[str, Column]) -> DataFrame:
    """(batch, gate) of several batches of the same files, each named by a condition, in
    one pass over them."""
    each = F.array(*(F.struct(F.lit(name).alias("batch"), _gate(rows).alias("gate")) for name, rows in batches.items()))
    return decided.agg(each.alias("each")).select(F.inline("each"))
