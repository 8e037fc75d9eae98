"""Column expressions that find, describe and mask matches in a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptledger.functions.rules import CATALOGUE, SecretRule
from promptledger.schemas import FINDINGS, empty

_SPANS = "array<struct<span_start:int,span_end:int,matched:string>>"
#: Array elements that are added up in one go.
BLOCK = 512

HIGH_SCORE = 0.85
MEDIUM_SCORE = 0.6


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def unicode_aware(pattern: str) -> str:
    """Word characters, digits and spaces as Unicode defines them, on any JDK."""
    return "(?U)" + pattern


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def has_marker(text: Column, markers: Sequence[str]) -> Column:
    """Cheap literal test before a regular expression."""
    test = F.lit(not markers)
    for marker in markers:
        test = test | F.contains(text, F.lit(marker))
    return test


def running_totals(lengths: str) -> str:
    """SQL for the inclusive running totals of an array of integers.

    Arrays can only grow by copying, so the totals are built in blocks: a text with
    ten times the matches takes about ten times as long.
    """
    return f"""transform(array(transform(sequence(0, CAST(size({lengths}) / {BLOCK} AS INT)),
        k -> slice({lengths}, k * {BLOCK} + 1, {BLOCK}))), blocks ->
      flatten(zip_with(blocks,
        slice(aggregate(blocks, array(0), (offs, b) -> array_append(offs,
          element_at(offs, -1) + aggregate(b, 0, (x, y) -> x + y))), 1, size(blocks)),
        (b, off) -> slice(aggregate(b, array(off), (ends, n) -> array_append(ends,
          element_at(ends, -1) + n)), 2, size(b)))))[0]"""


def match_spans(text: str, pattern: str, begins: str = "") -> str:
    """SQL for all matches in column ``text`` with their code-point offsets.

    ``begins`` is a pattern that every match begins with; it is tested first.

    The text between matches (``split``) and the matches themselves alternate,
    so the running length of both gives every offset.
    """
    regex = literal(unicode_aware(f"(?={begins}){pattern}" if begins else pattern))
    return f"""transform(array(regexp_extract_all({text}, {regex}, 0)), hits ->
      CASE WHEN size(hits) > 0 THEN transform(array(
          zip_with(hits, slice(split({text}, {regex}, -1), 1, size(hits)),
                   (hit, gap) -> length(gap) + length(hit))), lens ->
        zip_with(hits, {running_totals("lens")}, (hit, stop) -> struct(
          stop - length(hit) AS span_start, stop AS span_end, hit AS matched)))[0]
      ELSE CAST(array() AS {_SPANS}) END)[0]"""


def preview_sql(matched: str) -> str:
    """SQL for at most the first four and last two characters of a match."""
    return f"""CASE WHEN length({matched}) <= 6 THEN repeat('*', length({matched}))
      ELSE concat(left({matched}, 4), '***', right({matched}, 2)) END"""


def severity_sql(score: str) -> str:
    """SQL for the severity of a confidence score."""
    return f"""CASE WHEN {score} >= {HIGH_SCORE} THEN 'high' WHEN {score} >= {MEDIUM_SCORE}
      THEN 'medium' ELSE 'low' END"""


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "low", 0).when(severity == "medium", 1).when(severity == "high", 2)
    )


def worst_severity(findings: Column) -> Column:
    """The highest severity in a findings array, NULL when it is empty."""
    ranked = F.transform(
        findings,
        lambda f: F.struct(severity_rank(f["severity"]).alias("rank"), f["severity"].alias("severity")),
    )
    return F.array_max(ranked)["severity"]


_HITS = (
    "array<struct<span_start:int,position:int,span_end:int,"
    "kind:string,label:string,severity:string,preview:string>>"
)


def _rule_hits(text: str, rule: SecretRule, position: int) -> str:
    begins = "|".join(map(re.escape, rule.markers)) if rule.marker_first else ""
    described = f"""CAST(transform({match_spans(text, rule.pattern, begins)}, s -> struct(
      s.span_start, {position} AS position, s.span_end, {literal(rule.name)} AS kind,
      {literal(rule.label)} AS label, {literal(rule.severity)} AS severity,
      {preview_sql("s.matched")} AS preview
    )) AS {_HITS})"""
    if not rule.markers:
        return described
    marked = " OR ".join(f"contains({text}, {literal(m)})" for m in rule.markers)
    return f"CASE WHEN {marked} THEN {described} ELSE CAST(array() AS {_HITS}) END"


def _shortest_markers(rules: Sequence[SecretRule]) -> list[str]:
    """Markers without those that contain another one."""
    markers = {m for rule in rules for m in rule.markers}
    return sorted(m for m in markers if not any(o in m for o in markers - {m}))


def secret_findings(text: str, rules: Sequence[SecretRule] = CATALOGUE) -> Column:
    """Findings of every rule in column ``text``, by start and then rule position.

    NULL text (a row that an earlier check decided) gives NULL. A text without
    any marker is done after the marker tests, which stay in generated code.
    """
    if not rules:
        return F.when(F.col(text).isNotNull(), empty(FINDINGS))
    hits = ", ".join(_rule_hits(text, rule, i) for i, rule in enumerate(rules))
    ordered = F.expr(f"""CAST(transform(array_sort(concat({hits})), f -> struct(
      f.kind, f.label, f.severity, f.span_start, f.span_end, f.preview)) AS {FINDINGS})""")
    found = F.when(F.col(text).isNull(), F.lit(None).cast(FINDINGS))
    if all(rule.markers for rule in rules):
        found = found.when(~has_marker(F.col(text), _shortest_markers(rules)), empty(FINDINGS))
    return found.otherwise(ordered)
