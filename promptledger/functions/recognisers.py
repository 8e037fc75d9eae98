"""Personal-data recognisers: a pattern, a check and a score per entity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptledger.functions.findings import literal, match_spans, preview_sql, severity_sql
from promptledger.schemas import FINDINGS, SWAPS

DEFAULT_THRESHOLD = 0.5

PII_HIT = (
    "struct<span_start:int,position:int,span_end:int,entity:string,score:double,matched:string>"
)
PII_HITS = f"array<{PII_HIT}>"


@dataclass(frozen=True)
class Recogniser:
    """An entity found by a pattern.

    ``marker`` is a literal, or ``gate`` a cheap pattern that begins with a
    character of class ``gate_start``, found in every text with a match; texts
    without it are not searched. Every match begins with a character of class
    ``begins``. ``check`` is SQL that keeps a match when true,
    ``score_sql`` SQL for a score that depends on the surroundings; otherwise
    ``score`` holds. Both may name {matched}, {start} and {text}.
    """

    entity: str
    pattern: str
    score: float
    marker: str | None = None
    gate: str | None = None
    gate_start: str = "0-9"
    begins: str | None = None
    check: str | None = None
    score_sql: str | None = None


LUHN_VALID = "luhn_check(regexp_replace({matched}, '[ -]', ''))"

# Country and check digits go last, letters count 10 to 35, the remainder is 1.
_COMPACT = "replace({matched}, ' ', '')"
IBAN_VALID = f"""length({_COMPACT}) >= 15 AND aggregate(
    split(concat(substr({_COMPACT}, 5), left({_COMPACT}, 4)), '(?!^)(?!$)'), 0,
    (rest, c) -> CAST(CASE WHEN ascii(c) >= 65 THEN (rest * 100 + ascii(c) - 55) % 97
                           ELSE (rest * 10 + ascii(c) - 48) % 97 END AS INT)) = 1"""

# No area 000, 666 or 9xx, no group 00, no serial 0000.
SSN_VALID = """left({matched}, 3) NOT IN ('000', '666') AND left({matched}, 1) <> '9'
    AND substr({matched}, 5, 2) <> '00' AND right({matched}, 4) <> '0000'"""

_LOCAL = "[A-Za-z0-9._%+-]"
# The local part is a whole run of its characters, of any length; the bounded second
# form is for one that follows a match directly.
EMAIL_ADDRESS = Recogniser(
    "EMAIL_ADDRESS",
    rf"(?:(?<!{_LOCAL}){_LOCAL}++|\b{_LOCAL}{{1,64}})"
    r"@[A-Za-z0-9-][A-Za-z0-9.-]*\.(?:[Xx][Nn]--[A-Za-z0-9-]+|[A-Za-z]{2,})\b",
    1.0,
    marker="@",
)


def phone_number(context_chars: int = 50) -> Recogniser:
    """Telephone numbers score 0.4 alone, and 0.75 when a telephone word stands in the
    ``context_chars`` characters before. A threshold of 0.4 or less takes both kinds."""
    before = f"""substr({{text}}, greatest({{start}} - {context_chars}, 0) + 1,
        least({{start}}, {context_chars}))"""
    return Recogniser(
        "PHONE_NUMBER",
        r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|\b[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}\b",
        0.4,
        gate="[0-9]{3}[ .-][0-9]{4}",
        begins="+(0-9",
        score_sql=f"CASE WHEN lower({before}) RLIKE 'phone|call|tel|mobile|cell|contact' THEN 0.75D ELSE 0.4D END",
    )


PHONE_NUMBER = phone_number()
CREDIT_CARD = Recogniser(
    "CREDIT_CARD", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", 1.0, gate="[0-9](?:[ -]?[0-9]){12}", begins="0-9",
    check=LUHN_VALID,
)
IBAN_CODE = Recogniser(
    "IBAN_CODE",
    r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    1.0,
    gate="[A-Z]{2}[0-9]{2}",
    gate_start="A-Z",
    begins="A-Z",
    check=IBAN_VALID,
)
US_SSN = Recogniser(
    "US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.5, gate="[0-9]{3}-[0-9]{2}-[0-9]{4}", begins="0-9",
    check=SSN_VALID,
)
IP_ADDRESS = Recogniser(
    "IP_ADDRESS",
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b",
    0.6,
    gate=r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]",
    begins="0-9",
)
PERSON = "PERSON"
PERSON_SCORE = 0.85

RECOGNISERS: tuple[Recogniser, ...] = (
    EMAIL_ADDRESS, PHONE_NUMBER, CREDIT_CARD, IBAN_CODE, US_SSN, IP_ADDRESS,
)


def choose(entities: Sequence[str] | None) -> tuple[Recogniser, ...]:
    """The recognisers of an entity subset, in catalogue order."""
    if entities is None:
        return RECOGNISERS
    known = {r.entity for r in RECOGNISERS} | {PERSON}
    unknown = set(entities) - known
    if unknown:
        raise ValueError(f"unknown entities: {sorted(unknown)}")
    return tuple(r for r in RECOGNISERS if r.entity in set(entities))


def check_threshold(threshold: float) -> float:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("the score threshold must be between 0 and 1")
    return threshold


def _recogniser_hits(text: str, recogniser: Recogniser, position: int) -> str:
    names = {"matched": "s.matched", "start": "s.span_start", "text": text}
    begins = f"[{recogniser.begins}]" if recogniser.begins else ""
    spans = match_spans(text, recogniser.pattern, begins)
    if recogniser.check is not None:
        spans = f"filter({spans}, s -> {recogniser.check.format(**names)})"
    score = f"{recogniser.score}D"
    if recogniser.score_sql is not None:
        score = recogniser.score_sql.format(**names)
    hits = f"""CAST(transform({spans}, s -> struct(
      s.span_start, {position} AS position, s.span_end, {literal(recogniser.entity)} AS entity,
      {score} AS score, s.matched)) AS {PII_HITS})"""
    gate = _any_gate(text, [recogniser])
    if gate is None:
        return hits
    return f"CASE WHEN {gate} THEN {hits} ELSE CAST(array() AS {PII_HITS}) END"


def _any_gate(text: str, recognisers: Sequence[Recogniser]) -> str | None:
    """SQL that is true when a recogniser may match; None when one has no gate.

    All gate patterns run in one pass, which looks further only at characters
    that can begin one.
    """
    if not all(r.marker or r.gate for r in recognisers):
        return None
    tests = [f"contains({text}, {literal(r.marker)})" for r in recognisers if r.marker]
    gated = [r for r in recognisers if not r.marker]
    if gated:
        starts = "".join(dict.fromkeys(r.gate_start for r in gated))
        pattern = f"(?=[{starts}])(?:{'|'.join(r.gate for r in gated)})"
        tests.append(f"{text} RLIKE {literal(pattern)}")
    return f"({' OR '.join(tests) or 'false'})"


def pii_hits(
    text: str,
    recognisers: Sequence[Recogniser] = RECOGNISERS,
    threshold: float = DEFAULT_THRESHOLD,
    more: str | None = None,
) -> Column:
    """Scored matches in column ``text`` above the threshold, ordered by start.

    The result holds the raw match, so it is for use inside a plan only and is
    never written. ``more`` is a column of hits found elsewhere (names).
    """
    check_threshold(threshold)
    none = f"CAST(array() AS {PII_HITS})"
    arrays = [_recogniser_hits(text, r, i) for i, r in enumerate(recognisers)]
    arrays.append(none if more is None else f"coalesce({more}, {none})")
    found = f"filter(array_sort(concat({', '.join(arrays)})), h -> h.score >= {threshold})"
    # A text that passes no gate is done in generated code.
    gate = _any_gate(text, recognisers) if more is None else None
    done = f"WHEN NOT {gate} THEN {none}" if gate else ""
    return F.expr(f"CASE WHEN {text} IS NULL THEN NULL {done} ELSE {found} END")


def hits_to_findings(hits: str) -> Column:
    return F.expr(f"""CAST(transform({hits}, h -> struct(
      concat('pii_', lower(h.entity)) AS kind, h.entity AS label,
      {severity_sql("h.score")} AS severity, h.span_start, h.span_end,
      {preview_sql("h.matched")} AS preview)) AS {FINDINGS})""")


def hits_to_swaps(hits: str) -> Column:
    """What to replace by what, in finding order; empty originals are left out."""
    return F.expr(f"""CAST(filter(transform({hits}, h -> struct(
      h.matched AS original, concat('[REDACTED:', h.entity, ']') AS replacement, h.span_start, h.span_end)),
      s -> s.original <> '') AS {SWAPS})""")


def apply_swaps(text: Column, swaps: Column) -> Column:
    """Replace all occurrences of each original, one pair after the other."""
    return F.aggregate(
        swaps, text, lambda done, s: F.replace(done, s["original"], s["replacement"])
    )
