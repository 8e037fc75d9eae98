"""DuckDB SQL fragments for the checking side."""

from __future__ import annotations

from promptledger.functions.recognisers import RECOGNISERS
from promptledger.functions.rules import CATALOGUE
from promptledger.operators.pricing import PRICES


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans(source: str, pattern: str, keep: str = "") -> str:
    """One row per match in ``source.content``: i, m, s (start), e (end)."""
    p = quote(pattern)
    return f"""
      SELECT arrival_seq{keep}, i, hits[i] AS m,
             CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS INT) AS s,
             CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
               + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS INT) AS e, content
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
            FROM (SELECT arrival_seq{keep}, content, regexp_extract_all(content, {p}) AS hits,
                         string_split_regex(content, {p}) AS gaps FROM {source})
            WHERE len(hits) > 0)"""


PREVIEW = """CASE WHEN length(m) <= 6 THEN repeat('*', length(m))
  ELSE left(m, 4) || '***' || right(m, 2) END"""


def secret_hits(source: str, rules=CATALOGUE) -> str:
    """Findings of all rules: arrival_seq, pos, kind, label, severity, s, e, m."""
    return " UNION ALL ".join(
        f"""SELECT arrival_seq, {i} AS pos, {quote(r.name)} AS kind, {quote(r.label)} AS label,
            {quote(r.severity)} AS severity, s, e, m FROM ({spans(source, r.pattern)})"""
        for i, r in enumerate(rules)
    )


_DIGITS_OF = "regexp_replace(m, '[ -]', '', 'g')"
_CHECKS = {
    "CREDIT_CARD": f"""list_sum(list_transform(range(1, length({_DIGITS_OF}) + 1), lambda k:
        CASE WHEN (length({_DIGITS_OF}) - k) % 2 = 0
          THEN CAST(substr({_DIGITS_OF}, CAST(k AS INT), 1) AS INT)
          WHEN CAST(substr({_DIGITS_OF}, CAST(k AS INT), 1) AS INT) > 4
          THEN CAST(substr({_DIGITS_OF}, CAST(k AS INT), 1) AS INT) * 2 - 9
          ELSE CAST(substr({_DIGITS_OF}, CAST(k AS INT), 1) AS INT) * 2 END)) % 10 = 0""",
    "IBAN_CODE": """length(replace(m, ' ', '')) >= 15 AND list_reduce(list_prepend(0,
        list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4), ''),
          lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
        lambda a, d: CASE WHEN d > 9 THEN (a * 100 + d) % 97 ELSE (a * 10 + d) % 97 END) = 1""",
    "US_SSN": """left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9'
        AND substr(m, 5, 2) <> '00' AND right(m, 4) <> '0000'""",
}
_SCORES = {
    "PHONE_NUMBER": """CASE WHEN regexp_matches(lower(substr(content, greatest(s - 50, 0) + 1,
        least(s, 50))), 'phone|call|tel|mobile|cell|contact') THEN 0.75 ELSE 0.4 END"""
}


# What the recogniser means, in a form without look-behind.
_PATTERNS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*\.(?:[Xx][Nn]--[A-Za-z0-9-]+|[A-Za-z]{2,})\b"
}


def pii_hits(source: str, threshold: float = 0.5, entities=None) -> str:
    """Scored matches: arrival_seq, pos, entity, score, s, e, m."""
    parts = []
    chosen = [r for r in RECOGNISERS if entities is None or r.entity in entities]
    for i, r in enumerate(chosen):
        score = _SCORES.get(r.entity, str(r.score))
        parts.append(
            f"""SELECT * FROM (SELECT arrival_seq, {i} AS pos, {quote(r.entity)} AS entity,
                CAST({score} AS DOUBLE) AS score, s, e, m FROM ({spans(source, _PATTERNS.get(r.entity, r.pattern))})
                WHERE {_CHECKS.get(r.entity, 'TRUE')}) WHERE score >= {threshold}"""
        )
    return " UNION ALL ".join(parts)


SEVERITY = "CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END"


def redacted(source: str, hits: str = "hits") -> str:
    """content of ``source`` after the ordered replacements, and whether any applied."""
    return f"""
      SELECT p.arrival_seq, CASE WHEN swaps IS NULL THEN content ELSE list_reduce(
               list_prepend(content, swaps),
               lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) END
               AS content, swaps IS NOT NULL AS mutated
      FROM {source} p LEFT JOIN (
        SELECT arrival_seq, list(m || chr(1) || '[REDACTED:' || entity || ']' ORDER BY s, pos) AS swaps
        FROM {hits} GROUP BY arrival_seq) r ON p.arrival_seq = r.arrival_seq"""


PRICE_ROWS = "(VALUES " + ", ".join(
    f"('{m}', CAST('{a}' AS DECIMAL(18,12)), CAST('{b}' AS DECIMAL(18,12)), '{e}')"
    for m, a, b, e in PRICES
) + ") AS price(price_key, input_usd, output_usd, encoding)"


def priced(source: str, tokens: str = "known_tokens") -> str:
    """source plus input_usd, output_usd, encoding_used, fallback_applied, cost."""
    paid = "coalesce(input_usd, CAST('0.000030' AS DECIMAL(18,12)))"
    return f"""
      SELECT s.*, {paid} AS usd_in,
             coalesce(output_usd, CAST('0.000060' AS DECIMAL(18,12))) AS usd_out,
             coalesce(encoding, 'cl100k_base') AS encoding_used, price_key IS NULL AS fallback_applied,
             CAST({paid} * CAST({tokens} AS DECIMAL(19,0)) AS DECIMAL(38,18)) AS cost
      FROM {source} s LEFT JOIN {PRICE_ROWS} ON lower(trim(s.model)) = price_key"""


_MODEL = "json_extract_string(body, '$.model')"
_IS_TEXT = lambda path: f"coalesce(json_type(body, '{path}') = 'VARCHAR', FALSE)"

ERROR_CODE = f"""CASE
  WHEN regexp_replace(path, '/+$', '') NOT IN ('/v1/chat/completions', '/v1/messages')
    THEN 'unknown_provider'
  WHEN body IS NULL OR body = '' THEN 'empty_body'
  WHEN NOT json_valid(body) THEN 'invalid_json'
  WHEN json_type(body) <> 'OBJECT' THEN 'not_an_object'
  WHEN NOT {_IS_TEXT('$.model')} OR {_MODEL} = '' THEN 'missing_model'
  WHEN coalesce(json_type(body, '$.messages') <> 'ARRAY', TRUE)
    OR json_array_length(body, '$.messages') = 0 THEN 'missing_messages' END"""

PROVIDER = """CASE regexp_replace(path, '/+$', '') WHEN '/v1/chat/completions' THEN 'openai'
  WHEN '/v1/messages' THEN 'anthropic' END"""


def content_of(value: str) -> str:
    """Flattened text of a JSON content value."""
    return f"""CASE json_type({value}) WHEN 'VARCHAR' THEN json_extract_string({value}, '$')
      WHEN 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract({value}, '$[*]'),
        lambda p: CASE json_type(p) WHEN 'VARCHAR' THEN json_extract_string(p, '$')
          WHEN 'OBJECT' THEN CASE WHEN json_type(p, '$.text') = 'VARCHAR'
            THEN json_extract_string(p, '$.text') END END),
        lambda t: t IS NOT NULL), chr(10)) ELSE '' END"""


def normalised(requests: str, extra: str = "") -> str:
    """requests plus error_code, provider, model and content."""
    system = f"""CASE WHEN provider = 'anthropic' THEN {content_of("json_extract(body, '$.system')")}
      ELSE '' END"""
    return f"""
      SELECT arrival_seq, path, body, given_id, error_code, provider, {_MODEL} AS model{extra},
             array_to_string(list_filter(list_prepend({system},
               list_transform(json_extract(body, '$.messages[*]'), lambda x:
                 coalesce({content_of("json_extract(x, '$.content')")}, ''))),
               lambda t: t IS NOT NULL AND t <> ''), chr(10)) AS content
      FROM (SELECT *, {PROVIDER} AS provider FROM (SELECT *, {ERROR_CODE} AS error_code FROM {requests}))
      WHERE error_code IS NULL"""


_BARE = "lower(replace(trim(replace(replace(given_id, 'urn:', ''), 'uuid:', ''), '{}'), '-', ''))"
_SHA = "sha256('live|' || CAST(arrival_seq AS VARCHAR))"


def _uuid(digits: str) -> str:
    return (
        f"substr({digits}, 1, 8) || '-' || substr({digits}, 9, 4) || '-' || substr({digits}, 13, 4)"
        f" || '-' || substr({digits}, 17, 4) || '-' || substr({digits}, 21, 12)"
    )


REQUEST_ID = f"""CASE WHEN coalesce(regexp_matches({_BARE}, '^[0-9a-f]{{32}}$'), FALSE)
  THEN {_uuid(_BARE)}
  ELSE {_uuid(f"(substr({_SHA}, 1, 12) || '4' || substr({_SHA}, 14, 3) || '8' || substr({_SHA}, 18, 15))")}
  END"""


def decided(source: str, pii: str | None, max_tokens: int, max_cost: str, tokens: str) -> str:
    """The chain over ``source`` (arrival_seq, model, content, token column).

    Columns: secrets, piis (counts), stage, status, reason, detail, cost.
    ``pii`` is block, redact or None.
    """
    open_pii = "secrets = 0" if pii else "FALSE"
    blocked = "piis > 0" if pii == "block" else "FALSE"
    return f"""
      SELECT *, CASE WHEN secrets > 0 THEN 'secret_scan' WHEN {blocked} THEN 'pii_scan'
                     WHEN violated <> '' THEN 'tokenomics' END AS stage,
             CASE WHEN secrets > 0 OR {blocked} THEN 403 WHEN violated <> '' THEN 413 END AS status,
             CASE WHEN secrets > 0 THEN 'secret_exposure_detected'
                  WHEN {blocked} THEN 'pii_exposure_detected'
                  WHEN violated <> '' THEN 'tokenomics_policy_violation' END AS reason,
             CASE WHEN secrets > 0 THEN 'Prompt contains ' || secrets || ' secret value(s); refusing to forward.'
                  WHEN {blocked} THEN 'Prompt contains ' || piis || ' PII value(s); refusing to forward.'
                  WHEN violated <> '' THEN 'Prompt violates configured token or cost threshold: ' || violated
                  END AS detail,
             NOT (secrets > 0 OR {blocked}) AS token_ran
      FROM (SELECT *, CASE WHEN NOT (secrets > 0 OR {blocked}) THEN array_to_string(list_filter(
                [CASE WHEN {tokens} > {max_tokens} THEN 'token_limit' END,
                 CASE WHEN cost > CAST('{max_cost}' AS DECIMAL(38,18)) THEN 'cost_limit' END],
                lambda v: v IS NOT NULL), ', ') ELSE '' END AS violated
            FROM (SELECT p.*, CAST(coalesce(n_secret, 0) AS INT) AS secrets,
                         CAST(CASE WHEN coalesce(n_secret, 0) = 0 AND {'TRUE' if pii else 'FALSE'}
                           THEN coalesce(n_pii, 0) ELSE 0 END AS INT) AS piis
                  FROM ({priced(source, tokens)}) p
                  LEFT JOIN (SELECT arrival_seq, count(*) AS n_secret FROM secret_rows GROUP BY 1) a
                    ON p.arrival_seq = a.arrival_seq
                  LEFT JOIN (SELECT arrival_seq, count(*) AS n_pii FROM pii_rows GROUP BY 1) b
                    ON p.arrival_seq = b.arrival_seq))"""


def with_scans(source_sql: str, body: str) -> str:
    """CTEs prompts, secret_rows and pii_rows in front of ``body``."""
    return f"""WITH prompts AS ({source_sql}),
      secret_rows AS ({secret_hits('prompts')}),
      pii_rows AS ({pii_hits('prompts')})
      {body}"""
