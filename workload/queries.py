"""The query registry: a Spark callable and, where SQL can say it, its check."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptledger.functions import bodies
from promptledger.functions import recognisers as pii
from promptledger.functions.findings import worst_severity
from promptledger.functions.rules import CATALOGUE, SecretRule
from promptledger.functions.tokens import TokenCounter, Vocabulary
from promptledger.operators import detect, ledger, normalise, outages, pricing, redact, reports, stats
from promptledger.plans.chain import BLOCK, REDACT, Chain, PiiStage, batch_chain, live_chain, reject
from promptledger.schemas import LEDGER_FINDINGS, empty
from promptledger.session import cut_lineage, shared_dir
from promptledger.sources import ledgers, requests
from promptledger.streaming import live
from promptledger.streaming.outages import OutageTracker
from workload import checks
from workload.derived import checked, derive, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(name: str, check: str | None = None):
    """Add a query under a name, with its DuckDB check if there is one."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if check is not None:
            CHECKS[name] = check
        return query

    return add


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text(column: str):
    """Money as plain digits, for comparison across engines."""
    return F.col(column).cast("decimal(38,18)").cast("string")


# ---------------------------------------------------------------- requests

CHAT = checked("chat_requests")


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log with a header map and an arrival time."""
    return derive(spark, sf_dir, "chat_requests").select(
        "arrival_seq",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("arrival_seq")).alias("arrival_ts"),
        "path",
        F.when(
            F.col("given_id").isNotNull(), F.create_map(F.lit("X-Request-Id"), F.col("given_id"))
        ).alias("headers"),
        "body",
    )


@register("route_provider", f"SELECT arrival_seq, path, {checks.PROVIDER} AS provider FROM ({CHAT})")
def route_provider(spark, sf_dir):
    out = chat_requests(spark, sf_dir)
    return out.select(
        "arrival_seq", "path", bodies.provider_of_path(F.col("path")).alias("provider")
    )


@register(
    "detect_provider",
    f"""SELECT arrival_seq, CASE WHEN json_type(body, '$.system') IS NOT NULL
          OR (json_type(body, '$.model') = 'VARCHAR'
              AND lower(json_extract_string(body, '$.model')) LIKE 'claude%')
          THEN 'anthropic' ELSE 'openai' END AS provider
        FROM (SELECT * FROM ({CHAT}) WHERE json_valid(body)) WHERE json_type(body) = 'OBJECT'""",
)
def detect_provider(spark, sf_dir):
    parsed = bodies.with_parsed(chat_requests(spark, sf_dir), "body", "v")
    marked = parsed.select(
        "arrival_seq",
        F.when(bodies.is_object(F.col("body"), F.col("v")), bodies.detect_provider(F.col("v"))).alias(
            "provider"
        ),
    )
    return marked.where(F.col("provider").isNotNull())


@register(
    "body_errors",
    f"""SELECT error_code, CAST(CASE WHEN error_code = 'unknown_provider' THEN 404 ELSE 400 END AS INT)
          AS error_status, count(*) AS n
        FROM (SELECT {checks.ERROR_CODE} AS error_code FROM ({CHAT}))
        WHERE error_code IS NOT NULL GROUP BY ALL""",
)
def body_errors(spark, sf_dir):
    out = normalise.normalise(chat_requests(spark, sf_dir))
    counted = out.groupBy("error_code", "error_status").agg(F.count("*").alias("n"))
    return counted.where(F.col("error_code").isNotNull())


@register(
    "prompt_content",
    f"""SELECT arrival_seq, provider, model, content
        FROM ({checks.normalised(f'({CHAT})')})""",
)
def prompt_content(spark, sf_dir):
    out = normalise.accepted(normalise.normalise(chat_requests(spark, sf_dir)))
    return out.select("arrival_seq", "provider", "model", "content")


@register("request_ids", f"SELECT arrival_seq, {checks.REQUEST_ID} AS request_id FROM ({CHAT})")
def request_ids(spark, sf_dir):
    out = normalise.normalise(chat_requests(spark, sf_dir))
    return out.select("arrival_seq", "request_id")


@register(
    "dead_letters",
    f"""SELECT arrival_seq, path, error_code,
          CAST(CASE WHEN error_code = 'unknown_provider' THEN 404 ELSE 400 END AS INT) AS error_status,
          CASE WHEN error_code = 'unknown_provider' THEN error_code ELSE 'malformed_request' END AS error,
          CASE error_code
            WHEN 'unknown_provider' THEN 'No provider adapter registered for path ''' || path || '''.'
            WHEN 'empty_body' THEN 'Request body is empty.'
            WHEN 'invalid_json' THEN 'Request body is not valid JSON.'
            WHEN 'not_an_object' THEN 'Request body must be a JSON object at the top level.'
            WHEN 'missing_model' THEN 'Field ''model'' is required.'
            ELSE 'Field ''messages'' must be a non-empty list.' END AS error_detail
        FROM (SELECT *, {checks.ERROR_CODE} AS error_code FROM ({CHAT})) WHERE error_code IS NOT NULL""",
)
def dead_letters(spark, sf_dir):
    out = normalise.dead_letters(normalise.normalise(chat_requests(spark, sf_dir)))
    return out.select("arrival_seq", "path", "error_code", "error_status", "error", "error_detail")


@register(
    "request_log_source",
    f"SELECT path, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM ({CHAT}) GROUP BY path",
)
def request_log_source(spark, sf_dir):
    folder = fresh_folder(spark, "requests")
    chat_requests(spark, sf_dir).write.json(folder)
    log = requests.read_requests(spark, folder)
    return log.groupBy("path").agg(
        F.count("*").alias("n"), F.sum(F.length("body")).alias("chars")
    )


@register(
    "text_prompts",
    """SELECT doc_id AS arrival_seq, 'openai' AS provider, 'gpt-4o' AS model,
              md5(text) AS content_hash FROM documents""",
)
def text_prompts(spark, sf_dir):
    asked = requests.text_prompts(read(spark, sf_dir, "documents"), "text", "doc_id")
    out = normalise.accepted(normalise.normalise(asked))
    return out.select("arrival_seq", "provider", "model", F.md5("content").alias("content_hash"))


_FILE_ERROR = """CASE WHEN NOT json_valid(body) THEN 'invalid_json'
    WHEN json_type(body) <> 'OBJECT' THEN 'not_an_object'
    WHEN coalesce(json_type(body, '$.model') <> 'VARCHAR', TRUE)
      OR json_extract_string(body, '$.model') = '' THEN 'missing_model'
    WHEN coalesce(json_type(body, '$.messages') <> 'ARRAY', TRUE)
      OR json_array_length(body, '$.messages') = 0 THEN 'missing_messages' END"""


@register(
    "prompt_files",
    f"""SELECT arrival_seq, error_code, CASE WHEN error_code IS NULL THEN
          CASE WHEN json_type(body, '$.system') IS NOT NULL
            OR lower(json_extract_string(body, '$.model')) LIKE 'claude%' THEN 'anthropic' ELSE 'openai' END
          END AS provider FROM (SELECT *, {_FILE_ERROR} AS error_code FROM ({CHAT}))""",
)
def prompt_files(spark, sf_dir):
    """Every body in a file of its own, read back as a folder of prompts."""
    folder = fresh_folder(spark, "prompt-files")
    bodies_of = chat_requests(spark, sf_dir).select("arrival_seq", "body")
    requests.write_prompt_files(bodies_of, folder, "arrival_seq")
    files = requests.read_prompt_files(spark, folder, pattern="*.txt")
    number = F.regexp_extract("label", "arrival_seq=([0-9]+)", 1).cast("long")
    out = normalise.normalise_files(files).withColumn("arrival_seq", number)
    return out.select("arrival_seq", "error_code", "provider")


# ---------------------------------------------------------------- secrets

SECRETS = checked("secret_prompts")
_FINDING = f"""arrival_seq, kind, label, severity, s AS span_start, e AS span_end,
    {checks.PREVIEW} AS preview"""


def secret_prompts(spark, sf_dir):
    return derive(spark, sf_dir, "secret_prompts")


@register(
    "secret_findings",
    f"""WITH prompts AS ({SECRETS}), hits AS ({checks.secret_hits('prompts')})
        SELECT CAST(row_number() OVER (PARTITION BY arrival_seq ORDER BY s, pos) - 1 AS INT)
          AS finding_no, {_FINDING} FROM hits""",
)
def secret_findings(spark, sf_dir):
    found = detect.scan_secrets(secret_prompts(spark, sf_dir))
    return detect.explode_findings(found, "arrival_seq")


@register(
    "secret_findings_by_kind",
    f"""WITH prompts AS ({SECRETS}), hits AS ({checks.secret_hits('prompts')})
        SELECT kind, severity, count(*) AS findings, count(DISTINCT arrival_seq) AS prompts
        FROM hits GROUP BY ALL""",
)
def secret_findings_by_kind(spark, sf_dir):
    found = detect.scan_secrets(secret_prompts(spark, sf_dir))
    per_prompt = detect.explode_findings(found, "arrival_seq").groupBy(
        "kind", "severity", "arrival_seq"
    ).agg(F.count("*").alias("n"))
    return per_prompt.groupBy("kind", "severity").agg(
        F.sum("n").alias("findings"), F.count("*").alias("prompts")
    )


def _one_rule(rule: SecretRule) -> None:
    @register(
        f"secret_{rule.name}",
        f"""WITH prompts AS ({SECRETS}), hits AS ({checks.secret_hits('prompts', [rule])})
            SELECT {_FINDING} FROM hits""",
    )
    def one_rule(spark, sf_dir):
        found = detect.scan_secrets(secret_prompts(spark, sf_dir), rules=[rule])
        return detect.explode_findings(found, "arrival_seq").drop("finding_no")


for _rule in CATALOGUE:
    _one_rule(_rule)

TOKEN_RULE = SecretRule(
    "assigned_token", "Assigned token", r'\btoken = "[0-9a-f]{40}"', "medium", ("token = ",)
)


@register(
    "custom_rule_tokens",
    f"""WITH prompts AS (SELECT doc_id AS arrival_seq, text AS content FROM documents),
          hits AS ({checks.secret_hits('prompts', [TOKEN_RULE])}) SELECT {_FINDING} FROM hits""",
)
def custom_rule_tokens(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id AS arrival_seq", "text AS content")
    found = detect.scan_secrets(docs, rules=[TOKEN_RULE])
    return detect.explode_findings(found, "arrival_seq").drop("finding_no")


@register(
    "worst_severity",
    f"""WITH prompts AS ({SECRETS}), hits AS ({checks.secret_hits('prompts')})
        SELECT p.lang, w.worst, count(*) AS n FROM prompts p LEFT JOIN (
          SELECT arrival_seq, CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END)
            WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS worst
          FROM hits GROUP BY arrival_seq) w ON p.arrival_seq = w.arrival_seq GROUP BY ALL""",
)
def severity_by_language(spark, sf_dir):
    found = detect.scan_secrets(secret_prompts(spark, sf_dir))
    return found.groupBy("lang", worst_severity(F.col("findings")).alias("worst")).agg(
        F.count("*").alias("n")
    )


# ---------------------------------------------------------------- personal data

PII = checked("pii_prompts")
_PII_FINDING = f"""arrival_seq, 'pii_' || lower(entity) AS kind, entity AS label,
    {checks.SEVERITY} AS severity, s AS span_start, e AS span_end, {checks.PREVIEW} AS preview"""


def pii_prompts(spark, sf_dir):
    return derive(spark, sf_dir, "pii_prompts")


@register(
    "pii_findings",
    f"""WITH prompts AS ({PII}), hits AS ({checks.pii_hits('prompts')})
        SELECT CAST(row_number() OVER (PARTITION BY arrival_seq ORDER BY s, pos) - 1 AS INT)
          AS finding_no, {_PII_FINDING} FROM hits""",
)
def pii_findings(spark, sf_dir):
    return detect.explode_findings(detect.scan_pii(pii_prompts(spark, sf_dir)), "arrival_seq")


@register(
    "pii_low_threshold",
    f"""WITH prompts AS ({PII}), hits AS ({checks.pii_hits('prompts', 0.3)})
        SELECT entity AS label, {checks.SEVERITY} AS severity, count(*) AS n FROM hits GROUP BY ALL""",
)
def pii_low_threshold(spark, sf_dir):
    found = detect.scan_pii(pii_prompts(spark, sf_dir), threshold=0.3)
    listed = detect.explode_findings(found, "arrival_seq")
    return listed.groupBy("label", "severity").agg(F.count("*").alias("n"))


def _one_entity(entity: str) -> None:
    @register(
        f"pii_{entity.lower()}",
        f"""WITH prompts AS ({PII}), hits AS ({checks.pii_hits('prompts', 0.0, [entity])})
            SELECT {_PII_FINDING} FROM hits""",
    )
    def one_entity(spark, sf_dir):
        found = detect.scan_pii(pii_prompts(spark, sf_dir), entities=[entity], threshold=0.0)
        return detect.explode_findings(found, "arrival_seq").drop("finding_no")


for _recogniser in pii.RECOGNISERS:
    _one_entity(_recogniser.entity)

_WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]+"


@register(
    "pii_person",
    f"""WITH names AS (SELECT DISTINCT regexp_extract(text, '^({_WORD} {_WORD})') AS name FROM documents),
        words AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w,
                         string_split_regex(text, '{_WORD}') AS g FROM documents),
        placed AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words),
        runs AS (SELECT doc_id, i, n, w, g,
                        array_to_string(w[i:i + n - 1], ' ') AS name
                 FROM placed CROSS JOIN (VALUES (1), (2), (3)) AS sizes(n)
                 WHERE i + n - 1 <= len(w)
                   AND len(list_filter(g[i + 1:i + n - 1], lambda x: x <> ' ')) = 0)
        SELECT r.doc_id AS arrival_seq, 'pii_person' AS kind, 'PERSON' AS label, 'high' AS severity,
               CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                 + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS INT)
                 AS span_start,
               CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                 + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)
                 + length(r.name) AS INT) AS span_end,
               CASE WHEN length(r.name) <= 6 THEN repeat('*', length(r.name))
                 ELSE left(r.name, 4) || '***' || right(r.name, 2) END AS preview
        FROM runs r JOIN names ON r.name = names.name""",
)
def pii_person(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id AS arrival_seq", "text AS content")
    opening = F.regexp_extract("content", f"^({_WORD} {_WORD})", 1)
    names = docs.select(opening.alias("name")).where(F.col("name") != "")
    found = detect.scan_pii(docs, entities=[pii.PERSON], names=names, any_space=False)
    return detect.explode_findings(found, "arrival_seq").drop("finding_no")


# Names as they stand in texts: every kind of white space between their words.
_FORMS = """SELECT doc_id AS arrival_seq, 'Vera' || CAST(doc_id % 997 AS STRING) AS first,
    'Holm' || CAST(doc_id % 997 AS STRING) AS last,
    CASE doc_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN '  ' WHEN 2 THEN chr(10) WHEN 3 THEN chr(9) || ' '
      WHEN 4 THEN chr(160) WHEN 5 THEN chr(13) || chr(10) ELSE '-' END AS gap, text
  FROM {documents}"""
_FORMED = _FORMS.format(documents="documents")


@register(
    "pii_person_forms",
    f"""WITH forms AS (SELECT *, first || gap || last AS name FROM ({_FORMED}))
        SELECT arrival_seq, 'PERSON' AS label, CAST(5 AS INT) AS span_start, CAST(5 + length(name) AS INT) AS span_end,
               left(name, 4) || '***' || right(name, 2) AS preview
        FROM forms WHERE gap <> '-'""",
)
def pii_person_forms(spark, sf_dir):
    """A scan that only reports finds a name in the forms that blocking and redacting find."""
    forms = spark.sql(_FORMS, documents=read(spark, sf_dir, "documents"))
    names = forms.select(F.concat("first", F.lit(" "), "last").alias("name")).distinct()
    content = F.concat(F.lit("seen "), "first", "gap", "last", F.lit(" by "), F.coalesce("text", F.lit("")))
    found = detect.scan_pii(forms.select("arrival_seq", content.alias("content")), entities=[pii.PERSON], names=names)
    return detect.explode_findings(found, "arrival_seq").select("arrival_seq", "label", "span_start", "span_end", "preview")


# ---------------------------------------------------------------- redaction


@register(
    "redact_texts",
    f"""WITH prompts AS ({PII}), hits AS ({checks.pii_hits('prompts')})
        SELECT arrival_seq, md5(content) AS content_hash, mutated AS mutations_applied
        FROM ({checks.redacted('prompts')})""",
)
def redact_texts(spark, sf_dir):
    out = redact.redact_texts(pii_prompts(spark, sf_dir))
    return out.select("arrival_seq", F.md5("content").alias("content_hash"), "mutations_applied")


@register(
    "redact_bodies",
    f"""WITH prompts AS ({checks.normalised(f'({CHAT})')}), hits AS ({checks.pii_hits('prompts')})
        SELECT r.arrival_seq, r.content, mutated AS mutations_applied,
               json_extract_string(body, '$.temperature') AS temperature,
               json_extract_string(body, '$.messages[1]') AS second_message,
               json_type(body, '$.system') = 'NULL' AS null_system
        FROM ({checks.redacted('prompts')}) r JOIN prompts USING (arrival_seq)""",
)
def redact_bodies(spark, sf_dir):
    good = normalise.accepted(normalise.normalise(chat_requests(spark, sf_dir)))
    hit = detect.with_pii_hits(good, "content", "hits")
    out = redact.rewrite_requests(
        hit.withColumn("swaps", pii.hits_to_swaps("hits")).drop("hits"), "swaps"
    )
    again = out.withColumn("v", F.try_parse_json("body"))
    return again.select(
        "arrival_seq", "content", "mutations_applied",
        F.get_json_object("body", "$.temperature").alias("temperature"),
        F.get_json_object("body", "$.messages[1]").alias("second_message"),
        (F.schema_of_variant(bodies.field(F.col("v"), "system")) == "VOID").alias("null_system"),
    )


# ---------------------------------------------------------------- tokens and prices

MIXED = checked("mixed_prompts")
POLICY = pricing.ThresholdPolicy(4_000, Decimal("0.02"))


def mixed_prompts(spark, sf_dir):
    """Normalised prompts with a known token count."""
    return derive(spark, sf_dir, "mixed_prompts").select(
        "arrival_seq",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("arrival_seq")).alias("arrival_ts"),
        F.md5(F.col("arrival_seq").cast("string")).alias("request_id"),
        F.lit("openai").alias("provider"), F.lit("/v1/chat/completions").alias("path"),
        "model", "content", "known_tokens",
        F.to_json(
            F.struct(
                "model",
                F.array(F.struct(F.lit("user").alias("role"), "content")).alias("messages"),
            )
        ).alias("body"),
    )


def token_counter(spark: SparkSession) -> TokenCounter:
    """Installed public vocabularies under the two encoding names of the price list."""
    import public_tokenizers

    return TokenCounter(
        spark,
        {
            "cl100k_base": Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")),
            "o200k_base": Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
        },
    )


@register("token_counts")
def token_counts(spark, sf_dir):
    """Counts with the installed vocabularies; SQL has no tokenizer."""
    docs = read(spark, sf_dir, "documents").selectExpr(
        "doc_id AS arrival_seq", "text AS content", "CASE doc_id % 2 WHEN 0 THEN 'gpt-4o' ELSE 'gpt-4' END AS model"
    )
    counter = token_counter(spark)
    priced = pricing.with_prices(docs)
    return priced.select(
        "arrival_seq", "model", "encoding_used",
        counter.count(F.col("content"), F.col("encoding_used")).alias("token_count"),
    )


@register(
    "price_lookup",
    f"""SELECT arrival_seq, model, encoding_used, fallback_applied, known_tokens AS token_count,
               CAST(cost AS STRING) AS estimated_cost_usd FROM ({checks.priced(f'({MIXED})')})""",
)
def price_lookup(spark, sf_dir):
    known = mixed_prompts(spark, sf_dir).withColumn("token_count", F.col("known_tokens"))
    out = pricing.evaluate(known, POLICY)
    return out.select(
        "arrival_seq", "model", "encoding_used", "fallback_applied", "token_count",
        text("estimated_cost_usd").alias("estimated_cost_usd"),
    )


@register(
    "unknown_models",
    f"""SELECT model, count(*) AS n FROM ({MIXED}) WHERE lower(trim(model)) NOT IN
          (SELECT price_key FROM {checks.PRICE_ROWS}) GROUP BY model""",
)
def unknown_models(spark, sf_dir):
    return pricing.unknown_models(mixed_prompts(spark, sf_dir))


@register(
    "limit_violations",
    f"""SELECT violations, count(*) AS n FROM (SELECT array_to_string(list_filter(
          [CASE WHEN known_tokens > 4000 THEN 'token_limit' END,
           CASE WHEN cost > CAST('0.02' AS DECIMAL(38,18)) THEN 'cost_limit' END],
          lambda v: v IS NOT NULL), ',') AS violations FROM ({checks.priced(f'({MIXED})')})) GROUP BY ALL""",
)
def limit_violations(spark, sf_dir):
    known = mixed_prompts(spark, sf_dir).withColumn("token_count", F.col("known_tokens"))
    out = pricing.evaluate(known, POLICY)
    return out.groupBy(F.array_join("violations", ",").alias("violations")).agg(
        F.count("*").alias("n")
    )


@register(
    "completion_cost",
    f"""SELECT fallback_applied, CAST(CAST(sum(CAST(usd_out * CAST(known_tokens AS DECIMAL(19,0))
          AS DECIMAL(38,18))) AS DECIMAL(38,18)) AS STRING) AS completion_cost_usd
        FROM ({checks.priced(f'({MIXED})')}) GROUP BY ALL""",
)
def completion_cost(spark, sf_dir):
    known = mixed_prompts(spark, sf_dir).withColumn("token_count", F.col("known_tokens"))
    out = pricing.evaluate(known, POLICY, completion_tokens="known_tokens")
    total = out.groupBy("fallback_applied").agg(F.sum("completion_cost_usd").alias("completion_cost_usd"))
    return total.withColumn("completion_cost_usd", text("completion_cost_usd"))


# ---------------------------------------------------------------- decisions


def _decision_check(pii_policy: str | None) -> str:
    pii_ran = "secrets = 0" if pii_policy else "FALSE"
    return checks.with_scans(
        MIXED,
        f"""SELECT arrival_seq, CASE WHEN stage IS NULL THEN 'allowed' ELSE 'rejected' END AS verdict,
              stage AS rejecting_middleware, CAST(status AS INT) AS status_code, reason, detail,
              secrets AS secret_findings, CASE WHEN {pii_ran} THEN piis END AS pii_findings,
              CASE WHEN token_ran THEN known_tokens END AS token_count,
              CASE WHEN token_ran THEN CAST(cost AS STRING) END AS estimated_cost_usd
            FROM ({checks.decided('prompts', pii_policy, 4000, '0.02', 'known_tokens')})""",
    )


def _decision_columns(out: DataFrame, pii_ran: bool) -> DataFrame:
    return out.select(
        "arrival_seq", "verdict", "rejecting_middleware",
        F.col("reject.status_code").alias("status_code"), F.col("reject.reason").alias("reason"),
        F.col("reject.detail").alias("detail"),
        F.col("secret_scan.finding_count").alias("secret_findings"),
        (F.col("pii_scan.finding_count") if pii_ran else F.lit(None).cast("int")).alias("pii_findings"),
        F.col("tokenomics.token_count").alias("token_count"),
        text("tokenomics.estimated_cost_usd").alias("estimated_cost_usd"),
    )


def decide_mixed(spark, sf_dir, pii_policy) -> tuple[Chain, DataFrame]:
    chain = live_chain(None, pii_policy, POLICY, token_column="known_tokens")
    return chain, chain.decide(mixed_prompts(spark, sf_dir))


@register("decide_block", _decision_check("block"))
def decide_block(spark, sf_dir):
    return _decision_columns(decide_mixed(spark, sf_dir, BLOCK)[1], True)


@register("decide_without_pii", _decision_check(None))
def decide_without_pii(spark, sf_dir):
    return _decision_columns(decide_mixed(spark, sf_dir, None)[1], False)


@register(
    "decide_redact",
    checks.with_scans(
        MIXED,
        f"""SELECT d.arrival_seq, stage AS rejecting_middleware,
              secrets = 0 AND mutated AS mutations_applied,
              md5(CASE WHEN secrets = 0 THEN r.content ELSE d.content END) AS content_hash
            FROM ({checks.decided('prompts', 'redact', 4000, '0.02', 'known_tokens')}) d
            JOIN ({checks.redacted('prompts', 'pii_rows')}) r ON d.arrival_seq = r.arrival_seq""",
    ),
)
def decide_redact(spark, sf_dir):
    _, out = decide_mixed(spark, sf_dir, REDACT)
    return out.select(
        "arrival_seq", "rejecting_middleware", "mutations_applied",
        F.md5("content").alias("content_hash"),
    )


_SPLIT = checked("split_names")


@register(
    "decide_redact_across_parts",
    f"""SELECT arrival_seq, 'allowed' AS verdict, arrival_seq % 4 IN (0, 3) AS mutations_applied,
          md5(CASE WHEN first_text = '' THEN '' ELSE replace(CASE WHEN arrival_seq % 4 = 0
              THEN left(first_text, length(first_text) - length(split_part(name, ' ', 1))) || '[REDACTED:PERSON]'
              ELSE first_text END, name, '[REDACTED:PERSON]') || chr(10) END
            || CASE WHEN arrival_seq % 4 = 0 THEN ' now' ELSE second_text END) AS content_hash,
          CAST(0 AS INT) AS hits_left
        FROM ({_SPLIT})""",
)
def decide_redact_across_parts(spark, sf_dir):
    """Listed names, some of them running over the end of a message."""
    sent = derive(spark, sf_dir, "split_names")
    log = sent.select(
        "arrival_seq", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("arrival_seq")).alias("arrival_ts"),
        "path", F.lit(None).cast("map<string,string>").alias("headers"), "body",
    )
    names = sent.select("name").distinct()
    chain = Chain([PiiStage(REDACT, entities=[pii.PERSON], names=names)])
    out = live.decide_requests(log, chain)
    again = detect.scan_pii(out, entities=[pii.PERSON], names=names, any_space=True)
    return again.select(
        "arrival_seq", "verdict", "mutations_applied", F.md5("content").alias("content_hash"),
        F.size("findings").alias("hits_left"),
    )


@register("accept_all", f"SELECT 'allowed' AS verdict, count(*) AS n FROM ({MIXED})")
def accept_all(spark, sf_dir):
    return Chain().decide(mixed_prompts(spark, sf_dir)).groupBy("verdict").agg(F.count("*").alias("n"))


@register("decide_requests")
def decide_requests(spark, sf_dir):
    """Raw bodies through the redacting live chain with real token counts."""
    chain = live_chain(token_counter(spark), REDACT)
    out = live.decide_requests(chat_requests(spark, sf_dir), chain)
    return out.select(
        "arrival_seq", "error_code", "verdict", "rejecting_middleware", "mutations_applied",
        F.col("tokenomics.token_count").alias("token_count"),
    )


_CHAT_PROMPTS = f"""SELECT *, CAST(length(body) AS INT) AS size
    FROM ({checks.normalised(f'({CHAT})')})"""


@register(
    "response_status",
    checks.with_scans(
        _CHAT_PROMPTS,
        f"""SELECT response_status, count(*) AS n FROM (
              SELECT CAST(CASE WHEN error_code = 'unknown_provider' THEN 404 ELSE 400 END AS INT)
                AS response_status
              FROM (SELECT {checks.ERROR_CODE} AS error_code FROM ({CHAT})) WHERE error_code IS NOT NULL
              UNION ALL
              SELECT CAST(CASE WHEN stage IS NOT NULL THEN status
                          WHEN arrival_seq % 10 = 1 THEN 502 ELSE 200 END AS INT)
              FROM ({checks.decided('prompts', 'block', 4000, '0.02', 'size')}))
            GROUP BY response_status""",
    ),
)
def response_status(spark, sf_dir):
    sized = chat_requests(spark, sf_dir).withColumn("size", F.length("body"))
    chain = live_chain(None, BLOCK, POLICY, token_column="size")
    out = live.decide_requests(sized, chain)
    down = F.col("arrival_seq") % 10 == 1
    out = out.withColumns(
        {
            "upstream_error": F.when(down, "connect timeout"),
            "upstream_status_code": F.when(~down, 200),
        }
    )
    return out.groupBy(ledger.response_status(out).alias("response_status")).agg(
        F.count("*").alias("n")
    )


# ---------------------------------------------------------------- audit ledger

_FINDINGS_TEXT = """CASE WHEN secrets > 0 THEN coalesce((SELECT string_agg('secret_scan/' || kind || '/'
      || label || '/' || severity || '/' || preview, ';' ORDER BY s, pos) FROM (SELECT *,
        CASE WHEN length(m) <= 6 THEN repeat('*', length(m)) ELSE left(m, 4) || '***' || right(m, 2) END
        AS preview FROM secret_rows) h WHERE h.arrival_seq = d.arrival_seq), '')
    ELSE coalesce((SELECT string_agg('pii_scan/pii_' || lower(entity) || '/' || entity || '/'
      || severity || '/' || preview, ';' ORDER BY s, pos) FROM (SELECT *,
        CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS severity,
        CASE WHEN length(m) <= 6 THEN repeat('*', length(m)) ELSE left(m, 4) || '***' || right(m, 2) END
        AS preview FROM pii_rows) h WHERE h.arrival_seq = d.arrival_seq), '') END"""

AUDIT_CHECK = f"""SELECT md5(CAST(d.arrival_seq AS VARCHAR)) AS request_id,
      1704067200 + d.arrival_seq AS unix_time, 'openai' AS provider,
      '/v1/chat/completions' AS path, model,
      CASE WHEN stage IS NULL THEN 'allowed' ELSE 'rejected' END AS verdict,
      stage AS rejecting_middleware, reason AS reject_reason, CAST(status AS INT) AS reject_status_code,
      CASE WHEN token_ran THEN known_tokens END AS token_count,
      CASE WHEN token_ran THEN CAST(cost AS STRING) END AS estimated_cost_usd,
      FALSE AS mutations_applied, {_FINDINGS_TEXT} AS findings, CAST(0 AS DOUBLE) AS latency_ms,
      CAST(NULL AS INT) AS upstream_status_code, CAST(NULL AS VARCHAR) AS upstream_error
    FROM ({checks.decided('prompts', 'block', 4000, '0.02', 'known_tokens')}) d"""


def audit_columns(records: DataFrame) -> DataFrame:
    """The sixteen columns with nested and exact ones as text."""
    lines = F.transform(
        "findings",
        lambda f: F.concat_ws("/", f["scanner"], f["kind"], f["label"], f["severity"], f["preview"]),
    )
    return records.select(
        "request_id", F.unix_seconds("timestamp").alias("unix_time"), "provider", "path", "model",
        "verdict", "rejecting_middleware", "reject_reason", "reject_status_code", "token_count",
        text("estimated_cost_usd").alias("estimated_cost_usd"), "mutations_applied",
        F.array_join(lines, ";").alias("findings"), "latency_ms",
        "upstream_status_code", "upstream_error",
    )


def audit_of_prompts(spark, sf_dir) -> DataFrame:
    chain, out = decide_mixed(spark, sf_dir, BLOCK)
    return ledger.build_ledger(out, chain.names)


@register("audit_ledger", checks.with_scans(MIXED, AUDIT_CHECK))
def audit_ledger(spark, sf_dir):
    return audit_columns(audit_of_prompts(spark, sf_dir))


LEDGER_SQL = checked("ledger_rows")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a ledger with findings arrays."""
    rows = derive(spark, sf_dir, "ledger_rows")
    secret = F.struct(
        F.lit("secret_scan").alias("scanner"), F.lit("aws_access_key_id").alias("kind"),
        F.lit("AWS Access Key ID").alias("label"), F.lit("high").alias("severity"),
        F.lit("AKIA***XX").alias("preview"),
    )
    person = F.struct(
        F.lit("pii_scan").alias("scanner"), F.lit("pii_email_address").alias("kind"),
        F.lit("EMAIL_ADDRESS").alias("label"), F.lit("high").alias("severity"),
        F.lit("u@ex***om").alias("preview"),
    )
    findings = F.concat(
        F.when(F.col("has_secret"), F.array(secret)).otherwise(empty(LEDGER_FINDINGS)),
        F.array_repeat(person, F.col("n_pii").cast("int")),
    ).cast(LEDGER_FINDINGS)
    return rows.withColumn("findings", findings).drop("has_secret", "n_pii").select(
        "arrival_seq", *[c for c in ledgers.LEDGER.names if c != "arrival_seq"]
    )


@register(
    "audit_dedupe",
    f"""WITH copies AS (SELECT * FROM ({LEDGER_SQL}) UNION ALL
          SELECT * REPLACE (arrival_seq + 1000000 AS arrival_seq, 'changed' AS verdict)
          FROM ({LEDGER_SQL}) WHERE arrival_seq % 20 = 0)
        SELECT request_id, arrival_seq, verdict, model, latency_ms FROM copies
        QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY arrival_seq) = 1""",
)
def audit_dedupe(spark, sf_dir):
    first = event_ledger(spark, sf_dir)
    again = first.where(F.col("arrival_seq") % 20 == 0).withColumns(
        {"arrival_seq": F.col("arrival_seq") + 1_000_000, "verdict": F.lit("changed")}
    )
    out = ledger.first_per_request(again.unionByName(first))
    return out.select("request_id", "arrival_seq", "verdict", "model", "latency_ms")


@register(
    "upstream_join",
    f"""WITH decisions AS (SELECT arrival_seq, md5(CAST(arrival_seq AS STRING)) AS request_id,
          CASE WHEN arrival_seq % 5 = 4 THEN 'rejected' ELSE 'allowed' END AS verdict FROM ({CHAT})),
        calls AS (SELECT * FROM ({checked('upstream_calls')}) WHERE arrival_seq % 3 <> 0)
        SELECT d.request_id, verdict,
          CAST(CASE WHEN verdict = 'allowed' AND upstream_error IS NULL THEN upstream_status_code END AS INT)
            AS upstream_status_code,
          CASE WHEN verdict = 'allowed' THEN upstream_error END AS upstream_error,
          CASE WHEN verdict = 'allowed' AND latency_ms IS NOT NULL THEN latency_ms ELSE 0.5 END AS latency_ms
        FROM decisions d LEFT JOIN calls c ON d.request_id = c.request_id""",
)
def upstream_join(spark, sf_dir):
    decisions = chat_requests(spark, sf_dir).select(
        "arrival_seq", F.md5(F.col("arrival_seq").cast("string")).alias("request_id"),
        F.when(F.col("arrival_seq") % 5 == 4, "rejected").otherwise("allowed").alias("verdict"),
        F.lit(0.5).alias("latency_ms"), F.lit(None).cast("int").alias("upstream_status_code"),
        F.lit(None).cast("string").alias("upstream_error"),
    )
    calls = derive(spark, sf_dir, "upstream_calls").where(F.col("arrival_seq") % 3 != 0)
    out = ledger.attach_upstream(decisions, calls.unionByName(calls))
    return out.select(
        "request_id", "verdict", "upstream_status_code", "upstream_error", "latency_ms"
    )


@register(
    "leak_audit",
    checks.with_scans(
        MIXED,
        """SELECT 'ledger' AS what, CAST(0 AS BIGINT) AS leaking UNION ALL
           SELECT 'prompts', count(DISTINCT arrival_seq) FROM secret_rows""",
    ),
)
def leak_audit(spark, sf_dir):
    """Raw secrets in the ledger (none) and, as a control, in the prompts."""

    def leaking(table: DataFrame, what: str) -> DataFrame:
        return ledger.leaks(table).agg(F.count("*").alias("leaking")).select(
            F.lit(what).alias("what"), "leaking"
        )

    prompts = mixed_prompts(spark, sf_dir).select("arrival_seq", "content")
    return leaking(audit_of_prompts(spark, sf_dir), "ledger").unionByName(
        leaking(prompts, "prompts")
    )


# ---------------------------------------------------------------- sinks

_SUMMARY = """count(*) AS total_requests, count(*) FILTER (verdict = 'allowed') AS allowed,
    count(*) FILTER (verdict <> 'allowed') AS rejected,
    round(coalesce(count(*) FILTER (verdict <> 'allowed') / nullif(count(*), 0), 0), 6) AS rejection_rate,
    CAST(CAST(coalesce(sum(estimated_cost_usd), 0) AS DECIMAL(38,18)) AS STRING)
      AS total_estimated_cost_usd,
    round(coalesce(avg(latency_ms), 0), 6) AS avg_latency_ms"""


def summary_of(records: DataFrame) -> DataFrame:
    return rounded(stats.summary(records))


def rounded(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {
            "rejection_rate": F.round("rejection_rate", 6),
            "avg_latency_ms": F.round("avg_latency_ms", 6),
            "total_estimated_cost_usd": text("total_estimated_cost_usd"),
        }
    )


@register("json_ledger", f"SELECT {_SUMMARY} FROM ({LEDGER_SQL})")
def json_ledger(spark, sf_dir):
    folder = fresh_folder(spark, "ledger-json")
    ledgers.JsonLines(folder).write(event_ledger(spark, sf_dir))
    return summary_of(ledgers.read_json_lines(spark, folder))


@register(
    "table_ledger",
    f"""SELECT model, count(*) AS n, CAST(sum(len_findings) AS BIGINT) AS findings FROM (
          SELECT model, n_pii + CASE WHEN has_secret THEN 1 ELSE 0 END AS len_findings
          FROM ({LEDGER_SQL})) GROUP BY model""",
)
def table_ledger(spark, sf_dir):
    """Written twice: ids already in the table are not stored again."""
    sink = ledgers.LedgerTable(fresh_folder(spark, "ledger-table"), "audit_records")
    sink.write(event_ledger(spark, sf_dir))
    sink.write(event_ledger(spark, sf_dir))
    rows = ledgers.read_table(spark, sink.path, sink.table)
    return rows.groupBy("model").agg(
        F.count("*").alias("n"), F.sum(F.size("findings").cast("long")).alias("findings")
    )


_NAMELESS = f"""SELECT *, arrival_seq % 5 = 0 AS no_id, arrival_seq % 7 = 0 AS no_day FROM ({LEDGER_SQL})"""


@register(
    "ledger_rewrites",
    f"""SELECT no_id, no_day, count(*) AS n, CAST(sum(len_findings) AS BIGINT) AS findings FROM (
          SELECT no_id, no_day, n_pii + CASE WHEN has_secret THEN 1 ELSE 0 END AS len_findings FROM ({_NAMELESS}))
        GROUP BY no_id, no_day""",
)
def ledger_rewrites(spark, sf_dir):
    """Three overlapping batches, then all again; records without an id or a day included."""
    sink = ledgers.LedgerTable(fresh_folder(spark, "ledger-rewrites"), "audit_records")
    records = event_ledger(spark, sf_dir).withColumns(
        {
            "request_id": F.when(F.col("arrival_seq") % 5 != 0, F.col("request_id")),
            "timestamp": F.when(F.col("arrival_seq") % 7 != 0, F.col("timestamp")),
        }
    )
    third = F.col("arrival_seq") % 3
    for batch in (records.where(third < 2), records.where(third > 0), records):
        sink.write(batch)
    rows = ledgers.read_table(spark, sink.path, sink.table)
    return rows.groupBy(F.col("request_id").isNull().alias("no_id"), F.col("day").isNull().alias("no_day")).agg(
        F.count("*").alias("n"), F.sum(F.size("findings").cast("long")).alias("findings")
    )


@register(
    "log_events",
    f"""SELECT 'audit.request' AS event, 'info' AS level, verdict, count(*) AS n
        FROM ({LEDGER_SQL}) GROUP BY verdict""",
)
def log_events(spark, sf_dir):
    folder = fresh_folder(spark, "ledger-log")
    ledgers.LogEvents(folder).write(event_ledger(spark, sf_dir))
    line = spark.read.text(folder)
    part = lambda name: F.get_json_object("value", f"$.{name}")
    return line.groupBy(
        part("event").alias("event"), part("level").alias("level"), part("verdict").alias("verdict")
    ).agg(F.count("*").alias("n"))


@register(
    "fan_out",
    f"""SELECT what, CAST(CASE what WHEN 'ring' THEN least(n, 1000) ELSE n END AS BIGINT) AS n
        FROM (SELECT count(*) AS n FROM ({LEDGER_SQL}))
        CROSS JOIN (VALUES ('json'), ('ring'), ('table')) AS sinks(what)""",
)
def fan_out(spark, sf_dir):
    """Every sink gets every record; one in the middle that fails stops none."""

    class Broken:
        def write(self, records: DataFrame) -> None:
            raise OSError("no space left")

    folder = fresh_folder(spark, "fan-out")
    ring = ledgers.Ring(f"{folder}/ring")
    sink = ledgers.FanOut(
        [
            ring, Broken(), ledgers.JsonLines(f"{folder}/json"),
            ledgers.LedgerTable(f"{folder}/table"), ledgers.Discard(),
        ]
    )
    failed = sink.write(event_ledger(spark, sf_dir))
    if [type(s) for s, _ in failed] != [Broken]:
        raise AssertionError(f"unexpected sink failures: {failed}")

    def counted(rows: DataFrame, what: str) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")

    return (
        counted(ring.read(spark), "ring")
        .unionByName(counted(ledgers.read_json_lines(spark, f"{folder}/json"), "json"))
        .unionByName(counted(ledgers.read_table(spark, f"{folder}/table"), "table"))
    )


# ---------------------------------------------------------------- statistics


@register("summary", f"SELECT {_SUMMARY} FROM ({LEDGER_SQL})")
def summary(spark, sf_dir):
    return summary_of(event_ledger(spark, sf_dir))


@register("empty_summary", f"SELECT {_SUMMARY} FROM ({LEDGER_SQL}) WHERE verdict = 'unheard of'")
def empty_summary(spark, sf_dir):
    return summary_of(event_ledger(spark, sf_dir).where(F.col("verdict") == "unheard of"))


@register(
    "prompt_summary",
    checks.with_scans(
        MIXED,
        f"""SELECT {_SUMMARY} FROM (SELECT CASE WHEN stage IS NULL THEN 'allowed' ELSE 'rejected' END
              AS verdict, CASE WHEN token_ran THEN cost END AS estimated_cost_usd, 0.0 AS latency_ms
            FROM ({checks.decided('prompts', 'block', 4000, '0.02', 'known_tokens')}))""",
    ),
)
def prompt_summary(spark, sf_dir):
    return summary_of(audit_of_prompts(spark, sf_dir))


def _ranked(by: str, source: str) -> str:
    return f"""SELECT {by} AS category, count(*) AS n, min(arrival_seq) AS first_seen
        FROM ({source}) WHERE {by} IS NOT NULL GROUP BY {by} ORDER BY n DESC, first_seen"""


_SCANNERS = f"""SELECT arrival_seq, unnest(list_concat(
    CASE WHEN has_secret THEN ['secret_scan'] ELSE [] END,
    list_transform(range(0, n_pii), lambda i: 'pii_scan'))) AS scanner FROM ({LEDGER_SQL})"""


@register("rejections_by_middleware", _ranked("rejecting_middleware", LEDGER_SQL))
def rejections_by_middleware(spark, sf_dir):
    return stats.breakdown(event_ledger(spark, sf_dir), stats.BY_MIDDLEWARE)


@register("requests_by_model", _ranked("model", LEDGER_SQL))
def requests_by_model(spark, sf_dir):
    return stats.breakdown(event_ledger(spark, sf_dir), stats.BY_MODEL)


@register("findings_by_scanner", _ranked("scanner", _SCANNERS))
def findings_by_scanner(spark, sf_dir):
    return stats.breakdown(event_ledger(spark, sf_dir), stats.BY_SCANNER)


@register(
    "breakdown_shares",
    f"""SELECT category, n, first_seen, round(n / max(n) OVER () * 100, 6) AS share_of_max
        FROM ({_ranked('model', LEDGER_SQL)})""",
)
def breakdown_shares(spark, sf_dir):
    out = stats.shares(stats.breakdown(event_ledger(spark, sf_dir), stats.BY_MODEL, ordered=False))
    return out.withColumn("share_of_max", F.round("share_of_max", 6))


_RING = f"(SELECT * FROM ({LEDGER_SQL}) ORDER BY arrival_seq DESC LIMIT 1000)"


@register("ring_summary", f"SELECT {_SUMMARY} FROM {_RING}")
def ring_summary(spark, sf_dir):
    return summary_of(stats.ring(event_ledger(spark, sf_dir)))


@register(
    "recent",
    f"""SELECT arrival_seq, request_id, model, verdict, latency_ms FROM ({LEDGER_SQL})
        ORDER BY arrival_seq DESC LIMIT 50""",
)
def recent(spark, sf_dir):
    out = stats.recent(event_ledger(spark, sf_dir))
    return out.select("arrival_seq", "request_id", "model", "verdict", "latency_ms")


@register(
    "alert_level",
    f"""SELECT model, CASE WHEN r > 0.1 THEN 'danger' WHEN r > 0 THEN 'warn' ELSE 'ok' END AS alert
        FROM (SELECT model, count(*) FILTER (verdict <> 'allowed' AND latency_ms > 100) / count(*) AS r
              FROM ({LEDGER_SQL}) GROUP BY model)""",
)
def alert_level(spark, sf_dir):
    slow = (F.col("verdict") != "allowed") & (F.col("latency_ms") > 100)
    rate = F.count_if(slow) / F.count("*")
    return event_ledger(spark, sf_dir).groupBy("model").agg(stats.alert_level(rate).alias("alert"))


_AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"
_MILLIS = f"""greatest(CAST(floor(epoch_us({_AS_OF}) / 1000) AS BIGINT)
    - CAST(floor(epoch_us(timestamp) / 1000) AS BIGINT), 0)"""
_AGE = f"""CASE WHEN {_MILLIS} < 1000 THEN 'just now'
    WHEN {_MILLIS} < 60000 THEN ({_MILLIS} // 1000) || 's ago'
    WHEN {_MILLIS} < 3600000 THEN ({_MILLIS} // 60000) || 'm ago'
    ELSE ({_MILLIS} // 3600000) || 'h ago' END"""


@register(
    "age_buckets",
    f"""SELECT age, stale, count(*) AS n FROM (SELECT {_AGE} AS age,
          CAST(floor(epoch_us({_AS_OF}) / 1000) AS BIGINT)
            - CAST(floor(epoch_us(timestamp) / 1000) AS BIGINT) > 15000 AS stale
          FROM ({LEDGER_SQL})) GROUP BY age, stale""",
)
def age_buckets(spark, sf_dir):
    as_of = F.expr(_AS_OF)
    out = event_ledger(spark, sf_dir).select(
        stats.age_label(F.col("timestamp"), as_of).alias("age"),
        stats.is_stale(F.col("timestamp"), as_of).alias("stale"),
    )
    return out.groupBy("age", "stale").agg(F.count("*").alias("n"))


@register(
    "recent_table",
    f"""SELECT arrival_seq, {_AGE} AS age, provider, model, verdict,
          coalesce(rejecting_middleware, '') AS rejecting_middleware,
          coalesce(CASE WHEN token_count >= 1000 THEN (token_count // 1000) || ','
            || right('00' || (token_count % 1000), 3) ELSE CAST(token_count AS VARCHAR) END, '—') AS tokens,
          coalesce('$' || CASE WHEN estimated_cost_usd = 0 THEN '0'
            ELSE rtrim(CAST(estimated_cost_usd AS VARCHAR), '0') END, '—') AS cost,
          printf('%.2f', latency_ms) || ' ms' AS latency,
          array_to_string(list_concat(
            CASE WHEN has_secret THEN ['secret_scan/aws_access_key_id · AKIA***XX'] ELSE [] END,
            list_transform(range(0, n_pii), lambda i: 'pii_scan/pii_email_address · u@ex***om')), chr(10))
            AS findings
        FROM ({LEDGER_SQL}) ORDER BY arrival_seq DESC LIMIT 25""",
)
def recent_table(spark, sf_dir):
    return stats.recent_table(event_ledger(spark, sf_dir), F.expr(_AS_OF))


# ---------------------------------------------------------------- batch reports

_BATCH = f"""SELECT doc_id AS arrival_seq, 'doc-' || doc_id || '.json' AS file, content, model, known_tokens
    FROM (SELECT arrival_seq AS doc_id, content, model, known_tokens FROM ({MIXED}))
    WHERE doc_id % 9 <> 0"""


def batch_files(spark, sf_dir) -> DataFrame:
    """One body per document, as the file reader gives them; some are broken."""
    prompts = mixed_prompts(spark, sf_dir)
    broken = F.when(F.col("arrival_seq") % 18 == 0, F.lit("not json")).otherwise(F.lit('{"model": 1}'))
    return prompts.select(
        F.concat(F.lit("doc-"), F.col("arrival_seq").cast("string"), F.lit(".json")).alias("label"),
        F.col("arrival_seq").alias("position"),
        F.when(F.col("arrival_seq") % 9 == 0, broken).otherwise(F.col("body")).alias("body"),
        "known_tokens",
    )


def scan_batch(spark, sf_dir) -> tuple[Chain, DataFrame]:
    chain = batch_chain(
        pii_scan=True, tokens=True, token_column="known_tokens",
        policy=pricing.ThresholdPolicy(4_000, Decimal("0.02")),
    )
    return chain, chain.decide(normalise.normalise_files(batch_files(spark, sf_dir)))


_BATCH_DECIDED = checks.decided("prompts", "block", 4000, "0.02", "known_tokens")


@register(
    "file_results",
    checks.with_scans(
        _BATCH,
        f"""SELECT arrival_seq AS position, file,
              CASE WHEN stage IS NULL THEN 'allowed' ELSE 'rejected' END AS verdict,
              stage AS rejecting_middleware, CAST(secrets AS VARCHAR) AS secret_findings,
              CASE WHEN secrets = 0 THEN CAST(piis AS VARCHAR) END AS pii_findings,
              CASE WHEN token_ran THEN CAST(known_tokens AS VARCHAR) END AS token_count,
              CASE WHEN token_ran AND violated <> '' THEN '["' || replace(violated, ', ', '","') || '"]'
                END AS violations, detail
            FROM ({_BATCH_DECIDED})""",
    ),
)
def file_results(spark, sf_dir):
    chain, out = scan_batch(spark, sf_dir)
    results = reports.file_results(out, chain.names)
    note = lambda path: F.get_json_object("annotations", f"$.{path}")
    return results.select(
        "position", "file", "verdict", "rejecting_middleware",
        note("secret_scan.finding_count").alias("secret_findings"),
        note("pii_scan.finding_count").alias("pii_findings"),
        note("tokenomics.token_count").alias("token_count"),
        note("tokenomics.violations").alias("violations"),
        F.get_json_object("reject", "$.detail").alias("detail"),
    )


@register(
    "batch_summary",
    checks.with_scans(
        _BATCH,
        f"""SELECT count(*) AS scanned, count(*) FILTER (stage IS NULL) AS allowed,
              count(*) FILTER (stage IS NOT NULL) AS rejected FROM ({_BATCH_DECIDED})""",
    ),
)
def batch_summary(spark, sf_dir):
    return reports.batch_summary(scan_batch(spark, sf_dir)[1])


_LINES = f"""
    SELECT arrival_seq AS position, file, 0 AS line_no, file || CASE WHEN stage IS NULL THEN ': PASS'
      ELSE ': FAIL (' || stage || ': ' || reason || ')' END AS line FROM decided
    UNION ALL
    SELECT d.arrival_seq, file, CAST(row_number() OVER (PARTITION BY d.arrival_seq ORDER BY s, pos) AS INT),
      '    - ' || label || ' severity=' || severity || ' preview=' || {checks.PREVIEW}
    FROM decided d JOIN secret_rows h ON d.arrival_seq = h.arrival_seq WHERE stage = 'secret_scan'
    UNION ALL
    SELECT d.arrival_seq, file, CAST(row_number() OVER (PARTITION BY d.arrival_seq ORDER BY s, pos) AS INT),
      '    - ' || entity || ' severity=' || {checks.SEVERITY} || ' preview=' || {checks.PREVIEW}
    FROM decided d JOIN pii_rows h ON d.arrival_seq = h.arrival_seq WHERE stage = 'pii_scan'
    UNION ALL
    SELECT 9223372036854775807, '', 0, 'summary: scanned=' || count(*) || ' allowed='
      || count(*) FILTER (stage IS NULL) || ' rejected=' || count(*) FILTER (stage IS NOT NULL) FROM decided"""


@register(
    "report_lines",
    f"""WITH prompts AS ({_BATCH}), secret_rows AS ({checks.secret_hits('prompts')}),
        pii_rows AS ({checks.pii_hits('prompts')}), decided AS ({_BATCH_DECIDED}) {_LINES}""",
)
def report_lines(spark, sf_dir):
    chain, out = scan_batch(spark, sf_dir)
    return reports.report_lines(cut_lineage(reports.without_prompts(out, chain.names)), chain.names)


@register(
    "decision_reports",
    checks.with_scans(
        MIXED,
        f"""SELECT arrival_seq, CASE WHEN stage IS NULL THEN 'allowed' ELSE 'rejected' END AS verdict,
              stage AS rejecting_middleware, CAST(status AS VARCHAR) AS status_code,
              CASE WHEN stage IS NULL THEN 'guardrail: PASS'
                ELSE 'guardrail: FAIL (' || stage || ': ' || reason || ')' || chr(10) || '  ' || detail END
              || chr(10) || '  [secret_scan] finding_count=' || secrets
              || CASE WHEN secrets = 0 THEN '' ELSE (SELECT string_agg(chr(10) || '    - ' || label
                   || ' severity=' || severity || ' preview=' || {checks.PREVIEW}, '' ORDER BY s, pos)
                   FROM secret_rows h WHERE h.arrival_seq = d.arrival_seq) END
              || CASE WHEN token_ran THEN chr(10) || '  [tokenomics] token_count=' || known_tokens
                   || ' estimated_cost_usd=' || CASE WHEN cost = 0 THEN '0'
                      ELSE rtrim(rtrim(CAST(cost AS VARCHAR), '0'), '.') END ELSE '' END AS report
            FROM ({checks.decided('prompts', None, 4000, '0.02', 'known_tokens')}) d""",
    ),
)
def decision_reports(spark, sf_dir):
    chain, out = decide_mixed(spark, sf_dir, None)
    document = out.select(
        "arrival_seq", reports.decision_json(out, chain.names).alias("document"),
        reports.decision_text(out, chain.names).alias("report"),
    )
    part = lambda path: F.get_json_object("document", f"$.{path}")
    return document.select(
        "arrival_seq", part("verdict").alias("verdict"),
        part("rejecting_middleware").alias("rejecting_middleware"),
        part("reject.status_code").alias("status_code"), "report",
    )


@register(
    "gate",
    checks.with_scans(
        _BATCH,
        f"""SELECT 'with broken files' AS batch, CAST(2 AS INT) AS gate UNION ALL
            SELECT 'readable files', CAST(max(CASE WHEN stage IS NULL THEN 0 ELSE 1 END) AS INT)
            FROM ({_BATCH_DECIDED}) UNION ALL
            SELECT 'clean files', CAST(max(CASE WHEN stage IS NULL THEN 0 ELSE 1 END) AS INT)
            FROM ({_BATCH_DECIDED}) WHERE stage IS NULL""",
    ),
)
def gate(spark, sf_dir):
    _, out = scan_batch(spark, sf_dir)
    readable = F.col("position") % 9 != 0
    return reports.gates(
        out,
        {
            "with broken files": F.lit(True), "readable files": readable,
            "clean files": readable & F.col("reject").isNull(),
        },
    )


# ---------------------------------------------------------------- settings and extensions


def _files_of(spark, sf_dir, folder: str) -> DataFrame:
    """One file per conversation turn under ``folder``; (path) of each."""
    rows = chat_requests(spark, sf_dir).select("arrival_seq", "body")
    return requests.write_prompt_files(rows, folder, "arrival_seq")


@register(
    "prompt_list",
    f"""SELECT CAST(row_number() OVER (ORDER BY arrival_seq DESC) AS BIGINT) AS position, arrival_seq, error_code
        FROM (SELECT arrival_seq, {_FILE_ERROR} AS error_code FROM ({CHAT}) WHERE arrival_seq % 1024 < 2)
        UNION ALL SELECT 0, NULL, 'empty_body'""",
)
def prompt_list(spark, sf_dir):
    """Files named one by one, last first, after one that is missing; order and labels stay."""
    folder = fresh_folder(spark, "prompt-list")
    files = _files_of(spark, sf_dir, folder).withColumn("number", F.regexp_extract("path", "arrival_seq=([^/.]+)", 1).cast("long"))
    # The list is the caller's: its paths, not what they hold, are on the driver.
    paths = files.where("number % 1024 < 2").orderBy(F.desc("number"), "path").select("path").toPandas()["path"]
    listed = requests.read_prompt_list(spark, [f"{folder}/missing.txt", *paths])
    out = normalise.normalise_files(listed)
    named = F.regexp_extract("label", "arrival_seq=([0-9]+)", 1)
    return out.select("position", F.nullif(named, F.lit("")).cast("long").alias("arrival_seq"), "error_code")


@register(
    "empty_glob",
    f"""SELECT 'all' AS files, count(*) AS scanned, CAST(2 AS INT) AS gate FROM ({CHAT})
        UNION ALL SELECT 'none', 0, 0""",
)
def empty_glob(spark, sf_dir):
    """A pattern that matches no file is a batch of nothing, which passes the gate."""
    folder = fresh_folder(spark, "empty-glob")
    _files_of(spark, sf_dir, folder)

    def scanned(pattern: str, name: str) -> DataFrame:
        files = normalise.normalise_files(requests.read_prompt_files(spark, folder, pattern=pattern))
        out = batch_chain().decide(files)
        total = out.where(F.col("body").isNotNull()).agg(F.count("*").alias("scanned"))
        return reports.gate(out).select("gate").join(F.broadcast(total)).select(F.lit(name).alias("files"), "scanned", "gate")

    return scanned("*.txt", "all").unionByName(scanned("*.json", "none"))


_LIMITS = {
    "tokens": pricing.ThresholdPolicy(500),
    "cost": pricing.ThresholdPolicy(max_cost_usd=Decimal("0.01")),
    "both": pricing.ThresholdPolicy(500, Decimal("0.01")),
    "live default": pricing.DEFAULT_POLICY,
    "batch default": pricing.BATCH_POLICY,
}
_MOST_TOKENS = {"tokens": "500", "both": "500", "live default": "8000", "batch default": "100000"}
_MOST_USD = {"cost": "0.01", "both": "0.01", "live default": "0.05"}


def _limit_counts(name: str) -> str:
    tokens = f"known_tokens > {_MOST_TOKENS[name]}" if name in _MOST_TOKENS else "FALSE"
    spent = f"cost > CAST('{_MOST_USD[name]}' AS DECIMAL(38,18))" if name in _MOST_USD else "FALSE"
    return f"""SELECT '{name}' AS policy, count(*) FILTER ({tokens}) AS over_tokens, count(*) FILTER ({spent}) AS over_cost,
        count(*) FILTER (NOT ({tokens}) AND NOT ({spent})) AS allowed FROM priced"""


@register(
    "threshold_policies",
    f"WITH priced AS ({checks.priced(f'({MIXED})', 'known_tokens')}) " + " UNION ALL ".join(map(_limit_counts, _LIMITS)),
)
def threshold_policies(spark, sf_dir):
    """One bound, both, and the defaults; a policy without a bound cannot be made."""
    prompts = mixed_prompts(spark, sf_dir).select("model", F.col("known_tokens").alias("token_count"))
    held = lambda name: F.count_if(F.array_contains("violations", name))
    counted = [
        pricing.evaluate(prompts, policy).agg(
            F.lit(name).alias("policy"), held(pricing.TOKEN_LIMIT).alias("over_tokens"),
            held(pricing.COST_LIMIT).alias("over_cost"), F.count_if("is_allowed").alias("allowed"),
        )
        for name, policy in _LIMITS.items()
    ]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


@register(
    "enforced_limits",
    f"""WITH priced AS ({checks.priced(f'({MIXED})', 'known_tokens')}),
        n AS (SELECT count(*) FILTER (known_tokens > 500) AS t,
                     count(*) FILTER (cost > CAST('0.01' AS DECIMAL(38,18))) AS c FROM priced)
        SELECT 'all' AS prompts, CASE WHEN t + c > 0 THEN t || ' rows exceed the token limit, ' || c || ' the cost limit' END
          AS refusal, (SELECT count(*) FROM priced) AS rows FROM n
        UNION ALL SELECT 'within', NULL, count(*) FROM priced
          WHERE known_tokens <= 500 AND cost <= CAST('0.01' AS DECIMAL(38,18))""",
)
def enforced_limits(spark, sf_dir):
    """Prompts beyond a limit raise; those within pass."""
    prompts = mixed_prompts(spark, sf_dir).select("model", F.col("known_tokens").alias("token_count"))
    decided = pricing.evaluate(prompts, _LIMITS["both"])

    def refusal(rows: DataFrame) -> str | None:
        try:
            pricing.assert_no_violations(rows)
        except pricing.ThresholdExceeded as error:
            return str(error)
        return None

    named = {"all": decided, "within": decided.where("is_allowed")}
    said = [rows.agg(F.lit(n).alias("prompts"), F.lit(refusal(rows)).cast("string").alias("refusal"), F.count("*").alias("rows")) for n, rows in named.items()]
    return said[0].unionByName(said[1])


@register(
    "chosen_sinks",
    f"""WITH n AS (SELECT count(*) AS total FROM ({LEDGER_SQL}))
        SELECT 'json' AS sink, total AS records FROM n UNION ALL SELECT 'log', total FROM n
        UNION ALL SELECT 'ring', least(total, 100) FROM n UNION ALL SELECT 'table', total FROM n
        UNION ALL SELECT 'switched off', 0 FROM n""",
)
def chosen_sinks(spark, sf_dir):
    """Settings name the sinks; a ledger that is switched off writes nothing."""
    folder, off = fresh_folder(spark, "chosen"), fresh_folder(spark, "not-chosen")
    records = event_ledger(spark, sf_dir)
    named = lambda at: {f"{kind}_path": f"{at}/{kind}" for kind in ("ring", "json", "table", "log")}
    ledgers.choose_sinks(ring_capacity=100, **named(folder)).write(records)
    ledgers.choose_sinks(enabled=False, **named(off)).write(records)
    written = {
        "json": ledgers.read_json_lines(spark, f"{folder}/json"), "log": spark.read.text(f"{folder}/log"),
        "ring": ledgers.Ring(f"{folder}/ring", 100).read(spark), "table": ledgers.read_table(spark, f"{folder}/table"),
        "switched off": ledgers.Ring(f"{off}/ring").read(spark),
    }
    counted = [rows.agg(F.lit(name).alias("sink"), F.count("*").alias("records")) for name, rows in written.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


class LongWords:
    """A check of a caller's own: prompts with a word of ``most`` letters or more are refused."""

    name = "long_words"

    def __init__(self, most: int):
        self.most = most

    def apply(self, df: DataFrame) -> DataFrame:
        longest = F.array_max(F.transform(F.split("open_content", " "), F.length))
        return df.withColumn(self.name, F.struct(longest.alias("longest"))).withColumn(
            f"{self.name}_reject", F.when(longest >= self.most, reject(422, "long_word", longest.cast("string")))
        )


@register(
    "custom_stage",
    f"""SELECT arrival_seq, CASE WHEN longest >= 24 THEN 'rejected' ELSE 'allowed' END AS verdict,
          CASE WHEN longest >= 24 THEN 'long_words' END AS rejecting_middleware,
          CAST(CASE WHEN longest >= 24 THEN 422 END AS INT) AS status_code, longest
        FROM (SELECT arrival_seq, CAST(list_max(list_transform(string_split(content, ' '), lambda w: length(w))) AS INT)
                AS longest FROM ({MIXED}))""",
)
def custom_stage(spark, sf_dir):
    out = Chain([LongWords(24)]).decide(mixed_prompts(spark, sf_dir))
    return out.select(
        "arrival_seq", "verdict", "rejecting_middleware", F.col("reject.status_code").alias("status_code"),
        F.col("long_words.longest").alias("longest"),
    )


@register(
    "custom_route",
    f"""SELECT arrival_seq, CASE WHEN arrival_seq % 3 = 0 THEN 'own' END AS provider,
          CASE WHEN arrival_seq % 3 <> 0 THEN 'unknown_provider' END AS error_code,
          arrival_seq % 3 = 0 AND arrival_seq % 2 = 0 AS mutations_applied,
          CASE WHEN arrival_seq % 3 = 0 THEN md5(CASE WHEN arrival_seq % 2 = 0
            THEN 'mail [REDACTED:EMAIL_ADDRESS] now' ELSE 'no mail' END || chr(10) || 'turn ' || arrival_seq) END AS content_hash
        FROM (SELECT conv_id * 1024 + turn AS arrival_seq FROM conversations)""",
)
def custom_route(spark, sf_dir):
    """A provider of a caller's own, with other field names, read and redacted."""
    own = bodies.ProviderRoute("/own/generate", "own", system_field="preamble", messages_field="history", content_field="says")
    seq = (F.col("conv_id") * 1024 + F.col("turn")).alias("arrival_seq")
    preamble = F.when(F.col("arrival_seq") % 2 == 0, "mail a.b@example.com now").otherwise("no mail")
    turns = F.array(F.struct(F.concat(F.lit("turn "), F.col("arrival_seq").cast("string")).alias("says")))
    log = read(spark, sf_dir, "conversations").select(seq).select(
        "arrival_seq", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("arrival_seq")).alias("arrival_ts"),
        F.when(F.col("arrival_seq") % 3 == 0, "/own/generate/").otherwise("/other").alias("path"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.to_json(F.struct(F.lit("m").alias("model"), preamble.alias("preamble"), turns.alias("history"))).alias("body"),
    )
    out = live.decide_requests(log, Chain([PiiStage(REDACT, entities=["EMAIL_ADDRESS"])], routes=(own,)))
    return out.select("arrival_seq", "provider", "error_code", "mutations_applied", F.md5("content").alias("content_hash"))


@register(
    "custom_recogniser",
    f"""WITH found AS (SELECT arrival_seq, unnest(regexp_extract_all(content, 'of|and')) AS hit FROM ({MIXED}))
        SELECT 'CONJUNCTION' AS label, CASE WHEN hit = 'of' THEN 'low' ELSE 'medium' END AS severity, count(*) AS n
        FROM found GROUP BY ALL""",
)
def custom_recogniser(spark, sf_dir):
    """A pattern and a score of a caller's own take the place of the catalogue."""
    own = pii.Recogniser("CONJUNCTION", "of|and", 0.5, score_sql="CASE WHEN {matched} = 'and' THEN 0.7D ELSE 0.5D END")
    found = detect.scan_pii(mixed_prompts(spark, sf_dir), threshold=0.4, recognisers=[own])
    return detect.explode_findings(found, "arrival_seq").groupBy("label", "severity").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- outages


def _outage_check(threshold: int) -> str:
    return f"""WITH calls AS ({checked('upstream_calls')}),
      runs AS (SELECT *, coalesce(max(CASE WHEN NOT failed THEN arrival_seq END) OVER (
          PARTITION BY provider ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
          AS after_seq FROM calls),
      placed AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (
          PARTITION BY provider, after_seq ORDER BY arrival_seq) AS nth FROM runs)
      SELECT provider, CAST(max(nth) AS BIGINT) AS failures,
             max(CASE WHEN failed AND nth = {threshold} THEN arrival_seq END) AS opened_seq,
             CAST(floor(epoch_us(max(CASE WHEN failed AND nth = {threshold} THEN ts END)) / 1000) AS BIGINT)
               AS opened_ms,
             max(CASE WHEN NOT failed THEN arrival_seq END) AS closed_seq,
             CAST(floor(epoch_us(max(CASE WHEN NOT failed THEN ts END)) / 1000) AS BIGINT) AS closed_ms
      FROM placed GROUP BY provider, after_seq HAVING max(nth) >= {threshold}"""


def outage_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "provider", "failures", "opened_seq", F.unix_millis("opened_ts").alias("opened_ms"),
        "closed_seq", F.unix_millis("closed_ts").alias("closed_ms"),
    )


@register("upstream_outages", _outage_check(3))
def upstream_outages(spark, sf_dir):
    calls = derive(spark, sf_dir, "upstream_calls")
    return outage_columns(outages.outages(calls, threshold=3))


@register("upstream_outages_default", _outage_check(outages.FAILURE_THRESHOLD))
def upstream_outages_default(spark, sf_dir):
    return outage_columns(outages.outages(derive(spark, sf_dir, "upstream_calls")))


# ---------------------------------------------------------------- streams

STREAM_FILES = 4


def _as_files(df: DataFrame, folder: str, form: str) -> str:
    """The rows as files written one after the other in arrival order, as a log grows."""
    ends = df.agg(F.min("arrival_seq").alias("lo"), F.max("arrival_seq").alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) // STREAM_FILES + 1
    for part in range(STREAM_FILES):
        start = ends["lo"] + part * step
        rows = df.where((F.col("arrival_seq") >= start) & (F.col("arrival_seq") < start + step))
        rows.coalesce(1).write.format(form).mode("append").save(folder)
    return folder


@register("live_guardrail", checks.with_scans(
    MIXED,
    """SELECT request_id, unix_time, provider, model, verdict, rejecting_middleware, reject_reason,
              reject_status_code, token_count, estimated_cost_usd, findings
       FROM (""" + AUDIT_CHECK + ")",
))
def live_guardrail(spark, sf_dir):
    """Requests as a stream of files, decided and stored once; equals the table run."""
    folder = fresh_folder(spark, "live")
    _as_files(mixed_prompts(spark, sf_dir), f"{folder}/in", "parquet")
    schema = spark.read.parquet(f"{folder}/in").schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    chain = live_chain(None, BLOCK, POLICY, token_column="known_tokens")
    records = ledger.build_ledger(chain.decide(arriving), chain.names)
    sink = ledgers.LedgerTable(f"{folder}/table")
    started = live.start_sinks(records, {"table": sink}, f"{folder}/checkpoints", once=True)
    for query in started.values():
        query.awaitTermination()
    stored = audit_columns(ledgers.read_table(spark, sink.path))
    return stored.select(
        "request_id", "unix_time", "provider", "model", "verdict", "rejecting_middleware",
        "reject_reason", "reject_status_code", "token_count", "estimated_cost_usd", "findings",
    )


def _arriving_ledger(spark, sf_dir, folder: str) -> DataFrame:
    _as_files(event_ledger(spark, sf_dir), f"{folder}/in", "parquet")
    return (
        spark.readStream.schema(ledgers.LEDGER)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/in")
    )


@register("live_summary", f"SELECT {_SUMMARY} FROM ({LEDGER_SQL})")
def live_summary(spark, sf_dir):
    folder = fresh_folder(spark, "live-summary")
    query = live.start_summary(
        _arriving_ledger(spark, sf_dir, folder), f"{folder}/out", f"{folder}/checkpoint", once=True
    )
    query.awaitTermination()
    versions = spark.read.parquet(f"{folder}/out")
    newest = versions.agg(F.max("version")).scalar()
    return rounded(versions.where(F.col("version") == newest).drop("version"))


_BREAKDOWNS = {
    stats.BY_MIDDLEWARE: _ranked("rejecting_middleware", LEDGER_SQL),
    stats.BY_MODEL: _ranked("model", LEDGER_SQL),
    stats.BY_SCANNER: _ranked("scanner", _SCANNERS),
}


@register(
    "live_breakdowns",
    " UNION ALL ".join(
        f"SELECT '{by}' AS breakdown, row_number() OVER (ORDER BY n DESC, first_seen) AS place, category, n FROM ({sql})"
        for by, sql in _BREAKDOWNS.items()
    ),
)
def live_breakdowns(spark, sf_dir):
    """One stream feeds the three breakdowns, each in its order."""
    folder = fresh_folder(spark, "live-breakdowns")
    query = live.start_breakdowns(
        _arriving_ledger(spark, sf_dir, folder), f"{folder}/out", f"{folder}/checkpoint", once=True
    )
    query.awaitTermination()
    # A breakdown has one short row per category.
    placed = F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")).cast("long")
    shown = [
        live.read_breakdown(spark, f"{folder}/out", by).select(
            F.lit(by).alias("breakdown"), placed.alias("place"), "category", "n"
        )
        for by in _BREAKDOWNS
    ]
    return shown[0].union(shown[1]).union(shown[2])


@register("live_ring", f"SELECT arrival_seq, request_id, verdict FROM {_RING}")
def live_ring(spark, sf_dir):
    folder = fresh_folder(spark, "live-ring")
    ring = ledgers.Ring(f"{folder}/ring")
    started = live.start_sinks(
        _arriving_ledger(spark, sf_dir, folder), {"ring": ring}, f"{folder}/checkpoints", once=True
    )
    started["ring"].awaitTermination()
    return ring.read(spark).select("arrival_seq", "request_id", "verdict")


_ANSWERS = f"""SELECT d.request_id, verdict,
      CAST(CASE WHEN c.upstream_error IS NULL THEN c.upstream_status_code END AS INT) AS upstream_status_code,
      c.upstream_error, coalesce(c.latency_ms, 0.5) AS latency_ms, CAST(0 AS BIGINT) AS late_rows
    FROM ({LEDGER_SQL}) d
    LEFT JOIN (SELECT * FROM ({checked('upstream_calls')}) WHERE arrival_seq % 3 <> 0) c
      ON d.request_id = c.request_id AND verdict = 'allowed' AND c.arrival_seq % 90 <= 60"""


def _decisions_and_calls(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Decisions, and calls that answer up to an hour and a half later; a third has none."""
    decisions = event_ledger(spark, sf_dir).withColumns(
        {
            "upstream_status_code": F.lit(None).cast("int"), "upstream_error": F.lit(None).cast("string"),
            "latency_ms": F.lit(0.5),
        }
    )
    calls = derive(spark, sf_dir, "upstream_calls").where(F.col("arrival_seq") % 3 != 0)
    later = F.make_dt_interval(mins=(F.col("arrival_seq") % 90).cast("int"))
    return decisions, calls.withColumn("ts", F.col("ts") + later)


@register("upstream_in_time", _ANSWERS)
def upstream_in_time(spark, sf_dir):
    out = ledger.attach_upstream(*_decisions_and_calls(spark, sf_dir), answer_within="1 hour")
    return out.select(
        "request_id", "verdict", "upstream_status_code", "upstream_error", "latency_ms",
        F.lit(0).cast("long").alias("late_rows"),
    )


@register("live_upstream", _ANSWERS)
def live_upstream(spark, sf_dir):
    """Both sides as streams; what still waits at the end is added by the closing pass."""
    folder = fresh_folder(spark, "live-upstream")
    decisions, calls = _decisions_and_calls(spark, sf_dir)
    arriving = {}
    for name, rows in {"decisions": decisions, "calls": calls}.items():
        _as_files(rows, f"{folder}/{name}", "parquet")
        arriving[name] = (
            spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema)
            .option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
        )
    joined = live.attach_upstream(arriving["decisions"], arriving["calls"], "2 hours", "1 hour")
    sink = ledgers.JsonLines(f"{folder}/records")
    query = live.start_sinks(joined, {"records": sink}, f"{folder}/checkpoints", once=True)["records"]
    query.awaitTermination()
    recorded = ledgers.read_json_lines(spark, sink.path)
    rest = live.unmatched_decisions(ledger.first_per_request(decisions), recorded)
    return recorded.unionByName(rest).select(
        "request_id", "verdict", "upstream_status_code", "upstream_error", "latency_ms",
        F.lit(live.late_rows(query)).cast("long").alias("late_rows"),
    )


@register("live_outages", _outage_check(3))
def live_outages(spark, sf_dir):
    folder = fresh_folder(spark, "live-outages")
    calls = derive(spark, sf_dir, "upstream_calls").select(
        "provider", "arrival_seq", "ts", "failed"
    )
    _as_files(calls, f"{folder}/in", "parquet")
    arriving = (
        spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    )
    tracker = OutageTracker(f"{folder}/state", threshold=3)
    tracker.start(arriving, f"{folder}/checkpoint", once=True).awaitTermination()
    open_now = tracker.open(spark).withColumns(
        {"closed_seq": F.lit(None).cast("long"), "closed_ts": F.lit(None).cast("timestamp")}
    )
    return outage_columns(tracker.ended(spark).unionByName(open_now))
