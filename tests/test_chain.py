import json
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import SECRETS, chat, requests
from promptledger.functions.recognisers import EMAIL_ADDRESS, Recogniser
from promptledger.operators import ledger, normalise
from promptledger.operators.pricing import BATCH_POLICY, DEFAULT_POLICY, ThresholdPolicy
from promptledger.plans.chain import (
    BLOCK,
    REDACT,
    Chain,
    PiiStage,
    SecretStage,
    TokenStage,
    batch_chain,
    live_chain,
)
from promptledger.schemas import LEDGER, REJECT

OPENAI = "/v1/chat/completions"
KEY = SECRETS["aws_access_key_id"]


def run(spark, chain, *bodies):
    df = normalise.normalise(requests(spark, [(OPENAI, b) for b in bodies]))
    df = df.withColumn("known", F.length("content"))
    return chain.decide(df)


def decided(spark, chain, *bodies):
    return [r.asDict(recursive=True) for r in run(spark, chain, *bodies).orderBy("arrival_seq").collect()]


def known(policy, pii=None):
    return live_chain(None, pii, policy, token_column="known")


def test_clean_prompt_passes_with_figures(spark):
    (row,) = decided(spark, known(DEFAULT_POLICY, BLOCK), chat("gpt-4o", "hello"))
    assert row["verdict"] == "allowed" and row["reject"] is None
    assert row["secret_scan"] == {"finding_count": 0, "findings": None, "policy": None}
    assert row["pii_scan"]["finding_count"] == 0
    assert row["tokenomics"] == {
        "token_count": 5, "estimated_cost_usd": Decimal("0.0000125"),
        "encoding_used": "o200k_base", "fallback_applied": False, "violations": None,
    }


def test_secrets_win_over_pii_and_tokens_and_stop_the_chain(spark):
    body = chat("gpt-4o", f"{KEY} a@b.com " * 200)
    (row,) = decided(spark, known(ThresholdPolicy(1), BLOCK), body)
    assert row["rejecting_middleware"] == "secret_scan"
    assert row["reject"] == {
        "status_code": 403, "reason": "secret_exposure_detected",
        "detail": "Prompt contains 200 secret value(s); refusing to forward.",
    }
    assert row["pii_scan"] is None and row["tokenomics"] is None


def test_pii_blocks_before_tokens(spark):
    (row,) = decided(spark, known(ThresholdPolicy(1), BLOCK), chat("gpt-4o", "a@b.com"))
    assert row["reject"]["reason"] == "pii_exposure_detected"
    assert row["reject"]["detail"] == "Prompt contains 1 PII value(s); refusing to forward."
    assert row["tokenomics"] is None and row["pii_scan"]["policy"] is None


def test_tokens_reject_with_413(spark):
    (row,) = decided(spark, known(ThresholdPolicy(1, Decimal("0.0000001"))), chat("gpt-4o", "hello"))
    assert row["reject"]["status_code"] == 413
    assert row["reject"]["detail"].endswith("threshold: token_limit, cost_limit")
    assert row["tokenomics"]["violations"] == ["token_limit", "cost_limit"]


def test_redaction_reaches_body_and_later_stages(spark):
    text = "write a@b.com or a@b.com"
    (row,) = decided(spark, known(DEFAULT_POLICY, REDACT), chat("gpt-4o", text, "also a@b.com"))
    assert row["verdict"] == "allowed" and row["mutations_applied"]
    assert "a@b.com" not in row["body"] and row["body"].count("[REDACTED:EMAIL_ADDRESS]") == 3
    assert row["content"].count("[REDACTED:EMAIL_ADDRESS]") == 3
    assert row["pii_scan"]["policy"] == "redact" and row["pii_scan"]["finding_count"] == 3


def test_tokens_count_the_redacted_text(spark, counter):
    chain = live_chain(counter, REDACT)
    rows = decided(spark, chain, chat("gpt-4o", "a@b.com"), chat("gpt-4o", "[REDACTED:EMAIL_ADDRESS]"))
    assert rows[0]["tokenomics"]["token_count"] == rows[1]["tokenomics"]["token_count"] > 0


def test_rejected_rows_do_not_reach_the_tokenizer(spark, counter):
    (row,) = decided(spark, live_chain(counter), chat("gpt-4o", KEY))
    assert row["tokenomics"] is None


def test_blank_model_is_an_error_without_record(spark):
    chain = known(DEFAULT_POLICY)
    out = run(spark, chain, chat(" ", "hi"), chat(" ", KEY))
    rows = out.withColumn("upstream_error", F.lit(None).cast("string")).withColumn(
        "upstream_status_code", F.lit(200)
    )
    status = rows.orderBy("arrival_seq").select(ledger.response_status(rows)).collect()
    assert [r[0] for r in status] == [500, 403]
    assert [r["arrival_seq"] for r in ledger.build_ledger(out, chain.names).collect()] == [1]


def test_empty_chain_and_duplicate_names(spark):
    (row,) = decided(spark, Chain(), chat("gpt-4o", KEY))
    assert row["verdict"] == "allowed" and not row["mutations_applied"]
    with pytest.raises(ValueError):
        Chain([SecretStage(), SecretStage()])


def test_stage_options():
    with pytest.raises(ValueError):
        PiiStage("shrug")
    with pytest.raises(ValueError):
        PiiStage(threshold=2)
    with pytest.raises(ValueError):
        TokenStage()


def test_profiles():
    assert live_chain(None, token_column="n").names == ["secret_scan", "tokenomics"]
    assert live_chain(None, BLOCK, token_column="n").names == ["secret_scan", "pii_scan", "tokenomics"]
    assert batch_chain().names == ["secret_scan"]
    full = batch_chain(pii_scan=True, tokens=True, token_column="n")
    assert full.names == ["secret_scan", "pii_scan", "tokenomics"]
    assert full.stages[1].policy == BLOCK and full.stages[2].policy == BATCH_POLICY


class ShoutStage:
    """A stage as a user would write it."""

    name = "shouting"

    def apply(self, df):
        loud = F.col("open_content") == F.upper("open_content")
        note = F.struct(
            F.lit("12").alias("token_count"),
            F.array(
                F.struct(
                    F.lit("loud").alias("kind"), F.lit("Loud").alias("label"),
                    F.lit("low").alias("severity"), F.lit("***").alias("preview"),
                ),
                F.struct(
                    F.lit(None).cast("string").alias("kind"), F.lit("Partial").alias("label"),
                    F.lit("low").alias("severity"), F.lit("***").alias("preview"),
                ),
            ).alias("findings"),
        )
        refused = F.struct(F.lit(418).alias("status_code"), F.lit("loud").alias("reason"), F.lit("d").alias("detail"))
        return df.withColumns(
            {"shouting": F.when(loud, note), "shouting_reject": F.when(loud, refused).cast(REJECT)}
        )


def test_custom_stage_and_partial_findings(spark):
    chain = Chain([SecretStage(), ShoutStage(), PiiStage(recognisers=[EMAIL_ADDRESS])])
    out = run(spark, chain, chat("gpt-4o", "HEY A@B.COM"), chat("gpt-4o", "hey a@b.com"))
    rows = ledger.build_ledger(out, chain.names).orderBy("arrival_seq").collect()
    assert [r["rejecting_middleware"] for r in rows] == ["shouting", "pii_scan"]
    assert [[(f["scanner"], f["kind"]) for f in r["findings"]] for r in rows] == [
        [("shouting", "loud")], [("pii_scan", "pii_email_address")],
    ]
    assert rows[0]["token_count"] is None


class Forgetful:
    name = "forgetful"

    def apply(self, df):
        return df


def test_stage_that_adds_nothing_is_refused(spark):
    with pytest.raises(ValueError, match="forgetful"):
        run(spark, Chain([Forgetful()]), chat("gpt-4o", "x"))


def test_ledger_record(spark):
    chain = known(DEFAULT_POLICY, REDACT)
    out = run(spark, chain, chat("gpt-4o", "a@b.com"), chat("gpt-4o", KEY), "broken")
    records = ledger.build_ledger(out, chain.names)
    assert records.schema.names == LEDGER.names
    assert [(f.name, f.dataType) for f in records.schema] == [(f.name, f.dataType) for f in LEDGER]
    first, second = records.orderBy("arrival_seq").collect()
    assert first["mutations_applied"] and first["verdict"] == "allowed"
    assert first["token_count"] == len("a@b.com")  # the known count, given beforehand
    assert second["reject_status_code"] == 403 and second["estimated_cost_usd"] is None
    assert KEY not in str(second) and "a@b.com" not in str(first)
    assert ledger.leaks(records).count() == 0 and ledger.leaks(out).count() == 1


PAIR = Recogniser("PAIR", r"AB\s+CD(?:\s+EF)?", 1.0)
WIDE = Recogniser("WIDE", r"x+AB", 1.0)


def redacting(*recognisers):
    return Chain([PiiStage(REDACT, recognisers=recognisers)])


@pytest.mark.parametrize(
    "contents, want",
    [
        (("one AB", "CD two"), ["one [REDACTED:PAIR]", " two"]),
        (("AB CD", "AB", "CD", "AB CD"), ["[REDACTED:PAIR]"] * 2 + ["", "[REDACTED:PAIR]"]),
        (("AB", "", "CD", "EF z"), ["[REDACTED:PAIR]", "", "", " z"]),
        (("é😀 AB\n", "\nCD"), ["é😀 [REDACTED:PAIR]", ""]),
        (("xxAB", "CD"), ["[REDACTED:WIDE][REDACTED:PAIR]", ""]),
        (("xxAB", "no CD"), ["[REDACTED:WIDE]", "no CD"]),
        ((["AB", "CD"], [{"type": "text", "text": "a AB"}, {"type": "image"}, "CD b"]),
         [["[REDACTED:PAIR]", ""], [{"type": "text", "text": "a [REDACTED:PAIR]"}, {"type": "image"}, " b"]]),
    ],
)
def test_matches_across_message_parts(spark, contents, want):
    (row,) = decided(spark, redacting(PAIR, WIDE), chat("gpt-4o", *contents))
    assert row["mutations_applied"] and row["verdict"] == "allowed"
    assert [m["content"] for m in json.loads(row["body"])["messages"]] == want
    assert not re.search(PAIR.pattern, row["content"]) and row["error_code"] is None


def test_a_match_of_the_joint_alone_is_an_error(spark):
    """Nothing can be cut out of a message, so the request doesn't pass."""
    (row,) = decided(spark, redacting(Recogniser("JOINT", r"\n", 1.0)), chat("gpt-4o", "a", "b"))
    assert row["body"] is None and row["error_code"] == "rewrite_failed" and row["verdict"] is None


def test_names_across_messages(spark):
    names = spark.createDataFrame([("Ada Lovelace",), ("Grace Hopper",)], "name string")
    chain = Chain([PiiStage(REDACT, names=names)])
    system = json.dumps({"model": "m", "system": "ask Grace", "messages": [{"role": "user", "content": "Hopper or Ada"}, {"content": "Lovelace a@b.com"}]})
    df = normalise.normalise(requests(spark, [("/v1/messages", system)]))
    (row,) = chain.decide(df).collect()
    assert row["content"] == "ask [REDACTED:PERSON]\n or [REDACTED:PERSON]\n [REDACTED:EMAIL_ADDRESS]"
