from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from promptledger.functions.tokens import FALLBACK_ENCODING, TokenCounter, Vocabulary
from promptledger.operators import pricing


def priced(spark, rows, policy=pricing.DEFAULT_POLICY, **options):
    df = spark.createDataFrame(
        [(i, m, t) for i, (m, t) in enumerate(rows)], "arrival_seq long, model string, token_count int"
    )
    out = pricing.evaluate(df, policy, **options)
    return [r.asDict() for r in out.orderBy("arrival_seq").collect()]


def test_costs_are_exact_and_models_normalised(spark):
    rows = [("GPT-4O", 3), ("  gpt-4o-mini ", 7), ("gpt-4-turbo", 1), ("gpt-3.5-turbo", 2_000_000_000)]
    got = priced(spark, rows)
    price = {m: Decimal(p) for m, p, _, _ in pricing.PRICES}
    for row, (model, tokens) in zip(got, rows, strict=True):
        assert row["estimated_cost_usd"] == price[model.strip().lower()] * tokens
        assert not row["fallback_applied"] and row["pricing_error"] is None


def test_unknown_models_take_the_dearest_rate(spark):
    (row,) = priced(spark, [("mystery", 10)])
    assert row["fallback_applied"] and row["encoding_used"] == FALLBACK_ENCODING
    assert row["estimated_cost_usd"] == max(Decimal(p[1]) for p in pricing.PRICES) * 10


@pytest.mark.parametrize("model", ["", "   ", None])
def test_blank_models_are_errors(spark, model):
    assert priced(spark, [(model, 1)])[0]["pricing_error"] == "blank_model"


def test_strict_mode(spark):
    df = spark.createDataFrame([("gpt-4o",), ("x",), ("x",), (" ",), (None,)], "model string")
    assert {tuple(r) for r in pricing.unknown_models(df).collect()} == {("x", 2), (" ", 1), (None, 1)}
    with pytest.raises(pricing.UnpricedModel, match="4 rows name 3 models"):
        pricing.assert_priced(df)
    pricing.assert_priced(df.where("model = 'gpt-4o'"))


@pytest.mark.parametrize(
    "policy, expected",
    [
        (pricing.ThresholdPolicy(100), []),
        (pricing.ThresholdPolicy(99), ["token_limit"]),
        (pricing.ThresholdPolicy(None, Decimal("0.00025")), []),
        (pricing.ThresholdPolicy(None, Decimal("0.00024999")), ["cost_limit"]),
        (pricing.ThresholdPolicy(1, Decimal("0.0000001")), ["token_limit", "cost_limit"]),
    ],
)
def test_bounds_are_inclusive(spark, policy, expected):
    (row,) = priced(spark, [("gpt-4o", 100)], policy)
    assert row["violations"] == expected and row["is_allowed"] == (not expected)


@pytest.mark.parametrize("bounds", [(None, None), (0, None), (-1, None), (None, Decimal(0)), (5, Decimal(-1))])
def test_bad_policies(bounds):
    with pytest.raises(ValueError):
        pricing.ThresholdPolicy(*bounds)


def test_enforce(spark):
    df = spark.createDataFrame([(0, "gpt-4o", 9), (1, "gpt-4o", 5)], "arrival_seq long, model string, token_count int")
    pricing.assert_no_violations(pricing.evaluate(df, pricing.ThresholdPolicy(9)))
    with pytest.raises(pricing.ThresholdExceeded, match="1 rows exceed the token limit, 0"):
        pricing.assert_no_violations(pricing.evaluate(df, pricing.ThresholdPolicy(8)))


def test_completion_cost(spark):
    (row,) = priced(spark, [("gpt-4o", 100)], completion_tokens="token_count")
    assert row["completion_cost_usd"] == Decimal("0.001")


def test_own_price_table(spark):
    own = spark.createDataFrame(
        [("mine", Decimal("0.5"), Decimal("1"), "o200k_base")],
        "price_key string, input_usd decimal(18,12), output_usd decimal(18,12), encoding string",
    )
    got = priced(spark, [("Mine", 2), ("gpt-4o", 2)], prices=own)
    assert [r["estimated_cost_usd"] for r in got] == [Decimal(1), Decimal("0.00006")]


# ---------------------------------------------------------------- tokens


def tokens(spark, counter, texts, encoding="cl100k_base"):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    out = df.select("i", counter.count(F.col("t"), F.lit(encoding)).alias("n"))
    return [r["n"] for r in out.orderBy("i").collect()]


def test_counts_agree_with_the_tokenizer(spark, counter):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    texts = ["", "hello world", "日本語 😀", "<|endoftext|>", "a\n\n b\tc", "x" * 5000]
    assert tokens(spark, counter, texts) == [len(plain.encode_ordinary(t)) for t in texts]


def test_null_text_is_not_counted(spark, counter):
    assert tokens(spark, counter, [None, "", "a"]) == [None, 0, 1]


def test_count_grows_in_step_with_the_text(spark, counter):
    one, two = tokens(spark, counter, ["word " * 1000, "word " * 2000])
    assert abs(two - 2 * one) <= 2


def test_unregistered_encoding_falls_back(spark, counter):
    text = ["naïve 日本語 text"]
    assert tokens(spark, counter, text, "new_base") == tokens(spark, counter, text, FALLBACK_ENCODING)
    assert tokens(spark, counter, text, "o200k_base") != tokens(spark, counter, text, FALLBACK_ENCODING)


def test_fallback_vocabulary_is_required(spark):
    with pytest.raises(ValueError):
        TokenCounter(spark, {"o200k_base": Vocabulary("x")})


def test_white_space_of_any_kind_is_stripped(spark):
    models = ["gpt-4o\t", "\n GPT-4o ", " gpt-4o\r\n", "\n", "\t 　"]
    df = spark.createDataFrame(list(enumerate(models)), "i int, model string")
    rows = pricing.with_prices(df).orderBy("i").collect()
    assert [r.fallback_applied for r in rows[:3]] == [False] * 3
    assert [r.pricing_error is not None for r in rows] == [False] * 3 + [True] * 2
