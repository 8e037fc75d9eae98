"""Prices, exact prompt cost and threshold policies."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.functions.tokens import FALLBACK_ENCODING
from promptledger.schemas import MONEY
from promptledger.session import lookup_join

# Model, USD per input token, USD per output token, encoding.
PRICES: tuple[tuple[str, str, str, str], ...] = (
    ("gpt-4o", "0.0000025", "0.000010", "o200k_base"),
    ("gpt-4o-mini", "0.00000015", "0.0000006", "o200k_base"),
    ("gpt-4-turbo", "0.000010", "0.000030", "cl100k_base"),
    ("gpt-4", "0.000030", "0.000060", "cl100k_base"),
    ("gpt-3.5-turbo", "0.0000005", "0.0000015", "cl100k_base"),
)
FALLBACK_INPUT_USD = "0.000030"
FALLBACK_OUTPUT_USD = "0.000060"

TOKEN_LIMIT = "token_limit"
COST_LIMIT = "cost_limit"


@dataclass(frozen=True)
class ThresholdPolicy:
    """Upper bounds, inclusive; at least one of them is given."""

    max_tokens: int | None = None
    max_cost_usd: Decimal | None = None

    def __post_init__(self):
        if self.max_tokens is None and self.max_cost_usd is None:
            raise ValueError("give max_tokens, max_cost_usd or both")
        if self.max_tokens is not None and self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
        if self.max_cost_usd is not None and Decimal(self.max_cost_usd) <= 0:
            raise ValueError("max_cost_usd must be positive")


# The live default and the batch default.
DEFAULT_POLICY = ThresholdPolicy(8_000, Decimal("0.05"))
BATCH_POLICY = ThresholdPolicy(100_000)


class ThresholdExceeded(RuntimeError):
    """Raised by :func:`assert_no_violations`."""


class UnpricedModel(RuntimeError):
    """Raised by :func:`assert_priced`."""


def price_table(spark: SparkSession, rows=PRICES) -> DataFrame:
    """The built-in price list as a table keyed by lower-case model."""
    values = ", ".join(
        f"('{model}', CAST('{paid_in}' AS DECIMAL(18,12)), "
        f"CAST('{paid_out}' AS DECIMAL(18,12)), '{encoding}')"
        for model, paid_in, paid_out, encoding in rows
    )
    return spark.sql(
        f"SELECT * FROM VALUES {values} AS p(price_key, input_usd, output_usd, encoding)"
    )


def price_key(model: Column) -> Column:
    """The model in lower case without white space of any kind around it."""
    return F.lower(F.regexp_replace(model, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def with_prices(
    df: DataFrame, prices: DataFrame | None = None, spread_by: Column | None = None
) -> DataFrame:
    """Add input_usd, output_usd, encoding_used, fallback_applied, pricing_error.

    An unknown model takes the dearest listed rate. A blank one is an error. A
    caller's own price table is measured before it is broadcast.
    """
    keyed = df.withColumn("price_key", price_key(F.col("model")))
    if prices is None:
        priced = keyed.join(F.broadcast(price_table(df.sparkSession)), "price_key", "left")
    else:
        spread = F.col("arrival_seq") if spread_by is None else spread_by
        priced = lookup_join(keyed, prices, "price_key", spread)
    blank = F.col("model").isNull() | (F.col("price_key") == "")
    return priced.select(
        *[F.col(c) for c in df.columns],
        F.coalesce("input_usd", F.lit(FALLBACK_INPUT_USD).cast("decimal(18,12)")).alias("input_usd"),
        F.coalesce("output_usd", F.lit(FALLBACK_OUTPUT_USD).cast("decimal(18,12)")).alias("output_usd"),
        F.coalesce("encoding", F.lit(FALLBACK_ENCODING)).alias("encoding_used"),
        F.col("input_usd").isNull().alias("fallback_applied"),
        F.when(blank, "blank_model").alias("pricing_error"),
    )


def unknown_models(df: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Strict mode: the model names without a price, with their row counts.

    Names are counted first, so the anti join sees one row per name.
    """
    listed = price_table(df.sparkSession) if prices is None else prices
    named = df.groupBy("model").agg(F.count("*").alias("n"))
    return (
        named.withColumn("price_key", F.coalesce(price_key(F.col("model")), F.lit("")))
        .join(listed.select("price_key"), "price_key", "left_anti")
        .select("model", "n")
    )


def assert_priced(df: DataFrame, prices: DataFrame | None = None) -> None:
    """Raise when any model has no price."""
    seen = unknown_models(df, prices).agg(
        F.count("*").alias("models"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
    ).first()
    if seen["models"]:
        raise UnpricedModel(f"{seen['rows']} rows name {seen['models']} models without a price")


def cost(usd_per_token: Column, tokens: Column) -> Column:
    """Price times count in exact decimals."""
    return (usd_per_token * tokens.cast("decimal(19,0)")).cast(MONEY)


def violations(tokens: Column, spent: Column, policy: ThresholdPolicy) -> Column:
    """Names of the exceeded bounds; tokens come before cost."""
    found = F.array(
        F.when(tokens > policy.max_tokens, TOKEN_LIMIT)
        if policy.max_tokens is not None else F.lit(None).cast("string"),
        F.when(spent > F.lit(str(policy.max_cost_usd)).cast(MONEY), COST_LIMIT)
        if policy.max_cost_usd is not None else F.lit(None).cast("string"),
    )
    return F.array_compact(found)


def evaluate(
    df: DataFrame,
    policy: ThresholdPolicy = DEFAULT_POLICY,
    prices: DataFrame | None = None,
    completion_tokens: str | None = None,
) -> DataFrame:
    """Price rows that carry ``token_count``; add cost, violations, is_allowed.

    ``completion_tokens`` names a column of response tokens to price as well.
    """
    out = with_prices(df, prices)
    out = out.withColumn("estimated_cost_usd", cost(F.col("input_usd"), F.col("token_count")))
    out = out.withColumn(
        "violations", violations(F.col("token_count"), F.col("estimated_cost_usd"), policy)
    ).withColumn("is_allowed", F.size("violations") == 0)
    if completion_tokens is not None:
        out = out.withColumn(
            "completion_cost_usd", cost(F.col("output_usd"), F.col(completion_tokens))
        )
    return out


def assert_no_violations(evaluated: DataFrame) -> None:
    """Raise with counts when any row exceeds a bound; one aggregate."""
    has = lambda name: F.count_if(F.array_contains("violations", name))
    seen = evaluated.agg(has(TOKEN_LIMIT).alias("tokens"), has(COST_LIMIT).alias("cost")).first()
    if seen["tokens"] or seen["cost"]:
        raise ThresholdExceeded(
            f"{seen['tokens']} rows exceed the token limit, {seen['cost']} the cost limit"
        )
