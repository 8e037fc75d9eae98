"""Requests to prompts: one pass that marks, but never drops, bad rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions import bodies
from promptledger.functions.identity import REQUEST_ID_HEADER, header, request_id
from promptledger.session import settle

UNKNOWN_PROVIDER = "unknown_provider"
DEAD_LETTER_COLUMNS = (
    "arrival_seq", "request_id", "path", "error_code", "error_status", "error", "error_detail",
)


def _with_prompt(
    df: DataFrame, provider: Column, routes: Sequence[bodies.ProviderRoute], *added: str
) -> DataFrame:
    """Add model and content to rows without an error, and drop the parsed body."""
    good = F.col("error_code").isNull()
    parsed = F.col("_parsed")
    out = df.withColumn("_layout", F.when(good, provider)).withColumns(
        {
            "provider": F.when(good, provider),
            "model": F.when(good, bodies.text_or_null(bodies.field(parsed, "model"))),
            "content": F.when(good, bodies.prompt_text("_parsed", "_layout", routes)),
        }
    ).drop("_parsed", "_layout")
    return settle(out, "provider", "model", "content", "error_code", "error_detail", *added)


def normalise(
    requests: DataFrame,
    routes: Sequence[bodies.ProviderRoute] = bodies.ROUTES,
    source: str = "live",
) -> DataFrame:
    """Resolve the route, check the body, flatten the prompt, give an id.

    Expects arrival_seq, path, headers, body. Adds request_id, provider, model,
    content and the error columns, which are NULL for a good row: an unknown
    path is status 404, a malformed body 400.
    """
    route = bodies.provider_of_path(F.col("path"), routes)
    df = bodies.with_parsed(requests, "body", "_parsed").withColumns(
        {"_route": route, "_given_id": header(F.col("headers"), REQUEST_ID_HEADER)}
    )
    df = df.withColumn(
        "error_code",
        F.when(F.col("_route").isNull(), UNKNOWN_PROVIDER).otherwise(
            bodies.body_error(F.col("body"), F.col("_parsed"), F.col("_route"), routes)
        ),
    )
    df = df.withColumns(
        {
            "request_id": request_id(F.col("_given_id"), F.lit(source), F.col("arrival_seq")),
            "error_status": F.when(F.col("error_code") == UNKNOWN_PROVIDER, 404).when(
                F.col("error_code").isNotNull(), 400
            ),
            "error": F.when(F.col("error_code") == UNKNOWN_PROVIDER, UNKNOWN_PROVIDER).when(
                F.col("error_code").isNotNull(), "malformed_request"
            ),
            "error_detail": F.when(
                F.col("error_code") == UNKNOWN_PROVIDER,
                F.concat(
                    F.lit("No provider adapter registered for path '"), F.col("path"), F.lit("'.")
                ),
            ).otherwise(bodies.error_text(F.col("error_code"))),
        }
    )
    out = _with_prompt(df, F.col("_route"), routes, "request_id", "error_status", "error")
    return out.drop("_route", "_given_id")


def normalise_files(files: DataFrame) -> DataFrame:
    """The batch form: the body itself tells the provider, every error is an input error.

    Expects label, position, body. The arrival number is a hash of the label.
    """
    df = bodies.with_parsed(files, "body", "_parsed").withColumns(
        {"arrival_seq": F.xxhash64("label"), "path": F.lit("cli:scan")}
    )
    df = df.withColumn("error_code", bodies.body_error(F.col("body"), F.col("_parsed")))
    df = df.withColumn("error_detail", bodies.error_text(F.col("error_code")))
    df = df.withColumn("_provider", bodies.detect_provider(F.col("_parsed")))
    return _with_prompt(df, F.col("_provider"), bodies.ROUTES).drop("_provider")


def accepted(normalised: DataFrame) -> DataFrame:
    """Rows the chain decides."""
    return normalised.where(F.col("error_code").isNull())


def dead_letters(normalised: DataFrame) -> DataFrame:
    """Rows that get a 404 or 400 answer and no audit record."""
    return normalised.where(F.col("error_code").isNotNull()).select(*DEAD_LETTER_COLUMNS)
