"""Redaction of plain texts and of request bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptledger.functions import bodies
from promptledger.functions import recognisers as pii
from promptledger.operators.detect import with_pii_hits
from promptledger.schemas import SWAPS, empty
from promptledger.session import settle

REWRITE_FAILED = "rewrite_failed"


def redact_texts(
    df: DataFrame,
    text: str = "content",
    entities: Sequence[str] | None = None,
    threshold: float = pii.DEFAULT_THRESHOLD,
    names: DataFrame | None = None,
) -> DataFrame:
    """Replace personal data in a text column; add ``mutations_applied``."""
    hit = with_pii_hits(df, text, "_hits", entities, threshold, names)
    swaps = hit.withColumn("_swaps", pii.hits_to_swaps("_hits"))
    out = swaps.withColumns(
        {
            text: F.when(F.size("_swaps") > 0, pii.apply_swaps(F.col(text), F.col("_swaps")))
            .otherwise(F.col(text)),
            "mutations_applied": F.coalesce(F.size("_swaps") > 0, F.lit(False)),
        }
    ).drop("_hits", "_swaps")
    return settle(out, text, "mutations_applied")


def _placed(df: DataFrame, swaps: str) -> Column:
    """The swaps with their spans, NULL where a stage gives none."""
    given = df.schema[swaps].dataType
    known = given.elementType.names if isinstance(given, T.ArrayType) else []
    span = lambda s, name: s[name] if name in known else F.lit(None)
    full = F.transform(
        swaps,
        lambda s: F.struct(
            s["original"], s["replacement"],
            span(s, "span_start").alias("span_start"), span(s, "span_end").alias("span_end"),
        ),
    )
    return full.cast(SWAPS)


def rewrite_requests(
    df: DataFrame, swaps: str, routes: Sequence[bodies.ProviderRoute] = bodies.ROUTES
) -> DataFrame:
    """Apply swaps inside request bodies and read the prompt again.

    Rows without swaps keep body and content and do not reach Python. Expects
    body, provider, content; sets ``mutations_applied``. A match that spans several
    message parts is cut out of each of them. A body that cannot be
    rewritten becomes NULL, never passes as it is, and sets ``error_code`` where
    there is such a column.
    """
    wanted = F.coalesce(F.size(swaps) > 0, F.lit(False))
    marked = df.withColumn("_wanted", wanted)
    sent = marked.withColumn(
        "_rewritten",
        bodies.rewrite_bodies(routes)(
            F.when(F.col("_wanted"), F.col("body")),
            F.col("provider"),
            F.when(F.col("_wanted"), _placed(df, swaps)).otherwise(empty(SWAPS)),
        ),
    )
    again = bodies.prompt_text("_parsed", "provider", routes)
    failed = F.col("_wanted") & F.col("_rewritten").isNull()
    errors = {}
    if "error_code" in df.columns:
        errors["error_code"] = F.coalesce("error_code", F.when(failed, REWRITE_FAILED))
    return bodies.with_parsed(sent, "_rewritten", "_parsed").withColumns(
        {
            **errors,
            "content": F.when(F.col("_wanted"), again).otherwise(F.col("content")),
            "body": F.when(F.col("_wanted"), F.col("_rewritten")).otherwise(F.col("body")),
            "mutations_applied": F.col("mutations_applied") | F.col("_wanted")
            if "mutations_applied" in df.columns else F.col("_wanted"),
        }
    ).drop("_wanted", "_rewritten", "_parsed")
