"""The decision chain: ordered checks, the first rejection decides.

A stage is any object with a ``name`` and an ``apply(df)`` that adds two
columns: ``<name>``, its annotation struct (NULL where it did not run), and
``<name>_reject``, a reject struct or NULL. It reads the prompt from
``open_content``, which is NULL once an earlier stage rejected the row. A stage
that rewrites the request also adds ``<name>_swaps``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions import bodies
from promptledger.functions import recognisers as pii
from promptledger.functions.findings import secret_findings
from promptledger.functions.rules import CATALOGUE, SecretRule
from promptledger.functions.tokens import TokenCounter
from promptledger.operators import pricing
from promptledger.operators.detect import with_pii_hits
from promptledger.operators.redact import rewrite_requests
from promptledger.schemas import FINDINGS, REJECT, nothing
from promptledger.session import settle

BLOCK = "block"
REDACT = "redact"


class Stage(Protocol):
    name: str

    def apply(self, df: DataFrame) -> DataFrame: ...


def reject(status: int, reason: str, detail: Column) -> Column:
    return F.struct(
        F.lit(status).alias("status_code"), F.lit(reason).alias("reason"), detail.alias("detail")
    ).cast(REJECT)


def _exposure(found: Column, reason: str, what: str) -> Column:
    detail = F.concat(
        F.lit("Prompt contains "), F.size(found).cast("string"),
        F.lit(f" {what} value(s); refusing to forward."),
    )
    return F.when(F.size(found) > 0, reject(403, reason, detail))


def _scan_note(found: Column, policy: Column) -> Column:
    """Count always; findings and policy only when there are findings."""
    some = F.size(found) > 0
    return F.when(
        found.isNotNull(),
        F.struct(
            F.size(found).alias("finding_count"),
            F.when(some, found).cast(FINDINGS).alias("findings"),
            F.when(some, policy).cast("string").alias("policy"),
        ),
    )


@dataclass(frozen=True)
class SecretStage:
    """Any secret rejects with 403."""

    rules: Sequence[SecretRule] = CATALOGUE
    name: str = "secret_scan"

    def apply(self, df: DataFrame) -> DataFrame:
        found = df.withColumn("_found", secret_findings("open_content", self.rules))
        return found.withColumns(
            {
                self.name: _scan_note(F.col("_found"), F.lit(None)),
                f"{self.name}_reject": _exposure(
                    F.col("_found"), "secret_exposure_detected", "secret"
                ),
            }
        ).drop("_found")


@dataclass(frozen=True)
class PiiStage:
    """Personal data rejects with 403, or is replaced in the request."""

    policy: str = BLOCK
    entities: Sequence[str] | None = None
    threshold: float = pii.DEFAULT_THRESHOLD
    names: DataFrame | None = None
    recognisers: Sequence[pii.Recogniser] | None = None
    name: str = "pii_scan"

    def __post_init__(self):
        if self.policy not in (BLOCK, REDACT):
            raise ValueError(f"unknown policy: {self.policy}")
        pii.check_threshold(self.threshold)

    def apply(self, df: DataFrame) -> DataFrame:
        hit = with_pii_hits(
            df, "open_content", "_hits",
            self.entities, self.threshold, self.names, self.recognisers,
        )
        found = hit.withColumn("_found", pii.hits_to_findings("_hits"))
        redacts = self.policy == REDACT
        columns = {
            self.name: _scan_note(F.col("_found"), F.lit(REDACT if redacts else None)),
            f"{self.name}_reject": nothing(REJECT)
            if redacts else _exposure(F.col("_found"), "pii_exposure_detected", "PII"),
        }
        if redacts:
            columns[f"{self.name}_swaps"] = pii.hits_to_swaps("_hits")
        return found.withColumns(columns).drop("_hits", "_found")


@dataclass(frozen=True)
class TokenStage:
    """Too many tokens or too dear a prompt rejects with 413.

    Tokens come from ``counter``, or from the column ``token_column`` when the
    counts are known. A model without a name cannot be priced: the row becomes
    an error row (status 500) that leaves no audit record.
    """

    counter: TokenCounter | None = None
    policy: pricing.ThresholdPolicy = pricing.DEFAULT_POLICY
    prices: DataFrame | None = None
    token_column: str | None = None
    name: str = "tokenomics"

    def __post_init__(self):
        if (self.counter is None) == (self.token_column is None):
            raise ValueError("give a counter or a token column")

    def apply(self, df: DataFrame) -> DataFrame:
        out = pricing.with_prices(df, self.prices)
        runs = F.col("open_content").isNotNull() & F.col("pricing_error").isNull()
        if self.counter is not None:
            tokens = self.counter.count(F.when(runs, F.col("open_content")), F.col("encoding_used"))
            used = self.counter.resolve(F.col("encoding_used"))
        else:
            tokens, used = F.when(runs, F.col(self.token_column)), F.col("encoding_used")
        out = out.withColumn("_tokens", tokens.cast("int"))
        out = out.withColumn("_cost", pricing.cost(F.col("input_usd"), F.col("_tokens")))
        out = out.withColumn(
            "_violations",
            F.when(runs, pricing.violations(F.col("_tokens"), F.col("_cost"), self.policy)),
        )
        violated = F.size("_violations") > 0
        detail = F.concat(
            F.lit("Prompt violates configured token or cost threshold: "),
            F.array_join("_violations", ", "),
        )
        out = out.withColumns(
            {
                self.name: F.when(
                    runs,
                    F.struct(
                        F.col("_tokens").alias("token_count"),
                        F.col("_cost").alias("estimated_cost_usd"),
                        used.alias("encoding_used"),
                        F.col("fallback_applied").alias("fallback_applied"),
                        F.when(violated, F.col("_violations")).alias("violations"),
                    ),
                ),
                f"{self.name}_reject": F.when(
                    violated, reject(413, "tokenomics_policy_violation", detail)
                ),
                "error_code": F.coalesce(
                    "error_code", F.when(F.col("open_content").isNotNull(), F.col("pricing_error"))
                ),
            }
        )
        return out.drop(
            "_tokens", "_cost", "_violations", "input_usd", "output_usd",
            "encoding_used", "fallback_applied", "pricing_error",
        )


@dataclass(frozen=True)
class Chain:
    """Stages in order. An empty chain accepts everything."""

    stages: Sequence[Stage] = field(default_factory=tuple)
    routes: Sequence[bodies.ProviderRoute] = bodies.ROUTES

    def __post_init__(self):
        names = [s.name for s in self.stages]
        if len(set(names)) != len(names):
            raise ValueError(f"stage names must differ: {names}")

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.stages]

    def decide(self, normalised: DataFrame) -> DataFrame:
        """Add reject, rejecting_middleware, mutations_applied, verdict and notes.

        Works on normalised requests; rows with an error pass through with NULL
        verdict.
        """
        df = normalised
        if "error_code" not in df.columns:
            df = df.withColumn("error_code", nothing("string"))
        df = df.withColumns(
            {
                "reject": nothing(REJECT),
                "rejecting_middleware": nothing("string"),
                "mutations_applied": F.lit(False),
            }
        )
        for stage in self.stages:
            df = self._run(stage, df)
        verdict = F.when(F.col("reject").isNotNull(), "rejected").otherwise("allowed")
        df = df.withColumn("verdict", F.when(F.col("error_code").isNull(), verdict))
        computed = ["reject", "rejecting_middleware", "mutations_applied", "verdict", "error_code"]
        rewritten = [c for c in ("content", "body") if c in df.columns]
        return settle(df, *computed, *rewritten, *self.names)

    def _run(self, stage: Stage, df: DataFrame) -> DataFrame:
        is_open = F.col("reject").isNull() & F.col("error_code").isNull()
        df = stage.apply(df.withColumn("open_content", F.when(is_open, F.col("content"))))
        rejected, swaps = f"{stage.name}_reject", f"{stage.name}_swaps"
        missing = {stage.name, rejected} - set(df.columns)
        if missing:
            raise ValueError(f"stage {stage.name} did not add {sorted(missing)}")
        df = df.withColumns(
            {
                "rejecting_middleware": F.coalesce(
                    "rejecting_middleware",
                    F.when(F.col(rejected).isNotNull(), F.lit(stage.name)),
                ),
                "reject": F.coalesce("reject", rejected),
            }
        )
        if swaps in df.columns:
            df = rewrite_requests(df, swaps, self.routes)
        return df.drop("open_content", rejected, swaps)


def live_chain(
    counter: TokenCounter | None,
    pii_policy: str | None = None,
    policy: pricing.ThresholdPolicy = pricing.DEFAULT_POLICY,
    prices: DataFrame | None = None,
    names: DataFrame | None = None,
    token_column: str | None = None,
) -> Chain:
    """Secrets, personal data when a policy is given, then tokens."""
    stages: list[Stage] = [SecretStage()]
    if pii_policy is not None:
        stages.append(PiiStage(pii_policy, names=names))
    stages.append(TokenStage(counter, policy, prices, token_column))
    return Chain(stages)


def batch_chain(
    pii_scan: bool = False,
    tokens: bool = False,
    counter: TokenCounter | None = None,
    policy: pricing.ThresholdPolicy = pricing.BATCH_POLICY,
    prices: DataFrame | None = None,
    token_column: str | None = None,
) -> Chain:
    """Secrets always; personal data (blocking) and tokens by flag."""
    stages: list[Stage] = [SecretStage()]
    if pii_scan:
        stages.append(PiiStage(BLOCK))
    if tokens:
        stages.append(TokenStage(counter, policy, prices, token_column))
    return Chain(stages)
