"""Ledger records for tests."""

import datetime as dt
from decimal import Decimal

from promptledger.schemas import LEDGER

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def record(seq, **changes):
    base = {
        "arrival_seq": seq, "request_id": f"id-{seq}", "timestamp": START + dt.timedelta(seconds=seq),
        "provider": "openai", "path": "/v1/chat/completions", "model": "gpt-4o", "verdict": "allowed",
        "rejecting_middleware": None, "reject_reason": None, "reject_status_code": None,
        "token_count": 10, "estimated_cost_usd": Decimal("0.000000150000000000"),
        "mutations_applied": False, "findings": [], "latency_ms": 1.5,
        "upstream_status_code": 200, "upstream_error": None,
    }
    return {**base, **changes}


def rejected(seq, stage="secret_scan", **changes):
    return record(
        seq, verdict="rejected", rejecting_middleware=stage, reject_reason="r",
        reject_status_code=403, token_count=None, estimated_cost_usd=None,
        upstream_status_code=None, **changes,
    )


def finding(scanner="pii_scan", kind="pii_email_address"):
    return {"scanner": scanner, "kind": kind, "label": "L", "severity": "high", "preview": "a***b"}


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[n] for n in LEDGER.names) for r in rows], LEDGER)
