"""Column types shared by the operators."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(38,18)"

FINDING = (
    "struct<kind:string,label:string,severity:string,"
    "span_start:int,span_end:int,preview:string>"
)
FINDINGS = f"array<{FINDING}>"
LEDGER_FINDING = (
    "struct<scanner:string,kind:string,label:string,severity:string,preview:string>"
)
LEDGER_FINDINGS = f"array<{LEDGER_FINDING}>"
REJECT = "struct<status_code:int,reason:string,detail:string>"
#: Spans are places in the joined prompt; a swap without one is made wherever its text stands.
SWAPS = "array<struct<original:string,replacement:string,span_start:int,span_end:int>>"

_STRING, _LONG, _INT, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def table(**columns: T.DataType) -> T.StructType:
    """A schema of nullable columns, in order."""
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


REQUEST = table(
    arrival_seq=_LONG, arrival_ts=_TS, path=_STRING,
    headers=T.MapType(_STRING, _STRING), body=_STRING,
)
PROMPT_FILE = table(label=_STRING, position=_LONG, body=_STRING)

# The sixteen audit columns, after the arrival number that orders them.
LEDGER = table(
    arrival_seq=_LONG,
    request_id=_STRING,
    timestamp=_TS,
    provider=_STRING,
    path=_STRING,
    model=_STRING,
    verdict=_STRING,
    rejecting_middleware=_STRING,
    reject_reason=_STRING,
    reject_status_code=_INT,
    token_count=_INT,
    estimated_cost_usd=T.DecimalType(38, 18),
    mutations_applied=T.BooleanType(),
    findings=T.ArrayType(
        table(scanner=_STRING, kind=_STRING, label=_STRING, severity=_STRING, preview=_STRING)
    ),
    latency_ms=T.DoubleType(),
    upstream_status_code=_INT,
    upstream_error=_STRING,
)
OUTAGE_STATE = table(
    provider=_STRING, after_seq=_LONG, failures=_LONG, opened_seq=_LONG, opened_ts=_TS
)
CATEGORY_COUNTS = table(
    by=_STRING, category=_STRING, n=_LONG, first_place=table(arrival_seq=_LONG, finding_no=_INT)
)
AUDIT_COLUMNS = [f.name for f in LEDGER.fields if f.name != "arrival_seq"]


def nothing(ddl):
    """A typed NULL."""
    return F.lit(None).cast(ddl)


def empty(ddl):
    """A typed empty array."""
    return F.array().cast(ddl)
