"""Request ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F

REQUEST_ID_HEADER = "x-request-id"


def header(headers: Column, name: str) -> Column:
    """A header by name, whatever the case of its key."""
    same = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(same, F.lit(0))["value"]


def _hyphenated(digits: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substr(digits, F.lit(a), F.lit(n)) for a, n in cuts])


def canonical_uuid(text: Column) -> Column:
    """The lower-case hyphenated form of any accepted spelling, else NULL."""
    bare = F.replace(F.replace(text, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    digits = F.lower(F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit("")))
    return F.when(digits.rlike("^[0-9a-f]{32}$"), _hyphenated(digits))


def derived_uuid(*parts: Column) -> Column:
    """An id computed from the row, so a task that runs again repeats it."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    digits = F.concat(
        F.substr(digest, F.lit(1), F.lit(12)), F.lit("4"),
        F.substr(digest, F.lit(14), F.lit(3)), F.lit("8"),
        F.substr(digest, F.lit(18), F.lit(15)),
    )
    return _hyphenated(digits)


def request_id(given: Column, *parts: Column) -> Column:
    """The caller's id when it is a valid UUID, otherwise one derived from ``parts``."""
    return F.coalesce(canonical_uuid(given), derived_uuid(*parts))
