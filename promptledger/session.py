"""Session settings, the shared folder, and joins to small tables."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 50_000
BROADCAST_MAX_BYTES = 16 * 1024 * 1024
LOOKUP_SALTS = 64
#: Two to the power of so many bits tell which facts can have a key of a long lookup table.
KEY_BITS = 26


_shipped_to: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the results depend on (UTC, last duplicate JSON key wins) and
    give the Python workers this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """What ``spark-submit --py-files`` does; the archive is only read by the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped_to:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="py-files-")) / package.name), "zip",
        root_dir=package.parent, base_dir=package.name,
    )
    context.addPyFile(archive)
    _shipped_to.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without a setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="promptledger-")
    context.setCheckpointDir(folder)
    return folder


def has_shared_dir(spark: SparkSession) -> bool:
    """Whether ``shared_dir`` has a folder to name."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    return bool(named) or context.master.startswith("local")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written copy."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once, below whatever is done with them later.

    A filter on a computed column is otherwise pushed below the projections and
    there repeats every expression the column came from (JSON parsing, pattern
    matching). As the output of a generator the column stays where it is, while
    filters on the other columns still reach the scan.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names)))).select(*df.columns)


def spread_small_input(df: DataFrame, *key: str) -> DataFrame:
    """Spread a table that sits in fewer files than there are cores.

    One file is read by one task, which would then do all the pattern matching.
    Large inputs have many files and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, *key)


def fits_broadcast(
    dim: DataFrame,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> bool:
    """Measure a lookup table; reads at most ``max_rows + 1`` rows of it."""
    width = F.coalesce(F.length(F.to_json(F.struct("*"))), F.lit(0))
    seen = dim.limit(max_rows + 1).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")
    ).first()
    return seen["n"] <= max_rows and seen["b"] <= max_bytes


def possible_facts(facts: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """The facts whose key has the hash of one of the lookup table's, and few others.

    The hashes of all keys are one set of 2 ** KEY_BITS bits (8 MB), which is broadcast in
    rows of 512 words of 64 bits; the longer the table, the more other facts pass.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(on), 64 - KEY_BITS)
    set_bits = dim.select(hashed.alias("h")).selectExpr("h >> 6 AS word", "shiftleft(1L, CAST(h & 63 AS INT)) AS bits")
    unset = dim.sparkSession.range(1 << (KEY_BITS - 6)).selectExpr("id AS word", "0L AS bits")
    words = set_bits.union(unset).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy(F.shiftright("word", 9).alias("_row")).agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all")
    ).select("_row", F.col("all.bits").alias("_bits"))
    is_set = F.expr("(shiftrightunsigned(_bits[CAST((_hash >> 6) & 511 AS INT)], CAST(_hash & 63 AS INT)) & 1) = 1")
    asked = facts.withColumn("_hash", hashed)
    return asked.join(F.broadcast(rows), (F.shiftright("_hash", 15) == F.col("_row")) & is_set, "left_semi").drop("_hash")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: str,
    spread_by: Column,
    how: str = "left",
    max_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Join facts to a lookup table whose keys may be hot on the fact side.

    A measured small table is broadcast. A larger one is joined on (key, salt):
    the facts of one key spread over ``LOOKUP_SALTS`` tasks and each lookup row
    is repeated once per salt. Where the lookup rows only say which facts stay
    (``left_semi``), they are not repeated: the adaptive join splits the facts of a hot key,
    and only facts that can have a key are shuffled at all.
    """
    if fits_broadcast(dim, max_rows):
        return facts.join(F.broadcast(dim), on, how)
    if how == "left_semi":
        return possible_facts(facts, dim, on).join(dim.hint("merge"), on, how)
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(LOOKUP_SALTS)))
    salted_dim = dim.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOOKUP_SALTS - 1).cast("long")))
    )
    return salted_facts.join(salted_dim, [on, "_salt"], how).drop("_salt")
