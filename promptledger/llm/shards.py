"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a few bits each, their cells are
numbered along a Hilbert curve, the rows sorted by that number and cut into runs
of equal bytes. Neighbours on the curve are close in every column, so a shard
covers a narrow interval of each, and readers skip files by their minima and
maxima. DataFrame functions only.

Numbers are scaled between their minimum and maximum, texts by the place of their
value among all rows, so that frequent values lie on levels of their own; null is level 0. Rows of equal curve number are ordered by id and
checksum. Empty tables give empty results; all rows of a single shard, huge texts
and repeated rows are ordinary cases. Extra columns are kept by ``sharded``; an
earlier column ``shard`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptledger.llm.common import n_bytes, ranged, staged, table, with_prefix
from promptledger.session import lookup_join

N_SHARDS = 24
BITS = 5
ORDER = ["curve", "doc_id", "text_crc32"]


#: The text columns of ``documents`` that readers filter on.
TEXTS = ("source", "lang")


def ranks(docs: DataFrame, column: str) -> DataFrame:
    """(value, rank): each value of a text column and the rows before the middle of its
    own, values being in order. So values get apart as far as they have rows."""
    counted = docs.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    sorted_ = ranged(counted.where("value IS NOT NULL"), "shard-values", "value")
    placed = with_prefix(sorted_, ["value"], {"before": "n"})
    return staged(placed.select("value", (F.col("before") + F.col("n") / 2).alias("rank")), "shard-ranks")


def with_dimensions(docs: DataFrame, ranked: list[DataFrame]) -> DataFrame:
    """(row, dims): every document, packed, with the numbers that place it."""
    values = [F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(TEXTS)]
    size, number = F.log2(n_bytes(F.col("text")) + 1), F.col("doc_id").cast("double")
    out = docs.select(F.struct("*").alias("row"), *values, size.alias("size"), number.alias("number"), F.xxhash64("doc_id").alias("spread"))
    for i, dim in enumerate(ranked):
        named = dim.select(F.col("value").alias(f"v{i}"), F.col("rank").alias(f"r{i}"))
        # A value may have a third of the rows; many values are joined on a salt too.
        out = lookup_join(out, named, f"v{i}", F.col("spread"))
    dims = F.array(*(F.col(f"r{i}").cast("double") for i in range(len(ranked))), F.col("size"), F.col("number"))
    return out.select("row", dims.alias("dims"))


def level(value: Column, low: Column, high: Column, bits: int = BITS) -> Column:
    """Quantise to 0 .. 2**bits - 1; null, or no spread at all, is 0."""
    steps = 1 << bits
    scaled = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * steps)
    return F.least(F.coalesce(scaled, F.lit(0)), F.lit(steps - 1)).cast("int")


def hilbert(levels: Column, n: int, bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve; ``levels`` is an array of ``n`` ints."""
    moves = F.array(
        *(F.struct(F.lit(1 << b).alias("bit"), F.lit(i).alias("axis")) for b in range(bits - 1, 0, -1) for i in range(n))
    )

    def turn(x: Column, move: Column) -> Column:
        bit, axis = move["bit"], move["axis"]
        mine, first, low = F.get(x, axis), F.get(x, F.lit(0)), bit - 1
        swap = first.bitwiseXOR(mine).bitwiseAND(low)
        change = F.when(mine.bitwiseAND(bit) != 0, low).otherwise(swap)
        partner = F.when(mine.bitwiseAND(bit) != 0, F.lit(0)).otherwise(swap)
        return F.transform(
            x,
            lambda v, j: F.when((j == 0) & (axis != 0), v.bitwiseXOR(change))
            .when(j == 0, v.bitwiseXOR(F.when(mine.bitwiseAND(bit) != 0, low).otherwise(F.lit(0))))
            .when(j == axis, v.bitwiseXOR(partner))
            .otherwise(v),
        )

    turned = F.aggregate(moves, levels, turn) if bits > 1 else levels
    gray = F.aggregate(
        turned,
        F.array().cast("array<int>"),
        lambda done, v: F.array_append(done, v.bitwiseXOR(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)))),
    )

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        fold = F.lit(0)
        for b in range(bits - 1, 0, -1):
            fold = fold.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        place = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                one = F.shiftright(F.get(x, F.lit(i)).bitwiseXOR(fold), b).bitwiseAND(F.lit(1))
                place = place * 2 + one
        return place

    return F.get(F.transform(F.array(gray), finish), F.lit(0))


def measured(placed: DataFrame, name: str = "shard-rows") -> DataFrame:
    """(doc_id, size, text_crc32, dims): one narrow row per document, written once."""
    crc = F.crc32(F.col("row.text").cast("binary"))
    size = (n_bytes(F.col("row.text")) + 8).alias("size")
    return staged(placed.select("row.doc_id", size, crc.alias("text_crc32"), "dims"), name)


def bounds(rows: DataFrame, n: int = len(TEXTS) + 2) -> list[tuple[float | None, float | None]]:
    """Minimum and maximum of each dimension: 2 numbers per dimension."""
    got = rows.agg(*(f(F.get("dims", F.lit(i))) for i in range(n) for f in (F.min, F.max))).first()
    return [(got[2 * i], got[2 * i + 1]) for i in range(n)]


def curve(limits: list[tuple[float | None, float | None]], bits: int = BITS) -> Column:
    """The place on the curve of the numbers in column ``dims``."""
    levels = [
        level(F.get("dims", F.lit(i)), F.lit(lo).cast("double"), F.lit(hi).cast("double"), bits)
        for i, (lo, hi) in enumerate(limits)
    ]
    return hilbert(F.array(*levels), len(limits), bits)


def cut_runs(rows: DataFrame, n_shards: int) -> DataFrame:
    """Sort (curve, doc_id, text_crc32, size) rows and cut them into runs of equal bytes."""
    placed = with_prefix(ranged(rows, "shard-sorted", *ORDER), ORDER, {"before": "size"})
    total = float(rows.agg(F.sum("size")).first()[0] or 1)
    shard = F.least(F.floor((F.col("before") + F.col("size") / 2) * n_shards / total), F.lit(n_shards - 1))
    return placed.withColumn("shard", shard.cast("int")).drop("before")


def sharded(docs: DataFrame, n_shards: int = N_SHARDS, bits: int = BITS) -> DataFrame:
    """The documents with their ``shard``.

    The ends of the runs (one key per shard) are found on narrow rows; documents
    are then assigned by comparing their key with the ends, without moving texts.
    """
    placed = with_dimensions(docs, [ranks(docs, c) for c in TEXTS])
    rows = measured(placed)
    limits = bounds(rows)
    keyed = rows.withColumn("curve", curve(limits, bits)).drop("dims")
    key = F.struct(*(F.col(c).cast("long").alias(c) for c in ORDER))
    # One row per shard.
    ends = cut_runs(keyed, n_shards).groupBy("shard").agg(F.max(key).alias("end")).orderBy("shard").collect()
    number = lambda v: F.lit(v).cast("long")
    literal = F.array(
        F.struct(F.lit(n_shards - 1).alias("shard"), F.lit(None).cast("struct<curve:long,doc_id:long,text_crc32:long>").alias("end")),
        *(F.struct(F.lit(e.shard).alias("shard"), F.struct(*(number(v).alias(c) for c, v in zip(ORDER, e.end))).alias("end")) for e in ends),
    )
    own = F.struct(
        curve(limits, bits).alias("curve"), F.col("row.doc_id").cast("long").alias("doc_id"),
        F.crc32(F.col("row.text").cast("binary")).alias("text_crc32"),
    )
    fits = F.filter(literal, lambda e: e["end"] >= F.col("own"))
    shard = F.coalesce(F.get(fits, F.lit(0))["shard"], F.lit(n_shards - 1)).alias("shard")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != "shard"]
    return placed.withColumn("own", own).select("row", shard).select(*kept, "shard")


def write_shards(docs: DataFrame, path: str) -> None:
    """Write ``sharded`` documents, one folder per shard, sorted rows inside the files."""
    docs.repartitionByRange("shard", "source", "lang", "doc_id").sortWithinPartitions(
        "shard", "source", "lang", "doc_id"
    ).write.partitionBy("shard").parquet(path)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = measured(with_dimensions(docs, [ranks(docs, c) for c in TEXTS]))
    runs = cut_runs(rows.withColumn("curve", curve(bounds(rows))).drop("dims"), N_SHARDS)
    # Slots: rows of the same shard in earlier ranges, then the place inside the range.
    counts = runs.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("_part", "shard").orderBy(*ORDER)) - 1
    # One row per range and shard in it: at most ranges + shards rows.
    return (
        runs.withColumn("inside", inside).join(F.broadcast(starts), ["shard", "_part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
        )
    )
