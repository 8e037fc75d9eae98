"""Benchmark decontamination by SimHash over item-sized windows.

Items and documents become word sequences (lower case, letters and digits) and
shingles of five words. A document's windows have the size of an item, or are
the whole document if that is shorter. A window can only reach the similarity
asked for if so many of its shingles are known from the benchmark; such windows,
starting at a known shingle or ending the document, are fingerprinted with 128
bits over their known shingles (a window that starts at an unknown shingle is
never better than its right neighbour). The fingerprints are cut into 8 blocks of
16 bits: two within radius 31 differ in at most 3 bits in some block, so looking
up all block values within 3 bits finds every pair within the radius. Those pairs
are verified by the exact weighted similarity: shingles weigh as often as they
occur, shared weight over united weight, unknown shingles included.

DataFrame functions only. Null and empty texts have no shingle. Items of fewer
than five words have none either and match nothing. Repeated rows and rows with
null ids are judged like others; a result row stands for (id, text). Extra columns
are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm.common import staged, table
from promptledger.session import fits_broadcast

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Most distinct benchmark shingles that are sent to every executor (8 bytes each).
BROADCAST_SHINGLES = 1_000_000
#: Documents to leave out that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_LEAKS = 1_000_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all word shingles, in order; null if there is none."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    hashes = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))

    def join(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - size)
        return F.when(F.size(h) >= size, F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size)))))

    return let(hashes, join)


def numbered(hashes: Column) -> Column:
    """A multiset as a set: equal values get numbers of their own."""
    ordered = F.array_sort(hashes)
    return let(ordered, lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x))))


def fingerprinted(rows: DataFrame, *key: str) -> DataFrame:
    """(key, f0, f1): SimHash of the array ``hs``, 64 bits from each hash of a shingle.

    Two counters share a long: bit k of the hash is counted in its low half, bit
    k + 32 in its high half. The bits are told by one expression over all counters, which
    stays small in the plan that the driver holds.
    """
    lanes = F.lit((1 << 32) + 1)
    exploded = rows.select(*key, F.explode("hs").alias("h")).withColumn("h1", F.xxhash64(F.lit(1), "h"))
    sums = [
        F.sum(F.shiftright(c, k).bitwiseAND(lanes)).alias(f"{c}_{k}") for c in ("h", "h1") for k in range(32)
    ]
    counted = exploded.groupBy(*key).agg(F.count("*").alias("n"), *sums)

    def halves(both: Column) -> Column:
        return F.array(both.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(both, 32))

    def bit(count: Column, i: Column) -> Column:
        k = F.shiftright(i, 1) + i.bitwiseAND(F.lit(1)) * 32
        one = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        return F.when(count * 2 > F.col("n"), one).otherwise(F.lit(0).cast("long"))

    def bits(c: str) -> Column:
        counts = F.flatten(F.transform(F.array(*(f"{c}_{k}" for k in range(32))), halves))
        return F.aggregate(F.transform(counts, bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return counted.select(*key, bits("h").alias("f0"), bits("h1").alias("f1"))


def blocks() -> Column:
    """(block number, value) of the 8 blocks of (f0, f1)."""
    parts = [(f, s) for f in ("f0", "f1") for s in range(0, 64, BLOCK_BITS)]
    value = lambda f, s: F.shiftrightunsigned(F.col(f), s).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    return F.array(*(F.struct(F.lit(i).alias("block"), value(f, s).alias("value")) for i, (f, s) in enumerate(parts)))


def near_values() -> Column:
    """All masks of at most BLOCK_RADIUS bits of a block: 697."""
    masks = [sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)]
    return F.array(*map(F.lit, masks))


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    rows = benchmark.select(F.col(item_id).alias("item_id"), shingles(F.col(text)).alias("hs")).where("hs IS NOT NULL")
    return staged(rows.select("item_id", "hs", F.size("hs").alias("m"), numbered(F.col("hs")).alias("set")), "items")


def _windows(known: DataFrame, sizes: list[int], similarity: float) -> DataFrame:
    """(doc_id, text_key, start, m, hs): windows that may reach the similarity.

    ``known`` has a document's known shingles as ``at``: sorted (pos, h).
    """
    share = similarity / (1 + similarity)
    wanted = F.array(*(F.lit(m) for m in sizes)).cast("array<int>")
    placed = known.select("*", F.explode(wanted).alias("item_m")).where(F.col("m_doc") >= F.col("item_m") * similarity)
    placed = placed.withColumn("m", F.least("item_m", "m_doc")).withColumn(
        "need", F.ceil((F.col("item_m") + F.col("m")) * share - 1e-9).cast("int")
    ).where(F.size("at") >= F.col("need"))
    at, m, need, tail = F.col("at"), F.col("m"), F.col("need"), F.col("m_doc") - F.col("m")
    full = F.filter(
        at,
        lambda p, i: (p["pos"] <= tail) & (F.get(at, i + need - 1)["pos"] < p["pos"] + m),
    )
    starts = F.array_union(F.transform(full, lambda p: p["pos"]), F.array(tail))
    cut = placed.select("doc_id", "text_key", "m", "need", "at", F.explode(starts).alias("start"))
    inside = F.filter(F.col("at"), lambda p: (p["pos"] >= F.col("start")) & (p["pos"] < F.col("start") + F.col("m")))
    out = cut.select("doc_id", "text_key", "start", "m", "need", F.transform(inside, lambda p: p["h"]).alias("hs"))
    return out.where(F.size("hs") >= F.col("need")).drop("need")


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id",
    item_text="text", similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, text_key, item_id, similarity, word_start, n_words): for every document
    and item it holds, the most similar window (the first of equals)."""
    items = _items(benchmark, item_id, item_text)
    # One number per distinct item length.
    sizes = [r.m for r in items.select("m").distinct().orderBy("m").collect()]
    vocabulary = items.select(F.explode("hs").alias("h")).distinct()
    if fits_broadcast(vocabulary, BROADCAST_SHINGLES, 16 * BROADCAST_SHINGLES):
        vocabulary = F.broadcast(vocabulary)
    spread = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), shingles(F.col(text)).alias("hs")
    ).select("doc_id", "text_key", F.size("hs").alias("m_doc"), F.posexplode("hs").alias("pos", "h"))
    hits = spread.join(vocabulary, "h").distinct()
    known = hits.groupBy("doc_id", "text_key", "m_doc").agg(
        F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("at")
    )
    windows = staged(
        _windows(known, sizes, similarity).withColumn(
            "window", F.struct(F.xxhash64("hs").alias("a"), F.xxhash64(F.lit(1), F.reverse("hs")).alias("b"), "m")
        ),
        "windows",
    )
    distinct = staged(windows.groupBy("window").agg(F.first("hs").alias("hs")), "windows-distinct")
    # Fingerprints and pairs are written: each plan is made on its own and then dropped, where one
    # plan of all would be held, and made anew, at every stage.
    asked = staged(fingerprinted(distinct, "window"), "window-prints")
    block = lambda b: [b["block"].alias("block"), b["value"].alias("value")]
    asked = asked.select("*", F.explode(blocks()).alias("b")).select("window", "f0", "f1", *block(F.col("b")))
    prints = items.select("item_id", "hs").dropDuplicates(["item_id", "hs"]).withColumn("text_key", F.xxhash64("hs"))
    prints = staged(fingerprinted(prints, "item_id", "text_key"), "item-prints")
    held = (
        prints.select("item_id", "text_key", F.col("f0").alias("i0"), F.col("f1").alias("i1"), F.explode(blocks()).alias("b"))
        .select("*", F.explode(near_values()).alias("mask"))
        .select("item_id", "text_key", "i0", "i1", F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("mask")).alias("value"))
    )
    apart = F.bit_count(F.col("f0").bitwiseXOR(F.col("i0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("i1")))
    pairs = staged(
        asked.join(held.hint("merge"), ["block", "value"]).where(apart <= RADIUS).select(
            "window", "item_id", F.col("text_key").alias("item_key")
        ).distinct(),
        "window-pairs",
    )
    sets = items.select("item_id", F.xxhash64("hs").alias("item_key"), F.col("m").alias("item_m"), "set").dropDuplicates(["item_id", "item_key"])
    shared = F.size(F.array_intersect(numbered(F.col("hs")), "set"))
    weighed = (
        pairs.join(distinct, "window").join(sets, (pairs["item_id"].eqNullSafe(sets["item_id"])) & (pairs["item_key"] == sets["item_key"]))
        .select("window", pairs["item_id"], "item_m", shared.alias("shared"))
        .withColumn("similarity", F.col("shared") / (F.col("item_m") + F.col("window.m") - F.col("shared")))
        .where(F.col("similarity") >= similarity)
    )
    found = windows.drop("hs").join(weighed, "window")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "m")).alias("best")
    return found.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", "best.similarity", (-F.col("best.start")).alias("word_start"),
        (F.col("best.m") + SHINGLE - 1).alias("n_words"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", **options) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = leaks(docs, benchmark, doc_id, text, **options)
    gone = staged(found.select(F.struct("doc_id", "text_key").alias("gone")).distinct(), "leaks")
    own = F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"))
    packed = docs.select(own.alias("own"), F.struct("*").alias("row"))
    # Few enough documents to leave out are broadcast, so that texts stay where they are.
    listed = F.broadcast(gone) if gone.count() <= BROADCAST_LEAKS else gone
    return packed.join(listed, F.col("own") == F.col("gone"), "left_anti").select("row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
