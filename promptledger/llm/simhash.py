"""Near-duplicates by SimHash, compared exactly in tiles.

A fingerprint bit is 1 if more than half of the text's shingle hashes have it.
Equal fingerprints are one from the start, so groups of copies cost one row. The
distinct fingerprints are sorted into tiles by the population counts of their
halves and then of their bytes. Two fingerprints within the radius differ by
at most the radius in those counts, so tiles (and, inside a task, slices of
tiles) farther apart than that are skipped; all others are compared in full with
numpy's exclusive-or and bit counts. From each tile pair come the links of a
spanning forest only, which keep the components whole. Components are found by
alternating large-star and small-star rounds over written tables.

Null and empty texts, and texts of blanks, have fingerprint 0 and link like any
other. Texts with fewer words than a shingle are one shingle. Rows with a null id
get a fingerprint but take no part in components. Equal rows stay rows. Extra
columns are ignored here and kept by ``deduplicated``. Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm.common import staged, table

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 16_384
SLICE = 256


def shingle_hashes(text: str | None, size: int = SHINGLE, words: int = 1) -> np.ndarray:
    """One row of ``words`` 64-bit words per shingle of lower-cased (A-Z) words; the
    whole sequence if shorter. One word is XXH64 with seed 42, two are XXH3-128."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros((0, words), np.uint64)
    joined = b" ".join(parts)
    size = min(size, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[:-size].tolist()]
    spans = zip(starts, (ends[size - 1 :] - 1).tolist())
    if words == 1:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts)).reshape(-1, 1)
    wide = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(wide(joined[a:b], SEED) for a, b in spans), np.uint64).reshape(-1, 2)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Words with the bits set in over half of the hashes, counted in bounded slices."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 16_384):
        part = np.ascontiguousarray(hashes[i : i + 16_384]).view(np.uint8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text", size: int = SHINGLE, words: int = 1) -> DataFrame:
    """(doc_id, fp, low, high): the fingerprint of every whole text as big-endian
    bytes, and the population counts of its halves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.stack([fingerprint(shingle_hashes(t, size, words)) for t in batch["text"]]) if len(batch) else np.zeros((0, words), np.uint64)
            big = fps.astype(">u8")
            counts = np.bitwise_count(fps.view(np.uint32)).reshape(len(batch), 2, words).sum(axis=2)
            # On a little-endian machine the first half of a word is its low half.
            low, high = (counts[:, 0], counts[:, 1])
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "fp": [r.tobytes() for r in big], "low": low.astype("int32"), "high": high.astype("int32")}
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInPandas(run, "doc_id long, fp binary, low int, high int")


def _words(fps) -> np.ndarray:
    """Fingerprints from a list of their bytes, as rows of words."""
    wide = len(fps[0]) // 8
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, wide)


def _byte_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8))


def cell_width(radius: int) -> int:
    return max(1, -(-radius // 3))


def tiles(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(low, high, tile, ids, fps): sorted fingerprints of one cell of half counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Input is sorted by (low, high): one cell is open at a time.
        key, held, seq = None, [], 0
        for batch in batches:
            for cell, rows in batch.groupby(["low", "high"], sort=False):
                if cell != key:
                    if held:
                        yield _tile(key, pd.concat(held), (seq := seq + 1))
                    key, held = cell, []
                held.append(rows)
                while sum(map(len, held)) >= tile:
                    flat = pd.concat(held)
                    yield _tile(key, flat.iloc[:tile], (seq := seq + 1))
                    held = [flat.iloc[tile:]] if len(flat) > tile else []
        if held:
            yield _tile(key, pd.concat(held), (seq := seq + 1))

    width = cell_width(radius)
    cell = lambda c: F.floor(F.col(c) / width).cast("int").alias(c)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        distinct.select("fp", "first", cell("low"), cell("high"))
        .repartitionByRange(parts, "low", "high", "fp").sortWithinPartitions("low", "high")
        .mapInPandas(run, "low int, high int, seq long, ids binary, fps binary")
        .withColumn("tile", F.struct(F.spark_partition_id().alias("part"), "seq")).drop("seq")
    )


def _tile(cell: tuple[int, int], rows: pd.DataFrame, seq: int) -> pd.DataFrame:
    fps, ids = _words(list(rows["fp"])), rows["first"].to_numpy(np.int64)
    order = np.lexsort(_byte_counts(fps).T[::-1])
    return pd.DataFrame(
        {"low": [cell[0]], "high": [cell[1]], "seq": [seq], "ids": [ids[order].tobytes()], "fps": [fps[order].tobytes()]}
    ).astype({"low": "int32", "high": "int32"})


class Forest:
    """Union-find over local numbers, with labels as an array for whole-array tests."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = {}

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Add links; returns those that joined two trees."""
        kept = []
        fresh = self.label[a] != self.label[b]
        while fresh.any():
            a, b = a[fresh], b[fresh]
            for x, y in zip(a[:64].tolist(), b[:64].tolist()):
                p, q = int(self.label[x]), int(self.label[y])
                if p == q:
                    continue
                mine, other = self.members.pop(p, None), self.members.pop(q, None)
                mine, other = mine if mine is not None else np.array([p]), other if other is not None else np.array([q])
                if len(mine) < len(other):
                    mine, other, p = other, mine, q
                self.label[other] = p
                self.members[p] = np.concatenate([mine, other])
                kept.append((x, y))
            fresh = self.label[a] != self.label[b]
        return kept


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a tile, or of it and another (``b``):
    pairs of row numbers, those of ``b`` following those of ``a``."""
    same = b is None
    right, offset = (a, 0) if same else (b, len(a))
    forest, links = Forest(len(a) + (0 if same else len(b))), []
    cut = lambda v: [np.arange(i, min(i + SLICE, len(v))) for i in range(0, len(v), SLICE)]
    rows, cols = cut(a), cut(right)

    def span(v, parts):
        counts = _byte_counts(v).astype(np.int16)
        return (np.stack([f(counts[p], axis=0) for p in parts]) for f in (np.min, np.max))

    (lo_a, hi_a), (lo_b, hi_b) = span(a, rows), span(right, cols)
    for i, p in enumerate(rows):
        gap = np.maximum(0, np.maximum(lo_a[i] - hi_b, lo_b - hi_a[i])).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            q = cols[j]
            bits = sum(np.bitwise_count(a[p, w][:, None] ^ right[q, w][None, :]) for w in range(a.shape[1]))
            near = bits <= radius
            if same and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                links += forest.join(p[x], offset + q[y])
    return links


def links_of(tiled: DataFrame, radius: int, words: int) -> DataFrame:
    """(a, b): links between documents that keep the components whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda v: np.frombuffer(v, np.uint64).reshape(-1, words)
        for batch in batches:
            for mine, ids, other, other_ids in zip(batch["fps"], batch["ids"], batch["other"], batch["other_ids"]):
                names = np.frombuffer(ids, np.int64)
                if other is not None:
                    names = np.concatenate([names, np.frombuffer(other_ids, np.int64)])
                found = tile_links(read(mine), None if other is None else read(other), radius)
                yield pd.DataFrame(names[np.array(found, np.int64).reshape(-1, 2)], columns=["a", "b"])

    width = cell_width(radius)
    apart = lambda d: (abs(d) - 1) * width + 1 if d else 0
    reach = range(-radius, radius + 1)
    steps = [(x, y) for x in reach for y in reach if apart(x) + apart(y) <= radius]
    near = F.array(*(F.struct((F.col("low") + x).alias("low"), (F.col("high") + y).alias("high")) for x, y in steps))
    left = tiled.select(F.explode(near).alias("at"), "tile", "ids", "fps")
    right = tiled.select(
        F.struct("low", "high").alias("at"), F.col("tile").alias("other_tile"),
        F.col("ids").alias("other_ids"), F.col("fps").alias("other"),
    )
    # Each pair of tiles is found from both sides and compared from one.
    pairs = left.join(right, "at").where(F.col("tile") <= F.col("other_tile"))
    two = F.col("tile") != F.col("other_tile")
    return pairs.select(
        "fps", "ids", F.when(two, F.col("other")).alias("other"), F.when(two, F.col("other_ids")).alias("other_ids")
    ).mapInPandas(run, "a long, b long")


def fingerprint_links(firsts: DataFrame, radius: int = RADIUS, words: int = 1) -> DataFrame:
    """(a, b): links between the rows (fp, first, low, high) of near fingerprints that keep
    the components whole."""
    return links_of(staged(tiles(firsts, radius), "simhash-tiles"), radius, words)


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (u, v) is either in one edge as u, or in some as v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    per_node = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return per_node.where((F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("centre") > 0))).count() == 0


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every linked node; the root is the component's smallest number.

    Large-star links each node's larger neighbours to its smallest one, small-star
    its smaller ones; both keep the components and end in stars. Neighbours are
    only ever aggregated to a minimum, so no node's list is gathered. Links that are
    stars already, with the smallest number in the centre, take no round.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    for _ in range(most_rounds):
        if _all_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the joins read both sides afresh and hot nodes can be split.
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
        large = staged(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links-large"
        )
        smallest = staged(large.groupBy("u").agg(F.min("v").alias("m")), "links-smallest")
        joined = large.join(smallest, "u")
        edges = staged(
            joined.select("u", F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u <> v").distinct(),
            "links",
        )
    raise RuntimeError("components did not settle")


def component_ids(fps: DataFrame, radius: int = RADIUS, words: int = 1) -> DataFrame:
    """(doc_id, fp, component_id) from ``fingerprints``."""
    fps = staged(fps, "simhash-fps")
    firsts = fps.where("doc_id IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").alias("first"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    roots = components(fingerprint_links(firsts, radius, words))
    classes = staged(
        firsts.join(roots, firsts["first"] == roots["node"], "left")
        .select("fp", F.coalesce("root", "first").alias("component_id")),
        "simhash-classes",
    )
    named = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", named.alias("component_id"))


def deduplicated(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """The documents with one of each near-duplicate group (see ``near``): its smallest id.

    Rows with a null id stay. Rows of one id are one document, which stays if any
    of its texts does.
    """
    from promptledger.llm import near  # it builds on this module

    ids = near.groups(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    gone = ids.groupBy("doc_id").agg(F.max("component_id").alias("c")).where("c < doc_id").select("doc_id")
    packed = docs.select(F.col(doc_id).alias("doc_id"), F.struct("*").alias("row"))
    return near.with_ids(packed, staged(gone, "near-gone"), "left_anti").select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = component_ids(fingerprints(table(spark, sf_dir, "documents")))
    return ids.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
