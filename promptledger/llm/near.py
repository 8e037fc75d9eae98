"""Near-duplicates by the exact similarity (Jaccard) of their shingle sets.

Two texts are linked if their sets of five-word shingles have a similarity of at
least 4/5; components of links are the groups. Candidates come from prefixes: with
all shingles in one order, two sets so similar share one among the first
n - ceil(4n/5) + 1 of each, so no linked pair is missed, whatever the length of the
texts. The order puts shingles that begin many documents' sets last; they are counted
over all documents, and the order bears on the cost only.

The number of prefix shingles that a pair shares bounds what its sets can share: what
the set whose prefix ends first has beyond its prefix can at most be added. Pairs that
the bound rules out (two documents of one passage, mostly) end there; of the others
the whole texts are compared, so similarities are exact.

Texts of one shingle set are one node from the start. Fingerprints come first: every node
gets the SimHash of its shingle set, equal and near fingerprints are found in tiles (see
``simhash``), and those whose sets are similar indeed are linked, so groups of near copies
are mostly one component before a prefix is looked at. Fingerprints are estimates and miss
links, which the prefixes then add between different components. Where a bucket (the nodes with one
prefix shingle) has more than a few nodes, of more than one component, they are compared as
tiles, whole sets against whole sets, so that no pair of them is moved on its own, be they near
copies or texts that are not quite similar. Pairs that share no such bucket are counted as
above: they are formed only between nodes that are not in one component yet, and where there
are many, each node is first compared with one of its bucket.

A shingle is known by its XXH64. Texts with fewer words than a shingle are one
shingle; those without a word are one node. Rows with a null id take no part; rows of
one id and different texts are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptledger.llm.common import arrow_batches, staged
from promptledger.llm.simhash import Forest, components, fingerprint, fingerprint_links, shingle_hashes

SHINGLE = 5
#: A shingle at the head of so many sets goes last in the order; no more than MOST_COMMON
#: of them do (8 bytes each), the most common first.
COMMON, MOST_COMMON = 8, 1_000_000
#: Shingles are counted among so many times the first of a set that its prefix has: where the
#: first ones go last, the next ones take their places.
COUNTED = 2
#: Rounds of comparing nodes with one of their bucket, at most; they end at so many pairs
#: per row, or when a round has left more than half of them.
ROUNDS, FEW = 4, 2
#: Buckets of more nodes are compared in tiles of about TILE shingles, so that pairs stay under
#: BIG / 2 for each row of a bucket, however large the groups of similar texts are.
BIG, TILE = 16, 1 << 17
#: Shingles of a tile that are held as a matrix at a time.
COLUMNS = 4_096
#: Texts, or pairs of them, that a worker holds at a time.
BATCH = 512
#: Ids up to so many are broadcast; beyond it texts are shuffled to them.
BROADCAST_IDS = 1_000_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """The shingles that are most often among a set's first by hash, sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(text, size) for text in batch["text"]]
            heads = [s[: COUNTED * _prefix(len(s))] for s in sets]
            yield pd.DataFrame({"key": np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)})

    counts = docs.select("text").mapInPandas(run, "key long").groupBy("key").count().where(F.col("count") >= COMMON)
    top = counts.orderBy(F.desc("count"), "key").limit(MOST_COMMON).select("key").toPandas()
    return np.sort(top["key"].to_numpy(np.int64).view(np.uint64))


def _prefix(n: int) -> int:
    return n - -(-4 * n // 5) + 1 if n else 0


def prefixes(docs: DataFrame, size: int, common: np.ndarray) -> DataFrame:
    """(doc_id, node, n, prefix, last, fp, low, high): the set's number and size, its first
    shingles in the order, the place of the last of them in it, and its fingerprint."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = sent.value
        for batch in batches:
            nodes, sizes, firsts, lasts, fps = [], [], [], [], []
            for text in batch["text"]:
                shingles = shingle_set(text, size)
                n = len(shingles)
                late = np.zeros(n, bool)
                if len(common):
                    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
                    late = common[at] == shingles
                first = np.concatenate([shingles[~late], shingles[late]])[: _prefix(n)]
                nodes.append(_node(shingles))
                sizes.append(n)
                firsts.append(first.view(np.int64))
                is_late = len(first) > n - int(late.sum())
                lasts.append(bytes([is_late]) + first[-1:].astype(">u8").tobytes())
                fps.append(fingerprint(shingles.reshape(-1, 1)))
            halves = np.array(fps, np.uint64).reshape(-1, 1).view(np.uint32)
            low, high = np.bitwise_count(halves).T
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "node": nodes, "n": sizes, "prefix": firsts, "last": lasts,
                 "fp": [fp.astype(">u8").tobytes() for fp in fps], "low": low, "high": high}
            ).astype({"node": "int64", "n": "int32", "low": "int32", "high": "int32"})

    return docs.mapInPandas(
        run, "doc_id long, node long, n int, prefix array<long>, last binary, fp binary, low int, high int"
    )


def _fingerprint_pairs(named: DataFrame) -> DataFrame:
    """(a, b): every node of a group of equal and near fingerprints with the group's least."""
    of = staged(named.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "low", "high"))), "near-fps")
    firsts = staged(
        of.groupBy("fp").agg(F.min("node").alias("first"), F.first("low").alias("low"), F.first("high").alias("high")),
        "near-firsts",
    )
    equal = of.join(firsts.select("fp", "first"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = equal.union(fingerprint_links(firsts))
    return components(found).where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def _possible(n: Column, m: Column) -> Column:
    """Whether sets of n and m can be similar."""
    return F.least(n, m) * 9 >= (n + m) * 4


def _survivors(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of the meetings (a, b, at_a, at_b), one per shared prefix shingle: those whose
    sets can be similar by the number of meetings.

    All of the prefix that ends first that the other set holds is in the other's prefix,
    so the sets share the meetings and at most what either has beyond them.
    """
    counted = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("last").alias(f"last_{s}"))
    known = counted.join(side("a"), "a").join(side("b"), "b")
    beyond = lambda x, y: F.least(F.expr(f"(4 * n_{x} + 4) div 5 - 1").cast("int"), F.col(f"n_{y}") - F.col(f"at_{y}") - 1)
    more = F.when(F.col("last_a") <= F.col("last_b"), beyond("a", "b")).otherwise(beyond("b", "a"))
    return known.where((F.col("c") + more) * 9 >= (F.col("n_a") + F.col("n_b")) * 4).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(a, b): the pairs whose sets have a similarity of at least 4/5, from (node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, x = None, None
        for batch in batches:
            keep = []
            for left, right in zip(batch["x"], batch["y"]):
                if x is None or left != text:
                    text, x = left, shingle_set(left, size)
                y = shingle_set(right, size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(9 * both >= 4 * (len(x) + len(y)))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The documents with (or, ``left_anti``, without) one of the distinct ids (doc_id);
    few enough ids are broadcast, so that texts stay where they are."""
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), "doc_id", how)
    return docs.join(ids.hint("merge"), "doc_id", how)


def texts_of(docs: DataFrame, asked: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, text) of the distinct nodes asked for, from one document each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": [_node(shingle_set(t, size)) for t in batch["text"]], "text": batch["text"]})

    asked = staged(asked.join(nodes, "node").select("node", "doc_id"), "near-asked")
    found = with_ids(docs.select("doc_id", "text"), asked.select("doc_id").distinct(), "left_semi")
    # A document id can stand for several texts; those of other nodes go here.
    named = found.select("text").mapInPandas(run, "node long, text string")
    return named.join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"])


def tile_links(x: list, y: list | None) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs among the (node, shingles) of one tile, or of
    one and another."""
    rows = [*x, *(y or [])]
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, common = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of one row add to no pair.
    kept = common[column] > 1
    owner, (_, column) = owner[kept], np.unique(column[kept], return_inverse=True)
    left = len(x)
    both = np.zeros((left, len(sets) - left if y else left), np.float32)
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    for first in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        both += part[:left] @ (part[left:] if y else part).T
    other = sizes[left:] if y else sizes
    alike = 9 * both >= 4 * (sizes[:left, None] + other[None, :])
    p, q = np.nonzero(alike if y else np.triu(alike, 1))
    links = Forest(len(sets)).join(p, q + left if y else q)
    return [(rows[i]["node"], rows[j]["node"]) for i, j in links]


def _tile_links(docs: DataFrame, big: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Links between all nodes of each big bucket, which are dealt to tiles of bounded size.

    Nodes get the least node that heads one of their buckets as a label, so a group
    that shares many buckets shares its tiles, and every pair of tiles that meet in a
    bucket is compared once.
    """

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "shingles": sets})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mine, other in zip(batch["x"], batch["y"]):
                yield pd.DataFrame(np.array(tile_links(list(mine), None if other is None else list(other)), np.int64).reshape(-1, 2), columns=["a", "b"])

    heads = big.groupBy("key").agg(F.min("node").alias("head"))
    labels = staged(
        big.join(heads, "key").groupBy("node").agg(F.min("head").alias("label"), F.first("n").alias("n")), "near-labels"
    )
    totals = labels.groupBy("label").agg((F.floor(F.sum("n") / TILE) + 1).alias("tiles"))
    tile = F.struct("label", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("part"))
    tiled = staged(labels.join(totals, "label").select("node", tile.alias("tile")), "near-tiled")
    in_tiles = staged(big.select("key", "node").join(tiled, "node").select("key", "tile").distinct(), "near-met")
    met = in_tiles.join(in_tiles.select("key", F.col("tile").alias("other")), "key").where("tile <= other").select("tile", "other").distinct()
    sets = texts_of(docs, labels.select("node"), nodes, size).mapInPandas(shingled, "node long, shingles binary")
    packed = staged(
        sets.join(tiled, "node").groupBy("tile").agg(F.collect_list(F.struct("node", "shingles")).alias("rows")), "near-tiles"
    )
    left = packed.select("tile", F.col("rows").alias("x"))
    right = packed.select(F.col("tile").alias("other"), F.col("rows").alias("y"))
    two = met.join(left, "tile").join(right, "other")
    alone = F.col("tile") == F.col("other")
    return staged(two.select("x", F.when(~alone, F.col("y")).alias("y")).mapInPandas(run, "a long, b long"), "near-tile-links")


def _stars(rows: DataFrame, seed: int) -> DataFrame:
    """Meetings of each node of a bucket with one that the seed picks."""
    row = F.struct(F.xxhash64("node", F.lit(seed)).alias("order"), "node", "n", "pos", "comp")
    hub = rows.groupBy("key").agg(F.min(row).alias("hub"))
    return _meetings(rows.join(hub, "key").select("*", *(F.col(f"hub.{c}").alias(f"_{c}") for c in ("node", "n", "pos", "comp"))))


def _pairs(rows: DataFrame) -> DataFrame:
    """Meetings of all nodes of a bucket in different components."""
    left = rows.select("key", *(F.col(c).alias(f"_{c}") for c in ("node", "n", "pos", "comp")))
    return _meetings(left.join(rows, "key").where("_node < node"))


def _meetings(met: DataFrame) -> DataFrame:
    met = met.where("_comp <> comp").where(_possible(F.col("_n"), F.col("n")))
    first = F.col("_node") < F.col("node")
    at = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.select(at("_node", "node", "a"), at("node", "_node", "b"), at("_pos", "pos", "at_a"), at("pos", "_pos", "at_b"))


def _apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    known = roots.select(F.col("node").alias("of"), "root")
    comp = rows.join(known, F.col("node") == F.col("of"), "left").withColumn("comp", F.coalesce("root", "node")).drop("of", "root")
    comp = staged(comp, "near-named")
    open_ = comp.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return staged(comp.join(open_, "key", "left_semi"), "near-open")


def groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id) of (doc_id, text): the smallest id of each row's group."""
    with arrow_batches(docs.sparkSession, BATCH):
        return _groups(docs, size)


def _groups(docs: DataFrame, size: int) -> DataFrame:
    docs = docs.where("doc_id IS NOT NULL")
    named = staged(prefixes(docs, size, common_shingles(docs, size)), "near-prefixes")
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("last").alias("last"))
    nodes = staged(nodes, "near-nodes")
    alike = verified if size == SHINGLE else partial(verified, size=size)

    def checked(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return staged(alike(pairs, texts_of(docs, asked, nodes, size)), "near-links")

    def with_links(roots: DataFrame, found: DataFrame) -> DataFrame:
        """The components with further links: what is known goes in as stars, which take no round."""
        known = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
        return components(known.union(found)).select("node", "root")

    roots = components(checked(_fingerprint_pairs(named))).select("node", "root")
    rows = named.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rows = rows.select("node", "n", F.posexplode("prefix").alias("pos", "key"))
    size_of = F.count("*").over(Window.partitionBy("key"))
    rows = staged(rows.withColumn("size", size_of).where("size > 1"), "near-shared")
    before = float("inf")
    big, rows = rows.where(F.col("size") > BIG), rows.where(F.col("size") <= BIG)
    if not big.isEmpty():
        roots = with_links(roots, _tile_links(docs, _apart(big, roots), nodes, size))
    for seed in range(ROUNDS + 1):
        left = _apart(rows, roots)
        per_bucket = left.groupBy("key", "comp").count().groupBy("key").agg(
            F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q")
        )
        n, many = per_bucket.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum((F.col("s") ** 2 - F.col("q")) / 2), F.lit(0))).first()
        last, before = seed == ROUNDS or many <= FEW * n or many > before / 2, many
        pairs = staged(_survivors(_pairs(left) if last else _stars(left, seed), nodes), "near-pairs")
        roots = with_links(roots, checked(pairs))
        if last:
            break
    ids = named.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("c"))
    ids = staged(ids, "near-ids")
    least = ids.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return ids.join(least, "c").select("doc_id", "component_id")
