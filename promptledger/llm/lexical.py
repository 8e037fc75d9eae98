"""Ranked lexical search: exact inner products found in sparse ball trees.

A document is a sparse vector with one integer component per term, its saturated
frequency; a query is a vector of term weights; the score is their inner product.
Only components of the queries' terms matter, so documents keep those (and their
whole length). Every task builds ball trees over blocks of its documents: a node has a
centroid c and a radius r that no document under it exceeds, so none scores more
than q.c + |q| r, |q| being taken over the terms that occur under the node. Both are
rounded up by far more than doubles can err, so pruning is safe. Where the sum of the
largest components under the node is lower, that integer is the bound. Per query the nodes are visited from the best bound down until it falls below
the k-th best score the task has seen; the documents of visited leaves are scored in
64-bit integers. The tasks' best are merged in two steps, first within hash buckets.

Queries are asked in blocks of about ``QUERY_TERMS`` terms, so what the tasks are given is
bounded; each block reads the documents once.

Null and empty texts have no terms: such documents score nothing, such items have no
rows. Documents of equal score go by ascending id, a null id after all others. Repeated
document rows are documents of their own; a repeated item row (id and text) is one
item, and items that share an id only are each ranked for themselves. Texts are read
whole, whatever their length. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptledger.llm.common import ranged, staged, table, with_prefix

K = 20
QUERY_TERMS = 200_000
#: Documents of one tree, and of one leaf at most (more if they are equal).
BLOCK, LEAF = 4_096, 16
MERGES = 64
#: Bounds are raised by this share; sums of a million doubles err by less than a billionth.
SLACK = 1e-8
#: Everything below 0x80 but digits and letters is a blank; A-Z become a-z.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


@dataclass
class Queries:
    """A block of queries: ids, texts' terms with their numbers of repeats, and the numbers of all terms."""

    ids: list[int | None]
    counts: list[dict[bytes, int]]

    def __post_init__(self):
        self.numbers = {t: i for i, t in enumerate(sorted(set().union(*self.counts)))}

    def vectors(self, n_docs: int, df: dict[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the terms that occur in the documents, ascending, and their weights."""
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        out = []
        for counts in self.counts:
            found = sorted((self.numbers[t], c) for t, c in counts.items() if weight.get(self.numbers[t]))
            out.append((np.array([t for t, _ in found], np.int64), np.array([weight[t] * c for t, c in found], np.int64)))
        return out


def query_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Queries]:
    """The distinct items, in blocks that fit the driver and a broadcast."""
    size = F.greatest(F.octet_length("text") / 6, F.lit(1)).cast("long").alias("size")
    asked = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    sized = ranged(asked.select("id", "text", size), "lexical-items", "id", "text")
    cut = with_prefix(sized, ["id", "text"], {"before": "size"})
    blocks = staged(cut.select("id", "text", F.floor(F.col("before") / QUERY_TERMS).alias("block")), "lexical-blocks")
    for (block,) in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        rows = blocks.where(F.col("block") == block).collect()
        yield Queries([r["id"] for r in rows], [Counter(terms_of(r["text"])) for r in rows])


def projected(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of (doc_id, text): all terms counted, the numbered ones kept."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch["text"]:
                words = terms_of(text)
                found = sorted(Counter([known[w] for w in words if w in known]).items())
                sizes.append(len(words))
                terms.append(np.array([t for t, _ in found], np.int32))
                tfs.append(np.array([c for _, c in found], np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": sizes, "terms": terms, "tfs": tfs})

    return docs.mapInPandas(run, "doc_id long, n long, terms array<int>, tfs array<long>")


@dataclass
class Rows:
    """Sparse integer rows: row i holds the entries from ``start[i]`` to ``start[i + 1]``."""

    start: np.ndarray
    col: np.ndarray
    val: np.ndarray

    @classmethod
    def of(cls, cols: list[np.ndarray], vals: list[np.ndarray]) -> Rows:
        start = np.concatenate([[0], np.cumsum([len(c) for c in cols])]).astype(np.int64)
        return cls(start, np.concatenate(cols), np.concatenate(vals))

    def take(self, rows: np.ndarray) -> Rows:
        size = self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.start[rows] - (ends - size), size)
        return Rows(np.concatenate([[0], ends]), self.col[at], self.val[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Products with a dense vector, in its type; no row is empty."""
        return np.add.reduceat(self.val * dense[self.col], self.start[:-1])


class BallTree:
    """A tree over non-empty sparse rows with non-negative components."""

    def __init__(self, rows: Rows, width: int, leaf: int = LEAF):
        self.width = width
        self.children: list[tuple[int, int] | None] = []
        self.leaves: list[tuple[np.ndarray, Rows] | None] = []
        centroids, radii, tops = [], [], []
        squares = np.add.reduceat(rows.val.astype(float) ** 2, rows.start[:-1])
        dense = np.zeros(width)
        open_ = [(np.arange(len(rows.start) - 1), None)]
        while open_:
            members, parent = open_.pop()
            node = len(self.children)
            if parent is not None:
                self.children[parent] += (node,)
            part, square = rows.take(members), squares[members]
            centroid = np.bincount(part.col, part.val, width) / len(members)
            used = np.flatnonzero(centroid)
            norm = float((centroid[used] ** 2).sum())
            slack = SLACK * (square.max() + norm)
            far = square - 2 * part.dot(centroid) + norm
            centroids.append((used, centroid[used]))
            top = np.zeros(width, np.int64)
            np.maximum.at(top, part.col, part.val)
            tops.append(top[used])
            radii.append(math.sqrt(max(far.max(), 0) + slack))
            if len(members) <= leaf or far.max() <= slack:
                self.children.append(None)
                self.leaves.append((members, part))
                continue
            self.children.append(())
            self.leaves.append(None)
            # Two rows far apart; each row goes to the side it is nearer to, both sides being even.
            sides = []
            pivot = int(far.argmax())
            for _ in range(2):
                at = slice(part.start[pivot], part.start[pivot + 1])
                dense[part.col[at]] = part.val[at]
                away = square - 2 * part.dot(dense) + square[pivot]
                dense[part.col[at]] = 0
                sides.append(away)
                pivot = int(away.argmax())
            order = np.argsort(sides[0] - sides[1], kind="stable")
            half = len(order) // 2
            open_ += [(members[order[half:]], node), (members[order[:half]], node)]
        self.centroids = Rows.of(*zip(*centroids))
        self.radii = np.array(radii)
        self.tops = Rows(self.centroids.start, self.centroids.col, np.concatenate(tops))

    def search(self, col: np.ndarray, weight: np.ndarray, best: Best, ids: np.ndarray) -> int:
        """Offer every row that can be among the best; returns the number of rows scored."""
        exact = np.zeros(self.width, np.int64)
        exact[col] = weight
        asked = exact.astype(float)[self.centroids.col]
        parts = self.centroids.start[:-1]
        norms = np.sqrt(np.add.reduceat(asked**2, parts))
        balls = np.add.reduceat(asked * self.centroids.val, parts) + norms * self.radii
        bounds = np.minimum(balls * (1 + SLACK) + 1, self.tops.dot(exact))
        heap, scored = [(-bounds[0], 0)], 0
        while heap and -heap[0][0] >= best.least:
            _, node = heapq.heappop(heap)
            if self.children[node] is None:
                members, part = self.leaves[node]
                best.offer(part.dot(exact), ids[members])
                scored += len(members)
            else:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], child))
        return scored


class Best:
    """The k best (score, id) so far; ``least`` is what a further score must reach."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        able = scores >= self.least
        if not able.any():
            return
        scores, ids = np.concatenate([self.scores, scores[able]]), np.concatenate([self.ids, ids[able]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The components: (10^9 tf) div (1000 tf + 12 m) with m from the document's length."""
    length = n.astype(object) if 25 * int(n.max(initial=0)) * n_docs >= 2**63 else n
    m = (100 - 25 + (25 * length * n_docs) // n_terms).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


NO_ID = np.iinfo(np.int64).max  # stands for a null id while ranking, as the last one


def best_of(docs: DataFrame, queries: Queries, vectors, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(place, doc_id, score): each task's k best documents of every query of the block."""
    width = len(queries.numbers)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BLOCK:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k) for _ in sent.value]
        for all_rows in blocks(batches):
            for i in range(0, len(all_rows), BLOCK):
                part = all_rows.iloc[i : i + BLOCK]
                sizes = part["terms"].map(len).to_numpy()
                tf = np.concatenate(list(part["tfs"]))
                val = saturated(tf, np.repeat(part["n"].to_numpy(), sizes), n_docs, n_terms)
                cols = np.concatenate(list(part["terms"]))
                used, local = np.unique(cols, return_inverse=True)
                tree = BallTree(Rows(np.concatenate([[0], np.cumsum(sizes)]), local, val), len(used))
                ids = part["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
                for found, (col, weight) in zip(best, sent.value):
                    here, a, b = np.intersect1d(used, col, assume_unique=True, return_indices=True)
                    if len(here):
                        tree.search(a, weight[b], found, ids)
        for place, found in enumerate(best):
            rows = pd.DataFrame({"place": place, "doc_id": found.ids, "score": found.scores})
            yield rows.astype({"doc_id": "Int64"}).assign(doc_id=lambda r: r["doc_id"].mask(r["doc_id"] == NO_ID))

    if not width:
        return docs.select(F.lit(0).cast("long").alias("place"), "doc_id", F.col("n").alias("score")).limit(0)
    return docs.where(F.size("terms") > 0).mapInPandas(run, "place long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, item_id="item_id", text="text", doc_id="doc_id", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "block int, place long, item_id long, doc_id long, score long")
    for block, queries in enumerate(query_blocks(items, item_id, text)):
        rows = staged(
            projected(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), queries.numbers),
            "lexical-docs",
        )
        n_docs, n_terms = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        # One row per term of the block at most.
        df = {r["t"]: r["c"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect()}
        picks = best_of(rows, queries, queries.vectors(n_docs, df), n_docs, n_terms, k)
        ids = spark.createDataFrame(list(enumerate(queries.ids)), "place long, item_id long")
        # One short row per query of the block.
        found = found.union(picks.join(F.broadcast(ids), "place").select(F.lit(block), "place", "item_id", "doc_id", "score"))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))
    first = F.row_number().over(Window.partitionBy("block", "place", bucket).orderBy(*order))
    last = F.row_number().over(Window.partitionBy("block", "place").orderBy(*order))
    few = found.withColumn("rank", first).where(F.col("rank") <= k).drop("rank")
    return few.select("item_id", last.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d) GROUP BY r, t),
q AS (
  SELECT i, item_id, t, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY i, item_id, t),
w AS (
  SELECT t, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, c WHERE t IN (SELECT t FROM q) GROUP BY t),
s AS (
  SELECT i, item_id, d.r, d.doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(terms) * n) // l))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN d ON d.r = tf.r, c GROUP BY i, item_id, d.r, d.doc_id),
ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {K}
"""
