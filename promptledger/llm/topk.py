"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows. Candidates are packed into blocks with one
posting list per component; query rows are packed into blocks as well. Every
query block meets every candidate block once: for each of a query's components
its weight times the component's postings is added to a dense array of scores,
the block's best rows are picked by partition selection, and the picks of all
blocks are merged per query.

Vectors that are null or hold a null or non-finite component take no part, nor
do rows without an id. Empty vectors score 0; of vectors of different lengths
the missing components count as 0. Ties go to the smaller id. Candidates with
the query's id are the query's own. Repeated candidate rows count as often as
they stand there; a repeated query row is answered once. Components and scores
saturate at the limits of a 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptledger.llm.common import table

K = 10
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 8192
#: Pairs of a query block and a share of the candidate blocks, at least: the candidate
#: blocks are dealt by hash into as many shares as make up this number.
SHARES = 16
LIMIT = 2**63 - 1


def components(df: DataFrame, vector: str) -> DataFrame:
    """Rows that take part, with ``w``: the vector as 64-bit integers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.forall(F.col(vector), finite)
    return df.where(F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False))).withColumn(
        "w", F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("long"))
    )


def _pack(ids, rows) -> dict:
    """A block as bytes: ids, and the non-zero components in row order."""
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(rows)), sizes)
    used = flat != 0
    return {
        "ids": np.asarray(ids, np.int64).tobytes(), "row": row[used].astype(np.int32).tobytes(),
        "dim": dim[used].astype(np.int32).tobytes(), "weight": flat[used].tobytes(),
    }


def candidate_blocks(shares: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), CANDIDATE_BLOCK):
                part = batch.iloc[i : i + CANDIDATE_BLOCK].sort_values("vec_id")
                # Blocks begin at round numbers; their hashes fall into all shares.
                share = xxhash.xxh64_intdigest(int(part["vec_id"].iloc[0]).to_bytes(8, "little", signed=True)) % shares
                yield pd.DataFrame([_pack(part["vec_id"], list(part["w"])) | {"spread": share}]).astype({"spread": "int32"})

    return run


def query_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One hash bucket of about QUERY_BLOCK queries."""
    return pd.DataFrame([_pack(rows["vec_id"], list(rows["w"])) | {"block": key[0]}])


def _read(row, side: str):
    get = lambda name, kind: np.frombuffer(row[f"{side}{name}"], kind)
    return get("ids", np.int64), get("row", np.int32), get("dim", np.int32), get("weight", np.int64)


def best(query_id: int, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores; ``ids`` ascend, the query's own are left out."""
    open_ = np.flatnonzero(ids != query_id)
    if len(open_) > k:
        values = scores[open_]
        least = np.partition(values, len(values) - k)[len(values) - k]
        open_ = open_[values >= least]
    return open_[np.lexsort((ids[open_], [-int(s) for s in scores[open_]]))][:k]


def score_blocks(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, pair in batch.iterrows():
                ids, row, dim, weight = _read(pair, "c_")
                by_dim = np.argsort(dim, kind="stable")
                dims, first = np.unique(dim[by_dim], return_index=True)
                last = np.append(first[1:], len(dim))
                postings = {
                    int(d): (row[by_dim[a:b]], weight[by_dim[a:b]]) for d, a, b in zip(dims, first, last)
                }
                q_ids, q_row, q_dim, q_weight = _read(pair, "q_")
                ends = np.searchsorted(q_row, np.arange(len(q_ids) + 1))
                top = max((abs(int(w)) for a in (weight, q_weight) if len(a) for w in (a.min(), a.max())), default=0)
                terms = int(np.diff(ends).max(initial=0))
                kind = np.int64 if top * top * max(terms, 1) <= LIMIT else object
                scores = np.zeros(len(ids), kind)
                found = []
                for i, query_id in enumerate(q_ids):
                    scores[:] = 0
                    for d, w in zip(q_dim[ends[i] : ends[i + 1]], q_weight[ends[i] : ends[i + 1]]):
                        if (hit := postings.get(int(d))) is not None:
                            rows, values = hit
                            add = values * w if kind is np.int64 else values.astype(object) * int(w)
                            if len(rows) == len(ids):
                                scores += add
                            else:
                                scores[rows] += add
                    picked = best(query_id, scores, ids, k)
                    exact = scores[picked]
                    if kind is object:
                        exact = np.clip(exact, -LIMIT - 1, LIMIT)
                    found.append((np.full(len(picked), query_id), np.full(len(picked), i), ids[picked], exact))
                if found:
                    cols = [np.concatenate(c).astype(np.int64) for c in zip(*found)]
                    yield pd.DataFrame(dict(zip(("query_id", "place", "vec_id", "score"), cols))).assign(block=pair["block"])

    return run


PACKED = "ids binary, row binary, dim binary, weight binary"


def top_k(queries: DataFrame, candidates: DataFrame, vec_id="vec_id", vector="embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products."""
    narrow = lambda df: components(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where("vec_id IS NOT NULL"), "v").select("vec_id", "w")
    asked = narrow(queries).distinct()
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    tasks = max(SHARES, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = -(-tasks // n_blocks)
    by_hash = F.pmod(F.xxhash64("vec_id", "w"), F.lit(n_blocks))
    packed = asked.withColumn("block", by_hash).groupBy("block").applyInPandas(query_block, f"{PACKED}, block long")
    q = packed.select(
        "block", *(F.col(c).alias(f"q_{c}") for c in ("ids", "row", "dim", "weight")),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("spread"),
    )
    c = narrow(candidates).mapInPandas(candidate_blocks(shares), f"{PACKED}, spread int").select(
        "spread", *(F.col(c).alias(f"c_{c}") for c in ("ids", "row", "dim", "weight")),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"),
    )
    picks = q.join(c.hint("merge"), ["block", "spread"]).mapInPandas(
        score_blocks(k), "query_id long, place long, vec_id long, score long, block long"
    )
    rank = F.row_number().over(
        Window.partitionBy("block", "query_id", "place").orderBy(F.desc("score"), "vec_id")
    )
    return picks.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


OP3_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
