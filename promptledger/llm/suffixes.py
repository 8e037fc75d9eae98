"""Removal of long repeated byte strings by bucket-pointer refinement.

Every suffix of every text is identified by a bucket: first by its q-gram, then,
with the identifiers of the round before reused, by the pair of its own bucket and
that of a later offset (64 bytes, 128, 256, 400). Doing this for all suffixes of a
corpus would shuffle more than the corpus, so it is done in the order that drops
suffixes soonest, without losing any:

1. Each 400-byte string is represented by the suffix inside it whose 128-byte
   bucket is least. Neighbouring strings share it, so about every 137th suffix is
   left. Buckets with one such suffix hold nothing repeated and are dropped.
2. The neighbouring strings of one suffix form a run, identified by a digest of
   all its bytes. If a run occurs twice, all its strings are repeated.
3. In buckets with several different runs, one of each kind is refined: its strings
   are cut into parts of 16 by their distance from the representing suffix, the
   same for equal strings. A part's bucket is refined by its core, the 385 bytes
   that all strings at these distances share; parts with the same digest are repeated.
4. What is still mixed, parts of one core with different ends, is refined to the
   400-byte buckets of its single strings; those that meet another are repeated.

A byte is removed if a repeated string covers it. Strings never cross texts and
are judged on the input. Final identifiers have 128 bits.

Null and empty texts have no strings. Equal texts and repeated rows repeat each
other. A text is processed in pieces, so its length does not matter. Rows with
null ids are rows like others. Extra columns are ignored. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm.common import staged, table

LENGTH = 400
GRAM = 64
#: Bytes of a bucket by which strings are represented, and places it can have in one.
BUCKET = 2 * GRAM
PLACES = LENGTH - BUCKET + 1
PART = 16
PIECE = 1 << 18
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1B54A32D192ED03))
_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64)) if n else np.zeros(0, np.uint64)


_POWER = [_powers(b, PIECE + 2 * LENGTH) for b in _BASES]
_INVERSE = [_powers(np.uint64(pow(int(b), -1, 1 << 64)), PIECE + 2 * LENGTH) for b in _BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    x = (x ^ (x >> np.uint64(27))) * _ODD[1]
    return x ^ (x >> np.uint64(31))


def grams(data: np.ndarray, which: int) -> np.ndarray:
    """Bucket of the q-gram at every place: a rolling polynomial, mixed."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWER[which][:n], out=sums[1:])
    return _mix((sums[GRAM:] - sums[:-GRAM]) * _INVERSE[which][: n - GRAM + 1])


def refine(ids: np.ndarray, offset: int) -> np.ndarray:
    """Bucket of the string twice as long: own bucket and that of a later offset."""
    return _mix(ids[:-offset] * np.uint64(3) + _mix(ids[offset:] + np.uint64(1)))


def full_ids(data: np.ndarray, which: int) -> np.ndarray:
    """Bucket of the 400-byte string at every place."""
    ids = refine(refine(grams(data, which), GRAM), 2 * GRAM)
    return refine(ids, LENGTH - 4 * GRAM)


def least(ids: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least bucket among ``width``, for every place."""
    place = np.arange(len(ids), dtype=np.uint64)
    key = (ids & ~np.uint64((1 << 20) - 1)) | place
    pad = -len(key) % width
    key = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(key, axis=1).ravel()
    right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(ids) - width + 1
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)


def digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def packed(first, back, count):
    """First string, distance of its representing suffix, number of strings."""
    return (first << 20) | (back << 10) | count


def unpacked(place):
    return place >> 20, (place >> 10) & 1023, place & 1023


def runs(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place, bucket, digest) of every run of a text."""
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, len(data) - LENGTH + 1, PIECE):
        piece = whole[begin : begin + PIECE + LENGTH - 1]
        ids = refine(grams(piece, 0), GRAM)
        at = least(ids, PLACES)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        count = np.diff(first, append=len(at))
        places = packed(first + begin, at[first] - first, count)
        for s, n, p, b in zip((first + begin).tolist(), count.tolist(), places.tolist(), ids[at[first]].view(np.int64).tolist()):
            yield p, b, digest(data[s : s + n + LENGTH - 1])


def _bytes(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _frame(columns: list[str], rows: list[tuple], digests: list[bytes]) -> pd.DataFrame:
    u = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    out = pd.DataFrame(np.array(rows, np.int64).reshape(-1, len(columns)), columns=columns)
    return out.assign(u1=u[:, 0], u2=u[:, 1])


def find_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, digests = [], []
        for text, x, y in zip(batch["text"], batch["k1"], batch["k2"]):
            for place, bucket, u in runs(_bytes(text)):
                rows.append((bucket, x, y, place)), digests.append(u)
            if len(rows) > 50_000:
                yield _frame(["b", "k1", "k2", "place"], rows, digests)
                rows, digests = [], []
        yield _frame(["b", "k1", "k2", "place"], rows, digests)


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the listed runs, under 700 each."""
    for batch in batches:
        out = []
        for text, listed, k1, k2 in zip(batch["text"], batch["runs"], batch["k1"], batch["k2"]):
            data = _bytes(text)
            for run in listed:
                s, _, n = unpacked(run["place"])
                out.append((k1, k2, run["b"], run["place"], run["known"], data[s : s + n + LENGTH - 1]))
        yield pd.DataFrame(out, columns=["k1", "k2", "b", "place", "known", "data"])


def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A run cut by distance from its suffix: (run, core, at) and digest; at is first
    string of the part within the run * 1024 + strings. Equal strings have equal
    cores, whatever the run's ends; unequal cores that collide are told apart later."""
    for batch in batches:
        rows, digests = [], []
        for run, b, place, data in zip(batch["run"], batch["b"], batch["place"], batch["data"]):
            _, back, n = unpacked(int(place))
            part = (back - np.arange(n)) // PART
            firsts = np.flatnonzero(np.diff(part, prepend=part[0] + 1))
            for f, c in zip(firsts.tolist(), np.diff(firsts, append=n).tolist()):
                p = int(part[f])
                core = data[back - p * PART : back - p * PART + LENGTH - PART + 1]
                bucket = int.from_bytes(xxhash.xxh3_64_digest(core, (b + p) % (1 << 64)), "big", signed=True)
                rows.append((run, bucket, f * 1024 + c)), digests.append(digest(data[f : f + c + LENGTH - 1]))
        yield _frame(["run", "core", "at"], rows, digests)


def single_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The 400-byte buckets of every string of the listed parts; x is run * 1024 + string."""
    for batch in batches:
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for run, data, listed in zip(batch["run"], batch["data"], batch["ats"]):
            whole = np.frombuffer(data, np.uint8)
            for at in listed:
                f, c = divmod(int(at), 1024)
                one = whole[f : f + c + LENGTH - 1]
                out.append((full_ids(one, 0), full_ids(one, 1), np.arange(f, f + c) + run * 1024))
        w1, w2, x = (np.concatenate(c) for c in zip(*out))
        yield pd.DataFrame({"w1": w1.view(np.int64), "w2": w2.view(np.int64), "x": x})


def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, places in zip(batch["doc_id"], batch["text"], batch["places"]):
            data = np.frombuffer(_bytes(text), np.uint8)
            edge = np.zeros(len(data) + 1, np.int32)
            if places is not None and len(places):
                s, _, n = unpacked(np.asarray(places, np.int64))
                np.add.at(edge, s, 1)
                np.add.at(edge, s + n + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


KEY = ["k1", "k2"]


def _refined(rows: DataFrame, bucket: list[str], member: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Members that another equals (same digest), and of buckets with several
    digests one member of each: what the next round refines."""
    kind = [*bucket, "u1", "u2"]
    kinds = staged(
        rows.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct(*member)).alias("one")), f"{name}-kinds"
    )
    same = rows.join(kinds.where("n > 1").select(*kind), kind, "left_semi")
    mixed = kinds.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1").select(*bucket)
    still = kinds.join(mixed, bucket, "left_semi").select(*bucket, "one.*", (F.col("n") > 1).alias("known"))
    return same, still


def repeated(docs: DataFrame) -> DataFrame:
    """(k1, k2, place): runs and single strings of texts that occur elsewhere.

    ``docs`` has text, its 128-bit key and a row name.
    """
    found = docs.select("text", *KEY).mapInPandas(find_runs, "b long, k1 long, k2 long, place long, u1 long, u2 long")
    shared = found.groupBy("b").count().where("count > 1").select("b")
    left = staged(found.join(shared, "b", "left_semi"), "suffix-buckets")
    whole, still = _refined(left, ["b"], [*KEY, "place"], "suffix-runs")

    per_text = still.groupBy(*KEY).agg(F.collect_list(F.struct("b", "place", "known")).alias("runs"))
    firsts = docs.groupBy(*KEY).agg(F.min("row").alias("row"))
    wanted = staged(per_text.join(firsts, KEY), "suffix-wanted")
    cut = docs.select("text", *KEY, "row").join(wanted, [*KEY, "row"]).select("text", "runs", *KEY).mapInPandas(
        slices, "k1 long, k2 long, b long, place long, known boolean, data binary"
    )
    # Numbered once and written; rows that stand there twice would seem to repeat each other.
    open_runs = staged(
        cut.dropDuplicates([*KEY, "place"]).withColumn("run", F.monotonically_increasing_id()), "suffix-open"
    )
    split = staged(
        open_runs.select("run", "b", "place", "data").mapInPandas(
            parts, "run long, core long, at long, u1 long, u2 long"
        ),
        "suffix-parts",
    )
    same, still = _refined(split, ["core"], ["run", "at"], "suffix-parts")
    listed = still.groupBy("run").agg(F.collect_list("at").alias("ats"))
    strings = staged(
        open_runs.select("run", "data").join(listed, "run").mapInPandas(single_strings, "w1 long, w2 long, x long"),
        "suffix-strings",
    )
    twice = strings.groupBy("w1", "w2").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").select("w1", "w2")
    singles = strings.join(twice, ["w1", "w2"], "left_semi").select(
        F.floor(F.col("x") / 1024).alias("run"), (F.col("x") % 1024 * 1024 + 1).alias("at")
    )
    inside = same.select("run", "at").union(singles).join(open_runs.where(~F.col("known")).select("run", *KEY, "place"), "run")
    first = F.shiftright("place", 20) + F.floor(F.col("at") / 1024)
    refined = inside.select(*KEY, (F.shiftleft(first, 20) + F.col("at") % 1024).alias("place"))
    return whole.select(*KEY, "place").union(refined)


def without_repeats(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("row"),
    )
    # The strings of one text: never more than the text has.
    places = staged(repeated(keyed).groupBy(*KEY).agg(F.collect_set("place").alias("places")), "suffix-places")
    return keyed.join(places, KEY, "left").select("doc_id", "text", "places").mapInPandas(
        kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))
