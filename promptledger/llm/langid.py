"""Language identification with error-correcting output codes.

Every language has a codeword; each bit has a binary classifier over hashed
n-grams of UTF-8 bytes (naive Bayes: mean log odds per n-gram). A text's margins
are decoded to the codeword with the least weighted exponential loss, where a
classifier weighs as much as it is right for that language on a second sample. The
score is the distance of the two nearest codewords; a small one flags ambiguity.

Counts are taken from at most about ``SAMPLE`` labelled texts per language, chosen
by a hash of the id; every whole text is predicted. Language, source and id are no
inputs of a prediction. Texts that are null or have no letter are ``und`` with
score 0; so is everything if nothing can be learnt. Rows with a null id are not
learnt from. Repeated rows and extra columns are ordinary; empty tables give empty
results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm.common import table

SAMPLE = 2_000
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
AMBIGUOUS = 0.05
SHARPNESS = 4.0
_OTHER = re.compile(r"[\W\d_]+")
_PIECE = 1 << 16


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """(n, bits) of -1 and 1: exhaustive codes for few languages, else the best of some random ones."""
    if n <= 2:
        return np.array([[1.0], [-1.0]])[:n]
    if n <= 5:
        bits = [[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for i in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.array(bits, float).T
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice([-1.0, 1.0], (n, length)) for _ in range(100)]
    apart = lambda m: (length - (m @ m.T) + np.eye(n) * 4 * length).min()
    return max(tries, key=apart)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, in pieces of bounded size."""
    data = np.frombuffer(f" {_OTHER.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass"), np.uint8)
    for i in range(0, len(data), _PIECE):
        piece = data[i : i + _PIECE + max(SIZES) - 1].astype(np.uint32)
        code = np.zeros(len(piece), np.uint32)
        for n in range(1, max(SIZES) + 1):
            if len(piece) < n:
                break
            code = code[: len(piece) - n + 1] * np.uint32(257) + piece[n - 1 :] + np.uint32(1)
            if n in SIZES:
                yield ((code * np.uint32(2654435761)) >> np.uint32(16))[:_PIECE]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text)) if text else False


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    weight: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for buckets in grams(text):
            total += self.odds[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[str, float]:
        loss = (self.weight * np.exp(np.clip(-SHARPNESS * self.code * margins, -30, 30))).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        if len(order) == 1:
            return self.languages[0], 1.0
        first, second = loss[order[0]], loss[order[1]]
        return self.languages[order[0]], float((second - first) / (second + first))


def counts(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """(languages, buckets): n-gram counts of a bounded sample, from a few tasks."""
    place = {v: i for i, v in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                for buckets in grams(text):
                    out[place[lang]] += np.bincount(buckets, minlength=BUCKETS)
        yield pd.DataFrame({"n": [out.tobytes()]})

    got = rows.select("text", "lang").repartition(8).mapInPandas(run, "n binary").collect()
    return sum((np.frombuffer(r.n, np.int64).reshape(len(languages), BUCKETS) for r in got), np.zeros((len(languages), BUCKETS), np.int64))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from (doc_id, text, lang); one pass over labels, two over samples."""
    rows = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    # One row per language.
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n)))), F.col("lang"))
    draw = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) / 1_000_000 < share
    seen = counts(rows.where(draw(1)), languages) + 0.0
    code = codewords(len(languages))
    totals = seen.sum(axis=1, keepdims=True)
    rates = seen / np.maximum(totals, 1)  # languages count alike, however common
    floor = 0.5 / max(float(totals.max()), 1.0)
    odds = np.stack(
        [np.log(rates[code[:, b] > 0].mean(axis=0) + floor) - np.log((rates[code[:, b] < 0].mean(axis=0) if (code[:, b] < 0).any() else 0 * rates[0]) + floor) for b in range(code.shape[1])],
        axis=1,
    ).astype(np.float32)
    model = Model(languages, code, odds, np.ones_like(code))
    place = {v: i for i, v in enumerate(languages)}

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = np.zeros_like(code), np.zeros((len(languages), 1))
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                out[place[lang]] += model.margins(text) * code[place[lang]] > 0
                n[place[lang]] += 1
        yield pd.DataFrame({"right": [out.tobytes()], "n": [n.tobytes()]})

    got = rows.where(draw(2)).select("text", "lang").repartition(8).mapInPandas(right, "right binary, n binary").collect()
    good = sum(np.frombuffer(r.right).reshape(code.shape) for r in got)
    n = sum(np.frombuffer(r.n).reshape(-1, 1) for r in got)
    accuracy = (good + 1) / (n + 2)
    model.weight = accuracy / accuracy.sum(axis=1, keepdims=True)
    return model


ADDED = ("lang_pred", "score", "ambiguous")


def predicted(docs: DataFrame, model: Model | None, text="text") -> DataFrame:
    """Add (lang_pred, score, ambiguous) from the text alone; earlier columns of these
    names are replaced."""
    docs_kept = [c for c in docs.columns if c not in ADDED]
    if model is None:
        return docs.select(*docs_kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = [model.decode(model.margins(t)) if has_letter(t) else ("und", 0.0) for t in texts]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    out = docs.withColumn("_p", predict(F.col(text)))
    return out.select(
        *docs_kept, F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"),
        (F.col("_p.score") < AMBIGUOUS).alias("ambiguous"),
    )


def held_out(doc_id: str = "doc_id"):
    """Never learnt from: crc32 of the id mod 4 is 2, or there is no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def recognised(docs: DataFrame) -> DataFrame:
    """The documents in a language that can be told; their columns stay as they are."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    judged = predicted(docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text")), model, "_text")
    return judged.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select("_doc.*")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predicted(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
