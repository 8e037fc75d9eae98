"""Quality and toxicity scores by co-training two views of a document.

The text view looks at words and trailing marks (which of a learnt vocabulary
occur); the metadata view at source, language, length and layout. A classifier
per view starts from labelled documents. In every round each view scores all
unlabelled documents, and the ones it is surest of become labels for the other
view. At the end both views are calibrated on labelled documents that no round
has seen and added up to one probability.

Fitted on at most about ``SAMPLE`` labelled documents, chosen by a hash of the
id, plus ``EXCHANGED`` per round, view and class; every whole text is scored. Null
and empty texts have no words and are scored by their metadata. Without labels,
or with one class only, scores are that class's rate, or one half. Labels that are
null or contradict each other do not count. Rows with null ids are scored and
never learnt from. Repeated rows and extra columns are ordinary; empty tables
give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm.common import staged, table

SAMPLE = 12_000
WORDS = 800
ROUNDS = 3
EXCHANGED = 150
#: Below it a word tells the classes apart no better than thousands of others by chance.
CHI_SQUARE = 25.0
SURE = 0.97
CATEGORIES = 32
TARGETS = ("quality", "toxic")
_EDGE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def tokens(text: str | None) -> set[str]:
    """Distinct lower-cased words, and the marks at their ends."""
    out: set[str] = set()
    for word in set((text or "").split()):
        before, core, after = _EDGE.match(word).groups()
        if core:
            out.add(core.lower())
            if len(core) > 1 and core.isupper():
                out.add("capitals")
        out.update(m for m in (before, after) if m)
    return out


def metadata(text: str | None, source: str | None, lang: str | None) -> np.ndarray:
    """Length, layout and hashed source and language; no word is looked at."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(data), 1)
    count = np.bincount(data, minlength=256)
    lines = text.count("\n") + 1
    blanks = int(count[[9, 10, 11, 12, 13, 32]].sum())
    out = np.zeros(10 + 2 * CATEGORIES, np.float32)
    out[:10] = (
        1, np.log1p(len(data)) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 10, 10 * count[48:58].sum() / n,
        2 * count[65:91].sum() / n, 5 * (count[33:48].sum() + count[58:65].sum()) / n, 5 * blanks / n,
        count[128:].sum() / n, 20 * count[[35, 36, 37, 38, 42, 124]].sum() / n,
    )
    for i, value in enumerate((source, lang)):
        out[10 + i * CATEGORIES + zlib.crc32((value or "").encode("utf-8", "surrogatepass")) % CATEGORIES] = 0.3
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Regularised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    x = x.astype(np.float64)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((p - y)) + penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class Views:
    """Per target: weights of both views, and of their sum (bias, text, metadata)."""

    text: dict[str, np.ndarray] = field(default_factory=dict)
    meta: dict[str, np.ndarray] = field(default_factory=dict)
    both: dict[str, np.ndarray] = field(default_factory=dict)
    rate: dict[str, float] = field(default_factory=dict)

    def margins(self, target: str, words: list, meta: list) -> tuple[np.ndarray, np.ndarray]:
        w, v = self.text[target], self.meta[target]
        t = np.array([w[0] + w[1 + np.asarray(x, np.int64)].sum() for x in words], float)
        return t, np.stack(meta) @ v if len(meta) else np.zeros(0)

    def probability(self, target: str, words: list, meta: list) -> np.ndarray:
        if target not in self.both:
            return np.full(len(words), self.rate.get(target, 0.5))
        t, m = self.margins(target, words, meta)
        b = self.both[target]
        return 1 / (1 + np.exp(-np.clip(b[0] + b[1] * t + b[2] * m, -30, 30)))


def labelled(labels: DataFrame) -> DataFrame:
    """One row per id; labels that contradict each other become null."""
    sole = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(sole(c) for c in TARGETS))


def vocabulary(sample: DataFrame, size: int = WORDS) -> dict[str, list[str]]:
    """Per target, the tokens that tell its classes best, by chi-square."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list[int]] = {}
            for text, q, t in zip(batch["text"], batch["quality"], batch["toxic"]):
                for token in tokens(text):
                    row = out.setdefault(token, [0, 0, 0])
                    row[0] += 1
                    row[1] += q == 1
                    row[2] += t == 1
            yield pd.DataFrame([(k, *v) for k, v in out.items()], columns=["token", "n", "quality", "toxic"])

    counted = sample.select("text", *TARGETS).mapInPandas(run, "token string, n long, quality long, toxic long")
    summed = staged(counted.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", *TARGETS))).where("n >= 8"), "quality-words")
    total = sample.agg(F.count("*").alias("n"), *(F.sum(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in TARGETS)).first()
    out: dict[str, list[str]] = {c: [] for c in TARGETS}
    for c in TARGETS:
        rate = (total[c] or 0) / max(total["n"], 1)
        if 0 < rate < 1:
            chi = (F.col(c) - F.col("n") * rate) ** 2 / (F.col("n") * rate * (1 - rate))
            best = summed.where(chi >= CHI_SQUARE).orderBy(chi.desc(), "token").limit(size // len(TARGETS))
            out[c] = [r.token for r in best.collect()]
    return out


def features(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, words array<int>, meta array<float>): what both views see of every whole text."""
    place = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "words": [sorted(place[t] for t in tokens(x) if t in place) for x in batch["text"]],
                    "meta": [metadata(*r) for r in zip(batch["text"], batch["source"], batch["lang"])],
                }
            )

    return docs.select("doc_id", "text", "source", "lang").mapInPandas(run, "doc_id long, words array<int>, meta array<float>")


def _dense(words: list, n: int) -> np.ndarray:
    out = np.zeros((len(words), n + 1), np.float32)
    out[:, 0] = 1
    for i, x in enumerate(words):
        out[i, 1 + np.asarray(x, np.int64)] = 1
    return out


def _fit_words(x: np.ndarray, y: np.ndarray, own: list[int]) -> np.ndarray:
    """Weights of the target's own words; 0 for other words."""
    columns = [0, *(1 + i for i in own)]
    out = np.zeros(x.shape[1])
    out[columns] = logistic(x[:, columns], y, 1.0)
    return out


def co_train(rows: DataFrame, n_words: int, own: list[int], target: str, rounds: int = ROUNDS, views: Views | None = None) -> Views:
    """Fit one target from (doc_id, words, meta, drawn, labels)."""
    views = views or Views()
    known = rows.where(F.col("drawn") & F.col(target).isNotNull()).select("doc_id", "words", "meta", target).toPandas()
    y = known[target].to_numpy(float)
    views.rate[target] = float(y.mean()) if len(y) else 0.5
    # A fifth of the labelled documents is only used to calibrate.
    aside = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d in known["doc_id"]], bool)
    if len(y) == 0 or not 0 < y[~aside].mean() < 1 or not aside.any() or not 0 < y[aside].mean() < 1:
        return views
    fit = known[~aside]
    sets = {v: [fit, y[~aside]] for v in ("text", "meta")}
    used: list[int] = []
    for turn in range(rounds + 1):
        views.text[target] = _fit_words(_dense(list(sets["text"][0]["words"]), n_words), sets["text"][1], own)
        views.meta[target] = logistic(np.stack(list(sets["meta"][0]["meta"])), sets["meta"][1], 1.0)
        if turn == rounds:
            break
        scored = staged(_scored(rows.where(F.col(target).isNull() & F.col("doc_id").isNotNull()), views, target), "quality-round")
        # Ids that were exchanged before: bounded by rounds * 4 * EXCHANGED.
        scored = scored.where(~F.col("doc_id").isin(used)) if used else scored
        for giver, taker in (("text", "meta"), ("meta", "text")):
            for value, sign in ((1, 1), (0, -1)):
                sure = np.log(SURE / (1 - SURE))
                best = scored.where(sign * F.col(giver) >= sure).orderBy((sign * F.col(giver)).desc(), "doc_id").limit(EXCHANGED).toPandas()
                best = best.drop(columns=["text", "meta"]).rename(columns={"layout": "meta"})
                if len(best):
                    used += best["doc_id"].tolist()
                    old, labels = sets[taker]
                    sets[taker] = [pd.concat([old, best]), np.append(labels, np.full(len(best), float(value)))]
    t, m = views.margins(target, list(known[aside]["words"]), list(known[aside]["meta"]))
    x = np.stack([np.ones_like(t), t, m], axis=1)
    views.both[target] = logistic(x, y[aside], 0.1)
    return views


def _scored(rows: DataFrame, views: Views, target: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t, m = views.margins(target, list(batch["words"]), list(batch["meta"]))
            yield batch.assign(**{"text_": t, "meta_": m})

    out = rows.select("doc_id", "words", "meta").mapInPandas(
        run, "doc_id long, words array<int>, meta array<float>, text_ double, meta_ double"
    )
    return out.select("doc_id", "words", F.col("meta").alias("layout"), F.col("text_").alias("text"), F.col("meta_").alias("meta"))


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality_score, toxic_score, keep) of every document."""
    marks = staged(labelled(labels), "quality-labels")
    share = min(1.0, sample / max(marks.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    narrow = docs.select("doc_id", "text", "source", "lang")
    chosen = narrow.join(marks.where(drawn), "doc_id")
    telling = vocabulary(staged(chosen.select("text", *TARGETS), "quality-sample"))
    words = list(dict.fromkeys(w for c in TARGETS for w in telling[c]))
    seen = staged(features(narrow, words), "quality-features")
    # Written: every fit and every round reads it again, and would shuffle the features each time.
    rows = staged(
        seen.join(marks.withColumn("drawn", drawn), "doc_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(False))),
        "quality-rows",
    )
    views = Views()
    for target in TARGETS:
        co_train(rows, len(words), [words.index(w) for w in telling[target]], target, views=views)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = (list(batch["words"]), list(batch["meta"]))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), **{f"{t}_score": views.probability(t, *both) for t in TARGETS}}
            )

    out = seen.mapInPandas(run, "doc_id long, quality_score double, toxic_score double")
    return out.withColumn("keep", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
