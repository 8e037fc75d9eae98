"""Spelling variants: words one inserted, deleted or replaced code point apart.

The words are sorted into ranges and the nodes of their trie are numbered, and so
are those of the trie of the reversed words: every task walks its sorted words and
gives each node the number it met it with. Nodes that words of several ranges share lie on
the path of the first word of a range; those few words are numbered alike in every task.

A word skips each of its code points in turn: the pair (prefix node before it, suffix
node after it) stands for the word without that place. Two words that share a skipped
pair differ by a replacement there; a word whose plain pair (prefix node, suffix node
of one place) is a skipped pair of another is that one with a code point deleted. In a
run of equal code points only the last one's deletion is looked at, so two words meet
in one way only. At most one word has a plain pair, and words of one skipped pair
differ in one code point of the alphabet, so a pair's words are few whatever the
corpus; no pairs of words are formed, each word takes the number of its neighbours
and the best of them from the pair.

Null words and rows with a null n take no part, nor do empty words; repeated words are
one word with the sum of their n. Equal n go to the word smallest in code-point order.
Words of any length cost in proportion to it. Extra columns are ignored. Empty tables
give empty results. In the query a null text has no runs, and no run of a document
without an id loses a code point.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count
from os.path import commonprefix
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm.common import ranged, staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-z\u00C0-\u00FF]"
_LOWERED = str.maketrans(UPPER, LOWER)
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: A form is at least RATIO times as frequent as its word, so a chain of forms has fewer links.
MOST_FORMS = 20
#: Different words that a task counts before it passes them on.
HELD = 100_000
#: Numbers of a range start at its own multiple of this.
RANGE = 1 << 40


class Trie:
    """Numbers the nodes on the paths of words that come in sorted order."""

    def __init__(self, start: int):
        self.numbers = count(start)
        self.word, self.path = "", [next(self.numbers)]

    def add(self, word: str, known: list[int] | None = None) -> list[int]:
        """The nodes of all prefixes, the empty one first; ``known`` are numbered already."""
        shared = len(commonprefix((self.word, word)))
        path = self.path[: shared + 1]
        if known is not None and len(known) > len(path):
            path = known
        self.word, self.path = word, path + [next(self.numbers) for _ in range(len(word) + 1 - len(path))]
        return self.path


def boundary_paths(firsts: list[str]) -> list[list[int]]:
    trie = Trie(0)
    return [trie.add(word) for word in firsts]


def numbered(words: DataFrame, name: str) -> DataFrame:
    """``words`` (word, sorted by it in ranges) with ``place``, its number in sorted order,
    and ``nodes``, the trie nodes of its prefixes."""
    split = ranged(words, name, "word")
    # One word per range: bounded by the number of partitions.
    firsts = sorted((r["w"], r["_part"]) for r in split.groupBy("_part").agg(F.min("word").alias("w")).collect())
    names, parts = [w for w, _ in firsts], {p: i for i, (_, p) in enumerate(firsts)}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, trie, part = boundary_paths(names), None, None
        for batch in batches:
            places, nodes = [], []
            for word, here in zip(batch["word"], batch["_part"]):
                if here != part:
                    part, i = here, parts[here]
                    trie, places_of = Trie(RANGE * (i + 1)), count(RANGE * (i + 1))
                    near = [(names[j], paths[j]) for j in (i, i + 1) if j < len(names)]
                known = max((path[: len(commonprefix((word, other))) + 1] for other, path in near), key=len)
                places.append(next(places_of))
                nodes.append(np.array(trie.add(word, known), np.int64))
            yield batch.drop(columns="_part").assign(place=places, nodes=nodes)

    together = split.repartition(max(1, len(names)), "_part").sortWithinPartitions("_part", "word")
    return together.mapInPandas(run, f"{schema}, place long, nodes array<long>")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, place, n_near, best): the number of neighbours of each of the distinct words
    (word, n), and the most frequent one as (n, -place); null if there is none."""
    forward = staged(numbered(words, "spelling-words"), "spelling-forward")
    turned = forward.select(F.reverse("word").alias("word"))
    backward = numbered(turned, "spelling-reversed")
    both = forward.withColumnRenamed("nodes", "heads").join(
        backward.select(F.reverse("word").alias("word"), F.reverse("nodes").alias("tails")), "word"
    )
    # tails[i] is the node of what follows the first i code points.
    length, at = F.char_length("word"), F.col("at")
    char = lambda i: F.substring(F.col("word"), i + 1, F.lit(1))
    pairs = both.select("word", "place", "n", "heads", "tails", F.explode(F.sequence(F.lit(0), length)).alias("at"))
    head, after = F.get("heads", at), lambda i: F.get("tails", i)
    row = lambda skips, counts: F.struct("n", (-F.col("place")).alias("order"), skips.alias("skips"), counts.alias("counts")).alias("m")
    plain = F.struct(head.alias("p"), after(at).alias("s"), row(F.lit(False), F.lit(False)))
    last_of_run = (at == length - 1) | (char(at) != char(at + 1))
    skipped = F.struct(head.alias("p"), after(at + 1).alias("s"), row(F.lit(True), last_of_run))
    ways = F.when(at < length, F.array(plain, skipped)).otherwise(F.array(plain))
    met = pairs.select(F.inline(ways)).groupBy("p", "s").agg(F.sort_array(F.collect_list("m"), asc=False).alias("all"))
    met = met.where(F.size("all") > 1)
    # One word of a pair at most doesn't skip; it meets those whose skip counts.
    skip, counted = F.filter("all", lambda m: m["skips"]), F.filter("all", lambda m: m["skips"] & m["counts"])
    member = lambda a, i: F.get(a, F.lit(i))
    met = met.select(
        F.size(skip).alias("n_skip"), member(skip, 0).alias("first"), member(skip, 1).alias("second"),
        F.size(counted).alias("n_counted"), member(counted, 0).alias("first_counted"),
        member(F.filter("all", lambda m: ~m["skips"]), 0).alias("plain"), F.explode("all").alias("me"),
    )
    seen = F.when(F.col("me.counts"), F.col("plain"))
    others = F.when(F.col("me.order") == F.col("first.order"), F.col("second")).otherwise(F.col("first"))
    top = F.when(F.col("me.skips"), F.greatest(others, seen)).otherwise(F.col("first_counted"))
    n_near = F.when(F.col("me.skips"), F.col("n_skip") - 1 + F.when(seen.isNull(), 0).otherwise(1)).otherwise(F.col("n_counted"))
    met = met.select((-F.col("me.order")).alias("place"), n_near.alias("near"), top.alias("top")).where("near > 0")
    best = F.max(F.struct(F.col("top.n").alias("n"), F.col("top.order").alias("order")))
    found = met.groupBy("place").agg(F.sum("near").cast("long").alias("n_near"), best.alias("best"))
    return forward.select("word", "n", "place").join(found, "place", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the table (word, n)."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    distinct = words.where("word IS NOT NULL AND word <> '' AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    near = neighbours(distinct)
    has_form = F.col("best.n") >= ratio * F.col("n")
    near = near.withColumn("to", F.when(has_form, -F.col("best.order"))).withColumn("form_n", F.when(has_form, F.col("best.n")))
    near = staged(near.drop("best"), "spelling-near")
    named = near.select(F.col("place").alias("to"), F.col("word").alias("form"))
    # Doubling: after r rounds a step goes 2^r forms up, or to the last one.
    steps = near.where("to IS NOT NULL").select("place", F.col("to").alias("root"))
    for _ in range((MOST_FORMS - 1).bit_length()):
        steps = staged(steps, "spelling-steps")
        onward = steps.select(F.col("place").alias("root"), F.col("root").alias("next"))
        if not onward.join(steps.select("root").distinct(), "root", "left_semi").head(1):
            break
        steps = steps.join(onward, "root", "left").select("place", F.coalesce("next", "root").alias("root"))
    roots = steps.join(named.select(F.col("to").alias("root"), F.col("form").alias("last")), "root").select("place", "last")
    out = near.join(named, "to", "left").join(roots, "place", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def occurrences(doc_id: int | None, text: str | None, find) -> Iterator[tuple[str, int]]:
    """The words of a text with their numbers: lower-cased runs, less one code point
    where 31 divides the checksum of the run with the document's id."""
    start = None if doc_id is None else crc32(b"%d:" % doc_id)
    for run, times in Counter(find(text or "")).items():
        run = run.lower() if run.isascii() else run.translate(_LOWERED)
        if start is not None and (h := crc32(run.encode(), start)) % 31 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, times


def counted(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of (doc_id, text): words of ``least`` code points or more in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shorter runs give shorter words, with a code point deleted or not.
        find, counts = re.compile(LETTERS + "{%d,}" % least).findall, defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for word, times in occurrences(doc_id.as_py(), text.as_py(), find):
                    if len(word) >= least:
                        counts[word] += times
                if len(counts) >= HELD:
                    yield from _flushed(counts)
        yield from _flushed(counts)

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _flushed(counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays(
        [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
    )
    counts.clear()


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return variants(words.where(F.col("n") >= MIN_COUNT))


#: The checksum is linear: each byte's share depends on its distance from the end only.
OP12_SQL = rf"""
WITH RECURSIVE base AS (
  SELECT b, list_reduce([b::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v
  FROM range(256) r(b)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run
  FROM documents),
each AS (SELECT doc_id, run, count(*) AS c, hex(encode(doc_id || ':' || run)) AS h FROM runs GROUP BY doc_id, run),
most AS (SELECT coalesce(max(length(h) // 2), 0) AS m FROM each),
share AS (
  SELECT 0 AS k, b, v FROM base
  UNION ALL
  SELECT k + 1, s.b, xor(s.v // 256, t.v) FROM share s JOIN base t ON t.b = s.v % 256 WHERE k < (SELECT m FROM most)),
start AS (
  SELECT 0 AS k, 4294967295::UBIGINT AS v
  UNION ALL
  SELECT k + 1, xor(s.v // 256, t.v) FROM start s JOIN base t ON t.b = s.v % 256 WHERE k < (SELECT m FROM most)),
bytes AS (
  SELECT doc_id, run, length(h) // 2 - 1 - i AS k, ('0x' || substr(h, 2 * i + 1, 2))::INT AS b
  FROM (SELECT doc_id, run, h, unnest(range(length(h) // 2)) AS i FROM each)),
sums AS (
  SELECT doc_id, run, bit_xor(s.v) AS v, count(*) AS len
  FROM bytes JOIN share s USING (k, b) GROUP BY doc_id, run),
checked AS (SELECT doc_id, run, xor(xor(sums.v, start.v), 4294967295::UBIGINT) AS crc FROM sums JOIN start ON start.k = len),
spelt AS (
  SELECT CASE WHEN crc % 31 = 0 THEN left(run, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2)
    ELSE run END AS word, c
  FROM each LEFT JOIN checked USING (doc_id, run)),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
cut AS (
  SELECT word, left(word, i) || chr(1) || substr(word, i + 2) AS marked, left(word, i) || substr(word, i + 2) AS plain
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (marked) WHERE a.word <> b.word
  UNION SELECT word, plain FROM cut WHERE plain IN (SELECT word FROM words)
  UNION SELECT plain, word FROM cut WHERE plain IN (SELECT word FROM words)),
near AS (
  SELECT p.word, count(*) AS n_near, first(p.other ORDER BY o.n DESC, p.other) AS best, max(o.n) AS best_n
  FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word),
forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN best_n >= {RATIO} * n THEN best END AS form, CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n
  FROM words LEFT JOIN near USING (word)),
up AS (
  SELECT word, word AS top, 0 AS step FROM forms
  UNION ALL
  SELECT up.word, f.form, step + 1 FROM up JOIN forms f ON f.word = up.top WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(top, step) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
