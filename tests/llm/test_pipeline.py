"""The corpus pipeline on a small corpus, each stage against a plain version on its own input."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F
from test_near import brute_groups, pair

import corpus_pipeline
from promptledger.llm import decontam, langid, mix, shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SYLLABLES = {"en": ["the", "wa", "ther", "ing", "ow"], "de": ["sch", "ein", "ung", "ich", "ver"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def corpus():
    """Prose in two languages with exact copies, near ones on both sides of 0.8, a common
    passage, benchmark items, texts without letters, empty and null ones."""
    rng = random.Random(9)
    texts, passage = [], prose(rng, "en", 30)
    items = [prose(rng, lang, 40) for lang in ("en", "de", "en")]
    for lang in ("en", "de"):
        texts += [(prose(rng, lang, rng.randrange(30, 120)), lang) for _ in range(60)]
        texts += [(f"{prose(rng, lang, 60)} {passage}", lang) for _ in range(15)]
        texts += [(f"{prose(rng, lang, 25)} {item} {prose(rng, lang, 25)}", lang) for item in items]
    # Words of digits would have no language: the words of near pairs are named by prose.
    for least, most in [(0.80, 0.87)] * 6 + [(0.66, 0.74)] * 6:
        a, b = pair(rng, 120, least, most)
        names = {w: prose(rng, "en", 1) + prose(rng, "en", 1) + chr(97 + i % 26) + chr(97 + i // 26) for i, w in enumerate(dict.fromkeys((a + " " + b).split()))}
        texts += [(" ".join(names[w] for w in t.split()), "en") for t in (a, b)]
    texts += texts[:8] * 2 + [("12 34 !!", None), ("", "en"), (None, "de"), (" \n ", None)]
    rng.shuffle(texts)
    rows = [(i, t, lang, "abc"[i % 3] if i % 7 else None, len(t or "")) for i, (t, lang) in enumerate(texts)]
    return rows, items


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        str(folder / "documents.parquet")
    )
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows, items


@pytest.fixture(scope="module")
def steps(spark, inputs):
    """Each stage's input and output, written and read again as the pipeline does."""
    folder, rows, _ = inputs
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.staged(stage(spark, docs, folder), f"test-{name}")
        out[name] = before, docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(steps):
    assert list(steps) == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, (_, after) in steps.items():
        assert after.columns == COLUMNS + (["shard"] if name == "sharding" else [])


def test_language_keeps_what_has_one(steps, inputs):
    _, after = steps["language"]
    kept, lettered = set(ids(after)), {i for i, t, *_ in inputs[1] if langid.has_letter(t)}
    assert kept <= lettered and len(kept) >= 0.97 * len(lettered)
    assert {tuple(r) for r in after.collect()} <= set(inputs[1])


def test_one_of_each_near_group_stays(steps):
    before, after = steps["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    roots = brute_groups(rows)
    assert ids(after) == sorted(i for i in roots if roots[i] == i) and len(set(roots.values())) < len(rows)


def test_documents_with_an_item_go(steps, inputs):
    before, after = steps["decontamination"]
    five = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)}
    items = [five(t) for t in inputs[2]]

    def holds(text):
        words = (text or "").lower().split()
        return any(
            5 * len(item & found) >= 4 * len(item | found)
            for item in items for i in range(max(1, len(words) - 39)) if (found := five(" ".join(words[i : i + 40])))
        )

    assert ids(after) == sorted(r.doc_id for r in before.collect() if not holds(r.text))
    assert before.count() - after.count() >= 3


def test_mix_comes_near_its_targets(spark, steps):
    before, after = steps["mixing"]
    have, got, longest = collections.Counter(), collections.Counter(), 0
    for r in before.collect():
        have[r.source] += len((r.text or "").split())
        longest = max(longest, len((r.text or "").split()))
    for r in after.collect():
        got[r.source] += len((r.text or "").split())
    totals = spark.createDataFrame(list(have.items()), "source string, source_size long")
    want = {r.source: r.target for r in mix.targets(totals).collect()}
    assert all(abs(got[s] - want[s]) <= longest for s in want)
    copies = collections.Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 2 and {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}


def test_shards_are_runs_of_the_curve(steps):
    before, after = steps["sharding"]
    rows = shards.measured(shards.with_dimensions(before, [shards.ranks(before, c) for c in shards.TEXTS]))
    keyed = rows.withColumn("curve", shards.curve(shards.bounds(rows))).collect()
    total, done, want = sum(r["size"] for r in keyed), 0, collections.Counter()
    for r in sorted(keyed, key=lambda r: (r.curve, r.doc_id, r.text_crc32)):
        want[r.doc_id, min(math.floor((done + r["size"] / 2) * 24 / total), 23)] += 1
        done += r["size"]
    got = collections.Counter((r.doc_id, r.shard) for r in after.collect())
    # Rows equal in id and text have one key: all go to the shard of the last of them.
    last = {i: max(s for j, s in want if j == i) for i, _ in want}
    assert {i for i, _ in got} == set(last) and all(s <= last[i] for i, s in got)
    assert sum(got.values()) == before.count() and len({s for _, s in got}) > 20


def test_run_equals_its_stages(spark, inputs, steps):
    got = corpus_pipeline.run(spark, inputs[0])
    want = steps["sharding"][1]
    key = lambda df: collections.Counter(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert key(got) == key(want)


def test_stages_take_empty_tables_and_extra_columns(spark, inputs):
    folder, rows, _ = inputs
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        extra = docs.limit(40).withColumns({"score": F.lit(1), "node": F.lit("x"), "shard_": F.lit(None).cast("int")})
        out = stage(spark, extra, folder)
        assert out.columns == extra.columns + (["shard"] if name == "sharding" else []) and out.count() <= 80
    assert decontam.SIMILARITY == 0.8
