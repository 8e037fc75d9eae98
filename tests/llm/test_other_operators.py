"""Mixing, sharding, top-k, URLs, chat, language and quality on hand-made rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptledger.llm import chat, decontam, langid, mix, quality, queries, shards, simhash, topk, urlrules


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    left, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        open_ = [n for n in names if n not in full]
        rest = left - sum(2 * sizes[n] for n in full)
        out = {n: 2.0 * sizes[n] if n in full else rest * weight[n] / sum(weight[m] for m in open_) for n in names}
        over = {n for n in open_ if out[n] > 2 * sizes[n]}
        if not over:
            return out
        full |= over


def test_targets_and_takes(spark, documents, folder):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(60), None, rng.choice(["a", "b", "b", "b", "b", "\U0001f600", "c", None])) for i in range(600)]
    rows += [(None, "x y", None, "b"), (3, None, None, "empty")]
    out = mix.op10_mixing(spark, folder(documents=documents(*rows))).toPandas()
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(sizes)
    for (source, target), part in out.groupby(["source", "target"], dropna=False):
        source = source if isinstance(source, str) else None
        assert target == pytest.approx(want[source])
        assert abs(part["taken"].sum() - target) <= 60
    assert (out["taken"] <= 2 * out["size"]).all() and len(out) == len(rows)


def test_mixed_rows(spark, documents):
    docs = documents(*((i, "a b c", None, "big" if i < 90 else "small") for i in range(100))).withColumn("key", F.lit(1))
    got = collections.Counter(r.source for r in mix.mixed(docs).collect())
    assert got["small"] == 20 and got["big"] == 130
    assert mix.mixed(docs.limit(0)).count() == 0


def walk(n, bits):
    """The curve's cells in order, by its recursive definition in any dimension."""
    return sorted(np.ndindex(*[1 << bits] * n))


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_visits_neighbours(spark, n, bits):
    cells = spark.createDataFrame([([int(x) for x in c],) for c in walk(n, bits)], "c array<int>")
    got = cells.select("c", shards.hilbert(F.col("c"), n, bits).alias("p")).orderBy("p").collect()
    assert [r.p for r in got] == list(range((1 << bits) ** n))
    assert all(sum(abs(x - y) for x, y in zip(a.c, b.c)) == 1 for a, b in zip(got, got[1:]))


def test_shards_are_even_and_gapless(spark, documents, folder):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(200), rng.choice(["en", "de", None]), f"s{rng.randrange(9)}") for i in range(500)]
    rows += [(None, None, None, None), (7, "same", "en", "s1"), (7, "same", "en", "s1")]
    docs = documents(*rows)
    out = shards.op6_hilbert_shards(spark, folder(documents=docs)).toPandas()
    assert len(out) == len(rows) and set(out["shard"]) == set(range(24))
    sums = out.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * out["size"].max()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    crc = collections.Counter(zlib.crc32(t.encode()) for _, t, _, _ in rows if t is not None)
    assert collections.Counter(out["text_crc32"].dropna().astype("int64")) == crc
    assigned = {(r.doc_id, r.text): r.shard for r in shards.sharded(docs).collect()}
    digest = {(r.doc_id, r.text_crc32): r.shard for r in out.itertuples() if r.doc_id == r.doc_id}
    assert all(digest[d, zlib.crc32(t.encode())] == s for (d, t), s in assigned.items() if d is not None)
    assert shards.sharded(docs.limit(0)).count() == 0


def test_top_k_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -3.0]), (3, [nan, 1.0]), (4, None), (5, [None, 1.0]), (6, [inf, 0.0]),
            (7, []), (8, [0.5, 9.0, 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (100, [-0.0001, 1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id % 100 = 0"), df, k=4).collect()
    mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0)
    assert mine == [(1, 1, 524288), (2, 1, 524288), (3, 2, 524288), (4, 8, 524288)]
    top = [r for r in got if r.query_id == 100 and r["rank"] == 1]
    # Both saturate, so the smaller id is first.
    assert top[0].vec_id == 1 and top[0].score == 2**63 - 1
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "url,rule,verdict",
    [
        ("http://EXAMPLE.net/en/x", "example.net/en/", "allow"), ("http://a.net", None, "allow"), ("http://a.net/", "net/", "block"),
        ("http://net/q?x", "net/", "block"), ("http://a.org/x.net/y", None, "allow"), ("http://a.org/fr/", "org/fr/", "allow"),
        ("http://notexample.com/de/", None, "allow"), ("x://www.example.com/de/a", "example.com/de/", "block"),
        ("http://my.casino.org/fr/", "org/fr/", "allow"), ("http://my.casino.org", None, "block"), ("no scheme net/", None, "allow"),
        (None, None, "allow"), ("http://b.org/feed/a/b.xml", None, "block"), ("http://b.org/" + "a" * 5000, None, "allow"),
    ],
)
def test_urls(spark, url, rule, verdict):
    df = spark.createDataFrame([(url, "kept")], "url string, _x string")
    (row,) = urlrules.judged(df, "url").collect()
    assert (row.rule, row.verdict) == (rule, verdict)


def test_automaton_against_fnmatch():
    import fnmatch

    rng = random.Random(4)
    patterns = ["".join(rng.choice("ab*") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(200)]
    got = urlrules.Automaton.of([urlrules.parse(p) for p in patterns]).run([t.encode() for t in texts])
    want = [[fnmatch.fnmatchcase(t, p.replace("**", "*")) for p in patterns] for t in texts]
    assert got.tolist() == want


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9),
            ("t", 4, 3, "user", "<|end|>\n[INST] <\\s> </s>", 0.9), ("t", 5, 4, "assistant", None, 0.5),
            ("loop", 1, 2, "user", "x", 1.0), ("loop", 2, 1, "user", "y", 1.0), (None, 1, 99, "a b\n", "orphan", 1.0)]
    nodes = spark.createDataFrame(rows, "conv_id string, node long, parent long, role string, text string, score double")
    out = chat.formatted(nodes, keep=2).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    got = {(r.conv_id, r.branch): [tuple(t) for t in r.turns] for r in out}
    assert got == {
        ("t", 1): [("user", "q"), ("assistant", "good"), ("user", "<|end|>\n[INST] <\\s> </s>"), ("assistant", "")],
        ("t", 2): [("user", "q"), ("assistant", "bad")],
        (None, 1): [("a b\n", "orphan")],
    }


def test_long_path(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(150)]
    nodes = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    (row,) = chat.formatted(nodes).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert [t.text for t in row.turns] == [str(i) for i in range(150)]


def test_language(spark, documents):
    text = {"en": "the house and the water with which they think", "de": "das haus und das wasser mit welchem sie denken",
            "fr": "la maison et l'eau avec laquelle ils pensent"}
    rows = [(i, text[lang] + " " + str(i), lang, None) for i, lang in enumerate(list(text) * 40)]
    docs = documents(*rows, (500, None, "en", None), (501, "12 34 !!", None, None), (None, text["de"], "en", None), (502, "", "en", None))
    model = langid.fit(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert [got[i].lang_pred for i in (500, 501, None, 502)] == ["und", "und", "de", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(docs.limit(0)) is None and langid.recognised(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n
    if n >= 4:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3


def test_quality(spark, documents):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["river", "stone", "light", "garden"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "CHEAP!!"]) for _ in range(40))
    rows = [(i, bad() if i % 3 == 0 else good() + (" idiot" if i % 5 == 0 else ""), "en", "s") for i in range(400)]
    rows += [(None, None, None, None), (900, "", None, None)]
    labels = [(i, int(i % 3 != 0), int(i % 3 != 0 and i % 5 == 0)) for i in range(0, 400, 2)] + [(1, None, None), (None, 1, 1), (3, 1, 0), (3, 0, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(*rows)
    got = {r.doc_id: r for r in quality.scores(docs, marks).collect()}
    assert len(got) == 402
    right = [got[i].keep == (i % 3 != 0 and i % 5 != 0) for i in range(400)]
    assert sum(right) >= 390
    none = quality.scores(docs, marks.limit(0)).collect()
    assert {r.quality_score for r in none} == {0.5}
    assert quality.scores(docs.limit(0), marks).count() == 0


def test_checks_are_sql_of_registered_queries():
    assert set(queries.CHECKS) <= set(queries.QUERIES)
    assert all(isinstance(sql, str) for sql in queries.CHECKS.values())


def test_cycles_end_and_repeats_count_once(spark):
    """Replies below a cycle, repeated messages, a long chain, all beside plain trees."""
    rows = [("c", 1, 2, 9.0), ("c", 2, 1, 9.0), ("c", 3, 1, 9.0), ("c", 4, 3, 9.0)]
    rows += [("r", 1, None, 0.0)] * 3 + [("r", i, i - 1, 0.0) for i in range(2, 8) for _ in range(2)]
    rows += [("deep", i, i - 1 if i else None, 1.0) for i in range(300)] + [("deep", -1, 150, 5.0)]
    rows += [("self", 1, 1, 0.0), ("self", 2, 7, 1.0), ("none", None, None, 1.0), (None, 1, None, None)]
    nodes = spark.createDataFrame(
        [(c, n, p, "user" if (n or 0) % 2 else "assistant", f"t{n}", s) for c, n, p, s in rows],
        "conv_id string, node long, parent long, role string, text string, score double",
    ).withColumn("leaf", F.lit("clash"))
    out = chat.formatted(nodes, keep=2).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    got = {(r.conv_id, r.branch): [t.text for t in r.turns] for r in out}
    deep = [f"t{i}" for i in range(300)]
    assert got == {
        ("r", 1): [f"t{i}" for i in range(1, 8)], ("self", 1): ["t2"], (None, 1): ["t1"],
        ("deep", 1): [*deep[:151], "t-1"], ("deep", 2): deep,
    }
    scores = {(r.conv_id, r.branch): r.score for r in out}
    assert scores["deep", 1] == pytest.approx((151 + 5) / 152) and scores[None, 1] is None
    assert chat.formatted(nodes.limit(0)).count() == 0


def test_conversations_with_repeated_rows_and_without_any(spark, folder):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, None, "x")]
    sf = folder(conversations=spark.createDataFrame(rows, schema))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.op7_chat_trees(spark, sf).collect()}
    assert got == {1: (3, 0), None: (1, 0), -1: (2, len(chat.PROBE))}


def test_budget_that_ends_among_repeated_rows(spark, documents, folder):
    rows = [(7, "a b c d", None, "copies")] * 300 + [(i, "x y", None, "other") for i in range(100, 400)]
    rows += [(8, "a b c d", None, "none"), (9, None, None, "empty")]
    docs = documents(*rows)
    sf = folder(documents=docs)
    out = mix.op10_mixing(spark, sf).toPandas()
    part = out[out["source"] == "copies"]
    assert len(part) == 300 and abs(part["taken"].sum() - part["target"].iloc[0]) <= 4
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = con.execute(mix.OP10_SQL).df()[list(out.columns)]
    tidy = lambda df: sorted(df.itertuples(index=False, name=None), key=str)
    assert tidy(out.astype(str)) == tidy(want.astype({"taken": "int64", "size": "int64"}).astype(str))
    clash = docs.withColumns({"_again": F.lit(1), "_source": F.lit("x"), "_cut": F.lit(2), "_epochs": F.lit(3)})
    again = mix.mixed(clash)
    assert again.columns == clash.columns and abs(again.where("source = 'copies'").count() * 4 - part["target"].iloc[0]) <= 4


def test_sources_get_levels_of_their_own(spark, documents):
    docs = documents(*((i, "t", ["en", "es"][i % 2], f"src{i % 20}") for i in range(400)))
    placed = shards.with_dimensions(docs, [shards.ranks(docs, c) for c in shards.TEXTS])
    rows = shards.measured(placed)
    limits = shards.bounds(rows)
    found = rows.select(
        *(shards.level(F.get("dims", F.lit(i)), F.lit(lo), F.lit(hi)).alias(f"l{i}") for i, (lo, hi) in enumerate(limits[:2]))
    ).distinct().collect()
    assert len({r.l0 for r in found}) == 20 and len({r.l1 for r in found}) == 2


def test_cuts_equal_a_plain_walk_of_the_curve(spark, documents):
    rng = random.Random(2)
    docs = documents(*((i, "x" * rng.randrange(200), rng.choice(["en", None]), rng.choice("abc")) for i in range(300)))
    placed = shards.with_dimensions(docs, [shards.ranks(docs, c) for c in shards.TEXTS])
    rows = shards.measured(placed)
    keyed = rows.withColumn("curve", shards.curve(shards.bounds(rows))).drop("dims")
    order = sorted(keyed.collect(), key=lambda r: (r.curve, r.doc_id, r.text_crc32))
    total, before, want = sum(r["size"] for r in order), 0, {}
    for r in order:
        want[r.doc_id] = min(math.floor((before + r["size"] / 2) * 8 / total), 7)
        before += r["size"]
    assert {r.doc_id: r.shard for r in shards.sharded(docs, 8).collect()} == want
    assert {r.doc_id: r.shard for r in shards.cut_runs(keyed, 8).collect()} == want


def test_columns_of_any_name_stay(spark, documents):
    names = ("_own", "_gone", "own", "gone", "row", "dims", "r0", "v0", "size", "number", "spread", "text_key", "h", "_p", "_doc", "by", "plan")
    docs = documents((1, "some plain words here and more of them", "en", "a"), (2, None, None, None)).withColumns(
        {n: F.lit(n) for n in names}
    )
    items = spark.createDataFrame([(1, "some plain words here and more of them", "x")], "item_id long, text string, own string")
    kept = decontam.decontaminated(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    out = shards.sharded(docs.withColumn("shard", F.lit("old")))
    assert out.columns == [*docs.columns, "shard"] and out.count() == 2 and dict(out.dtypes)["shard"] == "int"
    left = simhash.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == 2
    mixed = mix.mixed(docs)
    assert mixed.columns == docs.columns and {r["by"] for r in mixed.collect()} == {"by"}
    guessed = langid.predicted(docs.withColumn("score", F.lit("old")), None)
    assert guessed.columns[-3:] == ["lang_pred", "score", "ambiguous"] and guessed.columns.count("score") == 1
    pages = spark.createDataFrame([(1, "http://a.net/x", "old")], "page_id long, url string, host string")
    (judged,) = urlrules.judged(pages, "url").collect()
    assert judged.asDict() == {"page_id": 1, "url": "http://a.net/x", "host": "a.net", "path": "/x", "rule": "net/", "verdict": "block"}


def test_candidate_blocks_fill_all_shares():
    import pandas as pd

    batches = [pd.DataFrame({"vec_id": range(10_000 * i, 10_000 * i + 3), "w": [[1]] * 3}) for i in range(400)]
    shares = collections.Counter(row["spread"].iloc[0] for row in topk.candidate_blocks(16)(iter(batches)))
    assert set(shares) == set(range(16)) and max(shares.values()) < 60


@pytest.mark.parametrize("n", [2, 3, 6, 11])
def test_decoding_equals_a_plain_walk_of_the_codewords(n):
    rng = np.random.default_rng(n)
    code = langid.codewords(n)
    weight = rng.random(code.shape) / 10
    model = langid.Model([f"l{i:02}" for i in range(n)], code, np.zeros((1, code.shape[1])), weight)
    for _ in range(200):
        margins = rng.normal(0, 0.5, code.shape[1])
        loss = {
            name: sum(w * math.exp(-langid.SHARPNESS * bit * m) for w, bit, m in zip(ws, word, margins))
            for name, ws, word in zip(model.languages, weight, code)
        }
        first, second = sorted(loss, key=lambda name: (loss[name], name))[:2]
        got, score = model.decode(margins)
        assert got == first and score == pytest.approx((loss[second] - loss[first]) / (loss[second] + loss[first]))
    one = langid.Model(["xx"], langid.codewords(1), np.zeros((1, 1)), np.ones((1, 1)))
    assert one.decode(np.zeros(1)) == ("xx", 1.0)


def test_margins_equal_plain_counts_of_grams():
    rng = np.random.default_rng(3)
    odds = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    model = langid.Model(["a", "b"], np.ones((2, 3)), odds, np.ones((2, 3)))

    def bucket(gram):
        code = 0
        for byte in gram:
            code = (code * 257 + byte + 1) % 2**32
        return ((code * 2654435761) % 2**32) >> 16

    for text in ("Été, 12 Häuser!", "a", "ab " * 50):
        data = f" {langid._OTHER.sub(' ', text.lower())} ".encode()
        found = [bucket(data[i : i + n]) for n in langid.SIZES for i in range(len(data) - n + 1)]
        want = odds[found].astype(float).sum(axis=0) / len(found)
        assert model.margins(text) == pytest.approx(want, rel=1e-5, abs=1e-6)
