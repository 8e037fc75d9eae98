"""Byte-level BPE, spelling variants and lexical search against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from promptledger.llm import bytebpe, lexical, spelling

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "\n\n  \n x", "don't DON'T we'll", "a" * 30_000, "  \t  　 tail  ", "<|endoftext|> <unk> ▁x",
    "\x00\x1c\x85​﻿", "naïve Ελλάδα 東京 🙂👍🏽 é", "١٢٣ ½ Ⅷ 12,345.67", "word " * 9_000, "\U0010ffff퟿",
]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={}
    )


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_ids_equal_the_tokenizers(spark, documents, folder, plain):
    rng = random.Random(3)
    mixed = ["".join(rng.choice("ab \n'sé中1.") for _ in range(rng.randrange(80))) for _ in range(200)]
    texts = [None, *ODD, *mixed, mixed[0]]
    out = bytebpe.op11_byte_bpe(spark, folder(documents=documents(*enumerate(texts), (0, None), (None, "null id"))))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, text in [*enumerate(texts), (0, None), (None, "null id")]:
        ids = plain.encode_ordinary(text or "")
        want.append((i, len(ids), digest(",".join(map(str, ids)).encode()), digest((text or "").encode())))
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(want)


def test_coded_columns_and_clashes(spark, plain):
    codec = bytebpe.ByteBpe(spark, RANKS, public_tokenizers.PATTERN)
    df = spark.createDataFrame([("two words", 1, "x", "y"), (None, 2, None, "z")], "text string, row int, ids string, source string")
    coded = codec.encoded(df)
    assert coded.columns == ["text", "row", "ids", "source"]
    both = codec.decoded(coded.withColumn("decoded", F.lit(1))).orderBy("row").collect()
    assert both[0]["ids"] == plain.encode_ordinary("two words") and bytes(both[0]["decoded"]) == b"two words"
    assert both[1]["ids"] == [] and bytes(both[1]["decoded"]) == b"" and both[1]["source"] == "z"
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in codec.decoded(nothing).collect()] == [None, b""]
    assert codec.decoded(codec.encoded(df.limit(0))).count() == 0


def test_model_needs_whole_vocabularies():
    ranks = {bytes([b]): b for b in range(256)}
    bytebpe.model_of(ranks | {b"ab": 256})
    with pytest.raises(ValueError):
        bytebpe.model_of({t: r for t, r in ranks.items() if t != b"\x00"})
    with pytest.raises(ValueError):
        bytebpe.model_of(ranks | {b"ab": 300})
    assert bytebpe.to_bytes(bytebpe.to_chars(bytes(range(256)))) == bytes(range(256))


def test_memory_of_pretokens_is_bounded(monkeypatch, plain):
    monkeypatch.setattr(bytebpe, "MEMORY", 3)
    encoder = bytebpe.Encoder(bytebpe.model_of(bytebpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    for text in ("one two three", "four five two", "y" * 500 + " two", "two two six", ""):
        (ids,) = encoder.ids([text])
        assert np.frombuffer(ids, np.int32).tolist() == plain.encode_ordinary(text)
    assert len(encoder.known) <= 5 and not any(len(t) > bytebpe.LONG for t in encoder.known)


def plain_variants(n):
    near = collections.defaultdict(set)
    cut = collections.defaultdict(set)
    for word in n:
        for i in range(len(word)):
            cut[word[:i], word[i + 1 :]].add(word)
            if (shorter := word[:i] + word[i + 1 :]) in n:
                near[word].add(shorter)
                near[shorter].add(word)
    for words in cut.values():
        for word in words:
            near[word] |= words - {word}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found_variants(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    n = {}
    for _ in range(500):
        word = "".join(rng.choice("aabé\U0001f600") for _ in range(rng.randrange(1, 7)))
        n[word] = rng.choice([1, 2, 2, 11, 25, 130, 1400])
    long = "ab" * 2_000
    n |= {long: 50, long[:2000] + "c" + long[2001:]: 3, long[1:]: 2, "lonely-word": 4}
    rows = [*n.items(), (None, 5), ("", 900), ("nulln", None)]
    words = spark.createDataFrame(rows, "word string, n long").withColumn("place", F.lit("extra"))
    assert found_variants(spelling.variants(words.repartition(7))) == plain_variants(n)


def test_repeated_words_and_chains(spark):
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2_000, "xbcdefghij": 20_000, "xbcdefghijk": 200_000}
    words = spark.createDataFrame([*chain.items(), ("abcdefg", 0)], "word string, n long")
    got = found_variants(spelling.variants(words))
    assert got == plain_variants(chain) and all(r[2] == "xbcdefghijk" for r in got)
    assert spelling.variants(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(words, ratio=1)


def test_spelling_query(spark, documents, folder):
    rng = random.Random(8)
    base = ["Another", "letters", "lettres", "Élémentaire", "crossing", "crossings", "short"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", ",", "9", "-"]) for _ in range(rng.randrange(90)))) for i in range(80)]
    rows += [(None, "Another crossing crossing"), (5, None), (6, ""), (7, "z" * 5_000), (8, "z" * 5_000)]
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = plain_variants({w: c for w, c in counts.items() if len(w) >= 7 and c >= 2})
    got = spelling.op12_spelling(spark, folder(documents=documents(*rows)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found_variants(got) == want


def plain_terms(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(items, docs, k=20):
    counted = [(i, plain_terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in counted), sum(len(t) for _, t in counted)
    df = collections.Counter(t for _, terms in counted for t in set(terms))
    out = []
    for item, text in items:
        asked, scored = collections.Counter(plain_terms(text)), []
        for doc_id, terms in counted:
            tf, m = collections.Counter(terms), 75 + (25 * len(terms) * n) // total if total else 0
            score = sum(
                c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t, c in asked.items() if tf[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort(key=lambda r: r[:3])
        out += [(item, rank, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(scored[:k], 1)]
    return collections.Counter(out)


def test_terms():
    text = "Éa B9_c d-\x7fe\U0001f600 f G \x1c!"
    assert [t.decode() for t in lexical.terms_of(text)] == plain_terms(text)
    assert lexical.terms_of(None) == lexical.terms_of("") == []


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["été", "Été"]
    text = lambda m: " ".join(words[min(int(rng.expovariate(0.1)), 61)] for _ in range(m))
    docs = [(i, text(rng.randrange(40))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # ties
    docs += [(7, docs[7][1]), (None, docs[7][1]), (None, "w3"), (2000, None), (2001, ""), (2002, "!!"), (2003, "w1 " * 20_000)]
    items = [(i, text(rng.randrange(1, 30))) for i in range(12)]
    return docs, items + [(12, None), (13, ""), (14, "unheard of"), (0, "w5 w5 w6"), (15, docs[7][1])]


@pytest.mark.parametrize("terms", [lexical.QUERY_TERMS, 20])
def test_search_equals_brute_force(spark, documents, folder, monkeypatch, terms):
    monkeypatch.setattr(lexical, "QUERY_TERMS", terms)  # 20: several blocks of queries
    docs, items = corpus()
    repeated = spark.createDataFrame([*items, items[3]], "item_id long, text string")
    path = folder(documents=documents(*docs).repartition(5), benchmark=repeated)
    got = collections.Counter(map(tuple, lexical.op13_lexical_search(spark, path).collect()))
    assert got == plain_search(items, docs)


def test_search_with_nothing_or_clashing_columns(spark, documents):
    docs = documents((1, "some words"), (2, None)).withColumn("item_id", F.lit(1)).withColumn("n", F.lit("x"))
    items = spark.createDataFrame([(3, "Words", "x")], "item_id int, text string, score string")
    (row,) = lexical.search(items, docs).collect()
    assert (row.item_id, row.rank, row.doc_id) == (3, 1, 1)
    assert lexical.search(items.limit(0), docs).count() == lexical.search(items, docs.limit(0)).count() == 0


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    # Rows about a few topics, so that balls are apart.
    cols = [np.unique(rng.integers(0, 40, 12) + 40 * (i % 25)) for i in range(3_000)]
    vals = [rng.integers(1, 10**6, len(c)) for c in cols]
    rows = lexical.Rows.of(cols, vals)
    tree, ids = lexical.BallTree(rows, 1_000), np.arange(3_000)
    for topic in range(0, 25, 3):
        col = np.unique(rng.integers(0, 40, 9) + 40 * topic)
        weight = rng.integers(1, 9_000, len(col))
        dense = np.zeros(1_000, np.int64)
        dense[col] = weight
        scores = rows.dot(dense)
        order = [i for i in np.lexsort((ids, -scores))[:20] if scores[i] > 0]
        best = lexical.Best(20)
        assert tree.search(col, weight, best, ids) < 600
        assert best.ids.tolist() == order and best.scores.tolist() == scores[order].tolist()


def test_lengths_beyond_64_bits():
    tf, n = np.array([3, 1]), np.array([2**45, 10])
    m = [75 + (25 * int(x) * 2**20) // 2**60 for x in n]
    want = [(10**9 * int(t)) // (1000 * int(t) + 12 * y) for t, y in zip(tf, m)]
    assert lexical.saturated(tf, n, 2**20, 2**60).tolist() == want
