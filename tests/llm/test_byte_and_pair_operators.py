"""Operators that SQL cannot express, against brute force."""

import collections
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from promptledger.llm import decontam, simhash, suffixes


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- repeated strings

def brute_removed(texts):
    data = [(t or "").encode() for t in texts]
    starts = collections.Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if starts[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_cases():
    rng = random.Random(3)
    base = words(rng, 400)
    passage = words(rng, 90)
    near = base.split()
    near[150] = "changed"
    return [
        base, base, " ".join(near), None, "", "short", "a" * 900, "a" * 399, "é" * 450,
        words(rng, 120) + passage + words(rng, 60), passage, words(rng, 50) + " " + passage,
        passage + words(rng, 30) + passage, base[:399], base[:400], base[700:1101] + "x",
        "é" + words(rng, 100) + base[1:402], ("line of text that repeats itself\n" * 40),
    ]


def test_repeats_against_brute_force(spark, documents):
    texts = repeat_cases()
    got = suffixes.without_repeats(documents(*enumerate(texts))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_removed(texts)


def test_repeats_of_edited_copies(spark, documents):
    """Copies with an edit anywhere and cut anywhere: equal strings in runs with different ends."""
    rng = random.Random(9)
    base, texts = words(rng, 220), []
    for _ in range(60):
        at, begin = rng.randrange(len(base)), rng.randrange(60)
        texts.append((base[:at] + rng.choice(["", "#", "##"]) + base[at + 1 :])[begin : len(base) - rng.randrange(60)])
    got = suffixes.without_repeats(documents(*enumerate(texts))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_removed(texts)


def test_repeats_across_pieces(spark, documents, monkeypatch):
    rng = random.Random(5)
    text = words(rng, 60_000)
    assert len(text) > suffixes.PIECE
    other = "x" + text[suffixes.PIECE - 300 : suffixes.PIECE + 500]
    got = suffixes.without_repeats(documents((1, text), (2, other))).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [800, 800]


def test_repeats_nulls_and_repeated_rows(spark, documents):
    text = words(random.Random(1), 200)
    docs = documents((None, text), (7, text), (7, text), (8, None)).withColumn("b", F.lit(1)).withColumn("k1", F.lit("x"))
    got = suffixes.without_repeats(docs).collect()
    assert sorted((r.doc_id or 0, r.n_removed == r.n_bytes) for r in got) == [(0, True), (7, True), (7, True), (8, True)]
    assert suffixes.without_repeats(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- fingerprints

def brute_fingerprint(text, size=3):
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)] or ([b" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_simhash_against_brute_force(spark, documents):
    rng = random.Random(7)
    base = [words(rng, 300) for _ in range(6)]
    texts = []
    for k in range(120):
        tokens = base[k % 6].split()
        for _ in range(k % 5):
            tokens[rng.randrange(300)] = "Z"
        texts.append(" ".join(tokens))
    texts += [None, "", " \t\n", "One", "one", "one two", "É été\u00a0x", "a b c d"]
    got = simhash.component_ids(simhash.fingerprints(documents(*enumerate(texts)))).collect()
    want = [(i, brute_fingerprint(t)) for i, t in enumerate(texts)]
    assert {r.doc_id: int(r.fp.hex(), 16) for r in got} == dict(want)
    assert {r.doc_id: r.component_id for r in got} == brute_components(want)


def test_simhash_tiles_do_not_matter(spark, documents, monkeypatch):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(30)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps for _ in range(6)]
    rows = [(i, f.to_bytes(8, "big"), (f & 0xFFFFFFFF).bit_count(), (f >> 32).bit_count()) for i, f in enumerate(fps)]
    monkeypatch.setattr(simhash, "TILE", 8)
    df = spark.createDataFrame(rows, "doc_id long, fp binary, low int, high int")
    got = {r.doc_id: r.component_id for r in simhash.component_ids(df).collect()}
    assert got == brute_components(list(enumerate(fps)))


def test_near_duplicates_keep_one(spark, documents):
    rng = random.Random(11)
    text, other = words(rng, 400, 5000), words(rng, 400, 5000)
    near = text.split()
    near[100] = "new"
    docs = documents((5, text), (3, " ".join(near)), (9, text), (4, other), (None, text), (6, None))
    kept = sorted(str(r.doc_id) for r in simhash.deduplicated(docs).collect())
    assert kept == ["3", "4", "6", "None"]
    assert simhash.deduplicated(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- leaks

def brute_leaks(texts, items):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for d, t in enumerate(texts):
        have = grams(cut(t))
        for k, item in enumerate(items):
            asked = collections.Counter(grams(cut(item)))
            m = asked.total()
            if not m or not have:
                continue
            w = min(m, len(have))
            best = max(
                (lambda n: n / (m + w - n))((collections.Counter(have[i : i + w]) & asked).total())
                for i in range(len(have) - w + 1)
            )
            if best >= 0.8:
                out[d, k] = round(best, 9)
    return out


def test_leaks_against_brute_force(spark, documents):
    rng = random.Random(13)
    items = [words(rng, n, 3000) for n in (15, 22, 40, 60, 60)] + ["only four words here", None, "a b a b a b a b a b"]
    around = lambda x: f"{words(rng, 80, 3000)}. {x}! {words(rng, 70, 3000)}"
    one_off = items[3].split()
    one_off[30] = "changed"
    two_off = items[4].split()
    two_off[10] = two_off[30] = two_off[50] = "changed"
    texts = [around(i or "") for i in items]
    texts += [
        items[2].upper(), items[3][: int(len(items[3]) * 0.9)], around(" ".join(one_off)), around(" ".join(two_off)),
        None, "", words(rng, 500, 3000), items[0] + " " + items[1], around(" ".join(items[3].split()[:-3])),
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.leaks(documents(*enumerate(texts)), bench).collect()}
    want = brute_leaks(texts, items)
    assert got == want and len(want) >= 10


def test_near_values_cover_the_radius():
    masks = {sum(1 << b for b in c) for r in range(4) for c in decontam.combinations(range(16), r)}
    assert len(masks) == 697 and decontam.RADIUS == 31


def test_decontaminated_keeps_clean_rows(spark, documents):
    rng = random.Random(17)
    item = words(rng, 30, 3000)
    bench = spark.createDataFrame([(1, item), (None, item)], "item_id long, text string")
    docs = documents((1, item), (None, item), (None, "clean text"), (2, None)).withColumn("window", F.lit(1))
    assert sorted(str(r.text) for r in decontam.decontaminated(docs, bench).collect()) == ["None", "clean text"]
    assert decontam.decontaminated(docs, bench.limit(0)).count() == 4
    assert decontam.leaks(docs.limit(0), bench).count() == 0
