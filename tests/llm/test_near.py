"""Near-duplicates against exact similarities of all pairs."""

import random

from promptledger.llm import near, simhash


def shingles(text, size=5):
    parts = (text or "").lower().split()
    size = min(size, len(parts))
    return frozenset(tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)) if parts else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def text_of(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def pair(rng, n, least, most):
    """Two texts with a similarity between the bounds."""
    a = text_of(rng, n)
    while True:
        b = list(a)
        for _ in range(rng.randrange(1, 9)):
            b[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        if least <= similarity(shingles(" ".join(a)), shingles(" ".join(b))) <= most:
            return [" ".join(a), " ".join(b)]


def near_rows():
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        texts += pair(rng, 120, 0.80, 0.83) + pair(rng, 120, 0.66, 0.72)
    for _ in range(60):
        texts += [" ".join(text_of(rng, 6))]
    for _ in range(30):
        six = text_of(rng, 6)
        texts += [" ".join(six), " ".join([*six[:5], "other"])]
    # 4 of 5 shingles; repeats, which count once; a chain; a passage that most texts hold.
    nine = text_of(rng, 9)
    texts += [" ".join(nine), " ".join(nine[:8])]
    five = text_of(rng, 5)
    texts += [" ".join(five * 2), " ".join(five * 40)]
    long = text_of(rng, 200)
    texts += [" ".join(long[4 * i :]) for i in range(30)]
    passage = text_of(rng, 40)
    texts += [" ".join(text_of(rng, 30) + passage) for _ in range(60)]
    texts += ["One two", "one TWO", "two one", "", " ", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_are_those_of_exact_similarity(spark, documents, monkeypatch):
    rows, docs = near_rows(), None
    docs = documents(*rows).select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in near.groups(docs).collect()}
    assert got == brute_groups(rows)
    monkeypatch.setattr(near, "ROUNDS", 0)
    monkeypatch.setattr(near, "COMMON", 10**9)
    assert {r.doc_id: r.component_id for r in near.groups(docs).collect()} == got


def test_only_near_duplicates_are_deleted(spark, documents):
    rows = near_rows()
    roots = brute_groups(rows)
    kept = {r.doc_id for r in simhash.deduplicated(documents(*rows)).collect()}
    assert kept == {i for i, _ in rows if roots[i] == i}


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, documents, monkeypatch):
    rng = random.Random(6)
    base, rows = text_of(rng, 200), []
    for i in range(300):
        text = list(base)
        text[rng.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(text)))
    made = []
    plain = near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, sets: made.append(pairs.count()) or plain(pairs, sets))
    got = near.groups(documents(*rows).select("doc_id", "text")).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(made) < 10 * len(rows)


def test_big_buckets_in_tiles_give_the_same_groups(spark, documents, monkeypatch):
    rng = random.Random(7)
    rows = near_rows()
    base = text_of(rng, 150)
    for i in range(120):  # copies with more and more words replaced: some alike, some not
        text = list(base)
        for _ in range(rng.randrange(9)):
            text[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((1_000 + i, " ".join(text)))
    monkeypatch.setattr(near, "BIG", 8)
    monkeypatch.setattr(near, "TILE", 2_000)
    monkeypatch.setattr(near, "COLUMNS", 64)
    docs = documents(*rows).select("doc_id", "text")
    assert {r.doc_id: r.component_id for r in near.groups(docs).collect()} == brute_groups(rows)


def test_fingerprints_come_first_and_prefixes_add_what_they_miss(spark, documents, monkeypatch):
    rng = random.Random(8)
    base, rows = text_of(rng, 3000), []
    for i in range(40):  # one word of 3,000 replaced: fingerprints mostly within the radius
        text = list(base)
        text[rng.randrange(3000)] = f"y{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, t) for i, t in enumerate(t for _ in range(10) for t in pair(rng, 120, 0.80, 0.83))]
    asked, plain = [], near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, texts: asked.append(pairs.count()) or plain(pairs, texts))
    found, links = [], near.fingerprint_links
    monkeypatch.setattr(near, "fingerprint_links", lambda firsts: found.append(links(firsts).count()) or links(firsts))
    docs = documents(*rows).select("doc_id", "text")
    assert {r.doc_id: r.component_id for r in near.groups(docs).collect()} == brute_groups(rows)
    assert found[0] >= 20 and 20 <= asked[0] < len(rows) and sum(asked) < 4 * len(rows)


def test_documents_of_one_passage_make_no_pairs(spark, documents, monkeypatch):
    rng = random.Random(9)
    passage = text_of(rng, 40)
    rows = [(i, " ".join(text_of(rng, 60) + passage)) for i in range(60)]
    met, plain = [], near._survivors
    monkeypatch.setattr(near, "_survivors", lambda pairs, nodes: met.append(pairs.count()) or plain(pairs, nodes))
    got = near.groups(documents(*rows).select("doc_id", "text")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows}
    assert sum(met) < 4 * len(rows)


def test_texts_that_are_not_quite_similar_make_few_pairs(spark, documents, monkeypatch):
    rng = random.Random(10)
    made, plain = [], near._survivors
    monkeypatch.setattr(near, "_survivors", lambda pairs, nodes: made.append(pairs.count()) or plain(pairs, nodes))
    base = text_of(rng, 200)
    for m in (30, 120):  # four words of 200 replaced: most pairs are under the similarity asked for
        rows = []
        for i in range(m):
            text = list(base)
            for _ in range(4):
                text[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
            rows.append((i, " ".join(text)))
        expected = brute_groups(rows)
        assert len(set(expected.values())) > m / 3
        made.clear()
        got = near.groups(documents(*rows).select("doc_id", "text")).collect()
        assert {r.doc_id: r.component_id for r in got} == expected
        assert sum(made) < 8 * 40 * m / 4  # 40 prefix shingles a text
