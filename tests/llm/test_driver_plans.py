"""What the driver holds: plans that stay small, and no more of them than are needed."""

import random

from promptledger.llm import decontam, near, simhash


def written(monkeypatch, module):
    names, plain = [], module.staged

    def staged(df, name):
        names.append(name)
        return plain(df, name)

    monkeypatch.setattr(module, "staged", staged)
    return names


def test_stars_take_no_round(spark, monkeypatch):
    names = written(monkeypatch, simhash)
    links = spark.createDataFrame([(1, 5), (7, 1), (1, 5), (2, 3), (4, 4)], "a long, b long")
    assert sorted(map(tuple, simhash.components(links).collect())) == [(3, 2), (5, 1), (7, 1)]
    assert names == ["links"]
    assert simhash.components(links.limit(0)).count() == 0


def test_components_of_chains_and_random_links(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(9, 5), (9, 2), (-4, 9)]
    pairs += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(map(tuple, simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root if find(x) != x}


def test_texts_without_near_copies_take_no_round(spark, documents, monkeypatch):
    rng = random.Random(8)
    docs = documents(*((i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(20)))
    names = written(monkeypatch, simhash)
    assert sorted(r.component_id for r in near.groups(docs.select("doc_id", "text")).collect()) == list(range(20))
    assert "links-least" not in names


def test_plan_of_leaks_is_small(spark, documents):
    rng = random.Random(4)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    leaks = decontam.leaks(documents((1, item), (2, "clean")), bench)
    assert [r.doc_id for r in leaks.collect()] == [1]
    # 36,000 characters when the fingerprints' bits were one nested expression of 128 cases.
    assert len(leaks._jdf.queryExecution().optimizedPlan().toString()) < 10_000
