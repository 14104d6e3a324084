"""Leaks against brute force, and recall under edits."""

import random

import numpy as np
from pyspark.sql import functions as F

from ionsift.llm import decontaminate as dc


def edits(item, text):
    """Plain dynamic programme with free ends in the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_least_edits():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = r.integers(0, 4, r.integers(1, 90)).astype(np.uint64), r.integers(0, 4, r.integers(0, 60)).astype(np.uint64)
        assert dc.least_edits(a, b) == edits(a.tolist(), b.tolist())


def test_leaks(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 6, 12, 30, 45])))) for i in range(40)] + [(40, None), (41, ""), (None, "a b c"), (0, "dup item words here")]
    docs, planted = [], set()
    for d in range(300):
        w = [word() for _ in range(r.randint(20, 200))]
        if d % 2:
            i, t = r.choice([x for x in items[:40] if len(x[1].split()) >= 12])
            t = t.split()
            for _ in range(r.choice([0, 0, 1, 2, len(t) // 10])):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], [word()], [t[k], word()]])
            at = r.randrange(len(w))
            w[at:at] = [x.upper() for x in t]
            planted.add((d, i))
        docs.append((d, " \n".join(w)))
    df = spark.createDataFrame([*docs, (None, "x"), (900, None), (901, ""), docs[1]], "doc_id long, text string").withColumn("item_id", F.lit(1)).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in dc.leaks(df, bench).collect()}
    truth = {}
    for d, t in docs:
        words = t.lower().split()
        for i, item in items:
            w = (item or "").lower().split()
            if i is not None and len(w) >= 12 and (n := edits(w, words)) <= int(0.2 * len(w) + 1e-9):
                truth[d, i] = min(n, truth.get((d, i), 99))
    assert planted <= truth.keys()
    long = {k: v for k, v in got.items() if len(items[k[1]][1].split()) >= 12}
    assert long.keys() <= truth.keys() and all(long[k] >= truth[k] for k in long)
    assert len(long) >= 0.95 * len(truth) and {k for k in truth if truth[k] == 0} <= long.keys()
    assert {x.doc_id for x in dc.decontaminate(df, bench).where("doc_id < 300").select("doc_id").collect()}.isdisjoint({d for d, _ in got})
    assert dc.leaks(df.limit(0), bench).count() == 0 and dc.leaks(df, bench.limit(0)).count() == 0
    blocks = {(x.doc_id, x.item_id): x.edits for x in dc.leaks(df, bench, dc.Walks(block=7)).collect()}
    assert blocks == got


def edited(item, spots, fresh):
    """The item with a replacement, a removal or an insertion at each spot, in turn."""
    out = []
    for i, w in enumerate(item):
        kind = spots.get(i)
        out += [w] if kind is None else [[fresh()], [], [w, fresh()]][kind]
    return out


def test_each_place_of_an_edit(spark):
    """One edit at each word, the first and the last included, for items of 5 to 60 words."""
    names = iter(range(10**9))
    fresh = lambda: f"f{next(names)}"
    items, docs, planted = [], [], set()
    for m in range(5, 61):
        item = [f"i{m}x{k}" for k in range(m)]
        items.append((m, " ".join(item)))
        for at in range(m):
            for kind in range(3):
                planted.add((len(docs), m))
                docs.append((len(docs), " ".join([fresh(), fresh(), *edited(item, {at: kind}, fresh), fresh()])))
    got = {(x.doc_id, x.item_id): x.edits for x in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == planted and set(got.values()) <= {0, 1}


def test_recall_at_all_allowed_edits(spark):
    """Items of 5 to 60 words with as many edits as are allowed, each length at least 0.9; the least edits agree with brute force."""
    r = random.Random(9)
    names = iter(range(10**9))
    fresh = lambda: f"f{next(names)}"
    items, docs = [], []
    for m in range(5, 61):
        for _ in range(20):
            i = len(docs)
            item = [f"i{i}x{k}" for k in range(m)]
            items.append((i, " ".join(item)))
            spots = {k: r.randrange(3) for k in r.sample(range(m), m // 5)}
            docs.append((i, " ".join([fresh(), fresh(), *edited(item, spots, fresh), fresh()])))
    got = {(x.doc_id, x.item_id): x.edits for x in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for m in range(5, 61):
        assert sum((i, i) in got for i in range(20 * (m - 5), 20 * (m - 4))) >= 18, m
    assert all(d == i and n == edits(items[i][1].split(), docs[d][1].split()) for (d, i), n in got.items())


def test_all_pairs_of_a_small_vocabulary(spark):
    """Repeated words and short items: the pairs and their edits are those of brute force."""
    r = random.Random(10)
    text = lambda n: " ".join(r.choice("abcdefghij") for _ in range(n))
    items, docs = [(i, text(i % 24 + 1)) for i in range(72)], [(d, text(r.randint(0, 60))) for d in range(120)]
    truth = {(d, i): n for d, t in docs for i, x in items if t and (n := edits(x.split(), t.split())) <= int(0.2 * len(x.split()) + 1e-9)}
    got = {(x.doc_id, x.item_id): x.edits for x in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == truth


def test_blocks_are_bounded_by_bytes(spark):
    how = dc.Walks(block=5, block_bytes=300)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate([1, 1, 1, 1, 1, 1, 200, 20, 20, 20, 20, 1])]
    made = list(dc.blocks(iter(items), how))
    assert [x for b in made for x in b] == items and len(made) > 3
    assert all(len(b) <= 5 and (len(b) == 1 or sum(len(t) for _, t in b) <= 300) for b in made)
    df = spark.createDataFrame([(9, items[6][1] + " " + items[8][1])], "doc_id long, text string")
    got = dc.leaks(df, spark.createDataFrame(items, "item_id long, text string"), how).collect()
    assert sorted((x.doc_id, x.item_id, x.edits) for x in got) == [(9, 6, 0), (9, 8, 0)]
