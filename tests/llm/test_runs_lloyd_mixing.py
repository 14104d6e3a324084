"""Periodic runs, dual-tree Lloyd and Pareto mixing against brute force."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionsift.llm import lloyd, mixing, periodic_runs


def plain_runs(words, least=24, repeats=3):
    """All maximal stretches of smallest period q, by definition."""
    n, seen = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                seen.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in seen.items())


def texts(seed=5):
    r = random.Random(seed)
    out = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a " * 500, "a b c " * 8, "x a b c " * 2 + "a b c " * 7 + "a b y"]
    for _ in range(150):
        ws = []
        while len(ws) < r.randint(10, 200):
            unit = [r.choice("abc") for _ in range(r.randint(1, 12))]
            ws += unit * r.choice([1, 1, 2, 3, 5, 9])
        out.append("  ".join(ws))
    long = [str(r.randint(0, 50)) for _ in range(4000)]
    out.append(" ".join(long[:1000] + long[1000:1700] * 4 + long))  # a lag of 700, looked at on its grid first
    return out


def test_runs(spark):
    rows = [(i, t, i % 3) for i, t in enumerate(texts())] + [(7, "a " * 30, 0)] * 2 + [(None, "b " * 30, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS int").repartition(3)
    got = periodic_runs.with_runs(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "n_words", "runs", "collapsed"}
    for r in got:
        words = (r.text or "").split()
        want = plain_runs(words) if len(words) < 1000 else [(1000, 2800, 700)] if len(words) > 5000 else None
        runs = [tuple(x) for x in r.runs]
        if want is not None and len(words) < 1000:
            assert runs == want, r.text
        elif want:
            assert [x for x in runs if x[2] == 700] == want
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r.n_words == len(words) and r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0
    best = periodic_runs.with_runs(docs).select("runs", periodic_runs.strongest(F.col("runs")).alias("b"), periodic_runs.as_lines(F.col("runs")).alias("t")).collect()
    for r in best:
        want = min(r.runs, key=lambda x: (-Fraction(x.length, x.period), x.start, x.period), default=None)
        assert r.b == want and r.t == "".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs)


def test_runs_settings():
    ids = np.array([0, 1] * 5 + [2])
    assert periodic_runs.find_runs(ids, periodic_runs.Runs(4, 2)) == [(0, 10, 2)]
    with pytest.raises(ValueError):
        periodic_runs.Runs(1, 3)


def plain_lloyd(rows, k=8, rounds=10):
    """rows: (id, integer vector)"""
    start = sorted((r for r in rows if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), list(r[1])))[:k]
    c = [list(map(int, r[1])) for r in start]
    x = [list(map(int, r[1])) for r in rows]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for v in x]
        c = [[sum(col) // own.count(j) for col in zip(*[v for v, o in zip(x, own) if o == j])] if j in own else m for j, m in enumerate(c)]
    last = [near(v) for v in x]
    return [(r[0], j, d) for r, (d, j) in zip(rows, last)], c


@pytest.mark.parametrize("kind", ["spread", "clumps", "copies"])
def test_lloyd(spark, kind):
    r = np.random.default_rng(7)
    n, dim = 90, 6
    v = {"spread": r.normal(size=(n, dim)), "clumps": r.normal(size=(5, dim))[r.integers(0, 5, n)] + 0.01 * r.normal(size=(n, dim)), "copies": np.repeat(r.integers(-1, 2, (2, dim)), n // 2, 0) * 1.0}[kind]
    rows = [(int(i) if i else None, x.tolist()) for i, x in enumerate(v)] + [(3, v[3].tolist())] * 2
    bad = [(500, None), (501, []), (502, [1.0] * (dim + 1)), (503, [1.0] * (dim - 1) + [None]), (504, [float("nan")] * dim), (505, [float("inf")] * dim), (506, [1e300] * dim)]
    how = lloyd.Lloyd(dim=dim, block=32, leaf=4)
    df = spark.createDataFrame([(*x, "z") for x in rows + bad], "vec_id long, embedding array<double>, cluster string").repartition(2)
    got = lloyd.cluster(df, how).collect()
    want, c = plain_lloyd([(i, np.floor(1024 * np.array(x)).astype(int)) for i, x in rows])
    assert sorted((x.vec_id or -1, x.cluster, x.distance) for x in got) == sorted((i or -1, j, d) for i, j, d in want)
    for x in got:
        assert x.inertia == sum(d for *_, d in want) and x.cluster_inertia == sum(d for _, j, d in want if j == x.cluster)
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, c[x.cluster])).encode()).hexdigest()


def test_lloyd_edges(spark):
    df = spark.createDataFrame([(1, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert lloyd.cluster(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not lloyd.cluster(df.limit(0)).count()
    assert [(r.cluster, r.distance, r.inertia) for r in lloyd.cluster(df).collect()] == [(0, 0, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_dual_tree(seed):
    """The tree of each block holds, and no nearest centroid is pruned, far apart, equal or tied."""
    r = np.random.default_rng(seed)
    for n, dim, k in ((1, 1, 1), (700, 2, 30), (500, 64, 9), (300, 8, 40)):
        x = [r.integers(-900, 900, (n, dim)), r.integers(-4, 4, (n, dim)), np.repeat(r.integers(-3, 3, (1, dim)), n, 0), r.integers(-(2**27), 2**27, (n, dim))][seed]
        c = x[r.integers(0, n, k)] + r.integers(-1, 2, (k, dim))
        tree = lloyd.cover_tree(x, 8)
        y = x[tree.order]
        for (begin, end, first, last), radius in zip(tree.nodes, tree.radius):
            assert ((y[begin:end] - y[begin]) ** 2).sum(1).max() <= radius**2 * (1 + 1e-9) + 1e-6
            if last > first:
                assert tree.nodes[first, 0] == begin and tree.nodes[last - 1, 1] == end and (tree.radius[first:last] <= radius / 2 * (1 + 1e-9)).all()
        distinct, number, over = lloyd._over(c)
        assert (number[lloyd.nearest(y, tree, distinct, over)] == ((y[:, None, :] - c[None]) ** 2).sum(2).argmin(1)).all()


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """sizes in source order"""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full = set()
    while True:
        left, open_ = sum(sizes) - most * sum(sizes[i] for i in full), sum(w[i] for i in range(len(w)) if i not in full)
        more = {i for i in range(len(w)) if i not in full and Fraction(left * w[i], open_) > most * sizes[i]}
        if not more:
            return [most * s if i in full else left * w[i] / open_ for i, s in enumerate(sizes)]
        full |= more


def corpus(seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(0.9) * 20)), r.choice(["a", "B", "é", None, "c", "c", "c", "c", "c"])) for i in range(600)]
    return rows + [(1, rows[1][1], rows[1][2]), (None, "p q r", "a"), (None, "p q", "a"), (700, None, "c"), (701, "", "only empty"), (702, "x y", "tiny")]


def test_mixing(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, taken int")
    got = mixing.mix(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    order = sorted({x[2] for x in rows if x[2] is not None}, key=str.encode) + [None]
    words = {s: sum(len((t or "").split()) for _, t, o in rows if o == s) for s in order}
    target = dict(zip(order, plain_targets([words[s] for s in order])))
    of = {i: s for i, _, s in rows if i is not None}
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = of[r.doc_id] if r.doc_id is not None else "a"
        assert r.source_size == words[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in order:
        largest = max(len((t or "").split()) for _, t, o in rows if o == s)
        assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s], largest / 2), (s, taken[s], target[s])
    # certain copies: each document has the whole part of its expected copies or one more
    for r in got:
        if r.size:
            assert r.copies - int(r.target / r.source_size) in (0, 1)


def test_mixing_probabilities(spark):
    """Over seeds, a document is taken as often as it should be: inclusion is fair within and across classes of sizes."""
    rows = [(i, "w " * (4 + i % 9), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = np.zeros(400)
    for seed in range(6):
        for r in mixing.mix(docs, mixing.Mix((3, 1), seed=seed)).collect():
            total[r.doc_id] += r.copies
    assert abs(total[::2].mean() / 6 - 1.5) < 0.02 and abs(total[1::2].mean() / 6 - 0.5) < 0.02
    assert 1.0 < total[1::2].std() < 1.5  # not always the same ones: about as six throws of a coin


def test_mixing_weights(spark):
    """Unequal wishes: copies follow the weights, capped ones pass their excess on, the target is still met."""
    rows = [(i, "w " * 10, "a" if i < 400 else "b", [0.0, 1.0, 2.0, 50.0][i % 4] if i < 396 else None) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, wish double")
    got = {r.doc_id: r for r in mixing.mix(docs, mixing.Mix((1, 1)), "wish").collect()}
    mean = [np.mean([got[i].copies for i in range(k, 396, 4)]) for k in range(4)]
    # 297 copies of the capped ones; 103 more are shared by weights 1 and 2, 99 documents each
    share = (400 - 297) / (99 + 2 * 99)
    assert mean[0] == 0 and mean[3] == 3 and abs(mean[1] - share) < 0.1 and abs(mean[2] - 2 * share) < 0.1
    assert abs(sum(got[i].taken for i in range(400)) - got[0].target) <= 10
    assert max(r.copies for r in got.values()) == 3
    assert all(r.copies == 0 for i, r in got.items() if i >= 396)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [tuple(r) for r in mixing.mix(docs).collect()] == [(1, 0, 0, 0.0, 0, 0)]
