"""Lattice hashing against brute force."""

import numpy as np
from pyspark.sql import functions as F

from ionsift.llm import embedding_dedup as ed


def brute(ids, vectors, cosine):
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i in ids if i is not None}, {i: i for i in ids if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, i in enumerate(ok):
        for j in ok[:k]:
            a, b = np.array(vectors[i], float), np.array(vectors[j], float)
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[ids[i]] += 1
                links[ids[j]] += 1
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return {i: (links[i], find(i)) for i in links}


def test_lattice_point():
    y = np.random.default_rng(1).normal(size=(300, 8)) * 2
    c = ed.decode_e8(y)
    assert (((c * 2) % 1) == 0).all() and (np.abs(c.sum(1) % 2) < 1e-9).all()
    best = np.min([((y - (c + v)) ** 2).sum(1) for v in ed.NEAR], axis=0)
    assert len(ed.NEAR) == 240 and (((y - c) ** 2).sum(1) <= best + 1e-9).all()


def test_links(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(120, 16))
    vectors = [list(map(float, x)) for x in base]
    for i in range(160):
        vectors.append(list(map(float, base[i % 40] + r.normal(size=16) * 0.08)))
    vectors += [vectors[0]] * 30 + [[2.0 * x for x in vectors[1]]]
    vectors += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    ids = list(range(1000, 1000 + len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors, [7] * len(ids))), "vec_id long, embedding array<double>, rep int").repartition(5)
    want = brute(ids, vectors, 0.95)
    for how in (ed.Lattice(), ed.Lattice(block_rows=8, tables=10)):
        got = {x.vec_id: (x.n_links, x.component_id) for x in ed.link(df, how=how).collect()}
        assert got.keys() == want.keys()
        found, truth = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
        assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.99 * truth
        if found == truth:
            assert got == want
    assert ed.link(df.limit(0)).count() == 0


def test_null_id_and_repeats(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.001])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in ed.link(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert df.select(F.count("vec_id")).first()[0] == 3


def test_threshold_itself():
    """Pairs at the threshold by the exact sum count, whatever block product finds them."""
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 24))
    x[300:] = x[:300] + 0.2 * r.normal(size=(300, 24))
    x /= np.sqrt((x * x).sum(1))[:, None]
    exact = np.einsum("ij,ij->i", x[:300], x[300:])
    block = np.diag(x[:300] @ x[300:].T)
    assert (np.abs(block - exact) < ed.SLACK / 1000).all()
