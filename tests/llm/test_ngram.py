"""Jaccard join against brute force."""

import random

import numpy as np

from ionsift.llm import ngram_join


def brute(rows, percent, k):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=260):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") * r.randint(0, 3)
    line = "Licensed under the one true license of all"
    out = []
    for i in range(n):
        k = r.random()
        if out and k < 0.55:
            w = (r.choice(out) or "x").split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w) if k > 0.1 else " ".join(w).upper())
        elif k < 0.65:
            out.append(r.choice([None, "", "a", "a b", "A b", "a b c d", "x " * 500]))
        else:
            out.append(line + " " + " ".join(word() for _ in range(r.randint(1, 150))))
    return list(enumerate(out, 10))


def test_components(spark):
    for seed, percent, k in ((1, 85, 4), (2, 60, 2)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows + rows[:2] + [(None, "a b c d")], "doc_id long, text string").repartition(4)
        got = [(r.doc_id, (r.n_shingles, r.component_id)) for r in ngram_join.link(df, percent, k).collect()]
        assert len(got) == len(rows) + 3
        assert dict(g for g in got if g[0] is not None) == brute(rows, percent, k)
    assert ngram_join.link(df.limit(0)).count() == 0


def test_edges_of_the_threshold(spark):
    """Pairs at 85 of 100 exactly, just below it, and long words that polynomial hashes modulo 2**64 confuse."""
    words = [f"w{i}" for i in range(300)]
    # one-word shingles, so that sizes are exact: 85 shared of 100, 84 shared of 100, and 17 of 20
    rows = [(1, " ".join(words[:85])), (2, " ".join(words[:100])), (3, " ".join(f"x{w}" for w in words[:84])), (4, " ".join(f"x{w}" for w in words[:100])), (5, " ".join(f"y{w}" for w in words[:17])), (6, " ".join(f"y{w}" for w in words[:20]))]
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 85, 1).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    t, u = thue_morse(1024)
    rest = " ".join(words[:12])
    rows = [(1, f"{t} {rest}"), (2, f"{u} {rest}")]
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}


def thue_morse(n):
    t = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


def test_large_groups(spark):
    """Near copies in several blocks: a large component, single documents beside it, and a second group of copies only."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(420):
        w = list(base)
        for _ in range(r.choice([1, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    other = [f"c{i}" for i in range(40)]
    for i in range(420, 560):  # pairwise just under the threshold, but for a few
        w = list(other)
        for j in range(2 if i % 9 else 0):
            w[(7 * i + 19 * j) % 40] = f"m{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for percent, k in ((85, 4), (90, 1)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link(df, percent, k).collect()}
        assert got == brute(rows, percent, k)


def test_long_texts(spark):
    """Texts over the size that tasks hash at once, and odd columns beside them."""
    r = random.Random(4)
    words = [f"word{r.randrange(10**5)}" for _ in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:70_000], "x", *words[70_000:]])), (3, " ".join(words[:100_000])), (4, None)]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, shingles string, g int")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link(df).collect()}
    assert got == brute(rows, 85, 4) and got[2][1] == 1 and got[3][1] == 3


def test_tree():
    r = np.random.default_rng(2)
    counts = r.poisson(3, (300, 64))
    counts[150:] = np.maximum(0, counts[:150] + r.integers(-1, 2, (150, 64)))
    n = counts.sum(1)
    q, p = ngram_join.CountTree(counts, n).search(counts, n, 85)
    over = np.minimum(counts[:, None], counts[None]).sum(2)
    want = set(zip(*np.nonzero(185 * over >= 85 * (n[:, None] + n[None]))))
    assert want == set(zip(q.tolist(), p.tolist()))
