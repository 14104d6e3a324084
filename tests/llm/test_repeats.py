"""Word and byte repeats against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionsift.llm import seeds, substring_dedup, suffix_dedup


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "cc", "é", "the", "of", "wörd", "x" * 30, "lorem", "ipsum", "dolor"])
    shared = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(6)]
    out = []
    for i in range(n):
        k = r.random()
        if k < 0.1 and out:
            out.append(r.choice(out))
        elif k < 0.2:
            out.append(r.choice([None, "", " ", "a" * 400, "ab" * 300, "a " * 200]))
        else:
            out.append("\n".join(r.choice(shared) if r.random() < 0.5 else " \t".join(word() for _ in range(r.randint(1, 80))) for _ in range(r.randint(1, 4))))
    return list(enumerate(out))


def brute(rows, units, size):
    low = {}
    cut = {i: units(t) for i, t in rows}
    for i, u in cut.items():
        for s in range(len(u) - size + 1):
            g = tuple(u[s : s + size])
            low[g] = min(low.get(g, i), i)
    out = {}
    for i, u in cut.items():
        gone = [False] * len(u)
        for s in range(len(u) - size + 1):
            if low[tuple(u[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        out[i] = (u, gone)
    return out


@pytest.mark.parametrize("seed,gram,size", [(1, 4, 13), (2, 2, 5)])
def test_words(spark, seed, gram, size):
    rows = corpus(seed)
    want = brute(rows, lambda t: (t or "").encode().split(), size)
    df = spark.createDataFrame(rows + rows[:3] + [(None, rows[0][1])], "doc_id long, text string").withColumn("start", F.lit("x")).repartition(5)
    got = substring_dedup.dedup(df, gram, size).collect()
    few = substring_dedup.repeats(df.drop("start"), gram, size, 16)
    gone = {i: [False] * len(u) for i, (u, _) in want.items()}
    for r in few.collect():
        for s in range(r.start, r.start + r.n):
            gone[r.doc][s : s + size] = [True] * size
    assert {i: g for i, (_, g) in want.items()} == gone
    assert len(got) == len(rows) + 4
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        u, gone = want[r.doc_id]
        kept = b" ".join(w for w, g in zip(u, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept) == (len(u), sum(gone), kept.decode()) and r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert substring_dedup.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed,gram,size,most", [(3, 16, 50, 1 << 15), (4, 4, 12, 16)])
def test_bytes(spark, monkeypatch, seed, gram, size, most):
    rows = corpus(seed)
    want = brute(rows, lambda t: (t or "").encode(), size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_dedup.repeats(df, gram, size, most)
    gone = {i: [False] * len(u) for i, (u, _) in want.items()}
    for r in found.collect():
        for s in range(r.start, r.start + r.n):
            gone[r.doc][s : s + size] = [True] * size
    assert {i: g for i, (_, g) in want.items()} == gone
    if most > 64:
        for r in suffix_dedup.dedup(df, gram, size).collect():
            u, g = want[r.doc_id]
            kept = bytes(b for b, x in zip(u, g) if not x)
            spans = sum(1 for i, x in enumerate(g) if x and (not i or not g[i - 1]))
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept) == (len(u), sum(g), spans, kept)
        assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_suffix_sort():
    r = np.random.default_rng(5)
    for n, k in ((300, 2), (500, 1), (1000, 3)):
        data = r.integers(97, 97 + k, n).astype(np.uint8)
        bounds = np.array([0, n // 3, n // 2, n])
        ends = np.repeat(bounds[1:], np.diff(bounds))
        at = np.arange(n)
        got = suffix_dedup.sort_suffixes(data, ends, at)
        raw = data.tobytes()
        keys = [raw[a : ends[a]] for a in got]
        assert keys == sorted(keys) and sorted(got) == list(range(n))


def test_hashes():
    x = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    p = seeds.Prefix(x)
    assert p.of(np.array([3]), np.array([4900]))[0] == seeds.Prefix(x[3:4900]).of(np.array([0]), np.array([4897]))[0]
    prime, base = 2**61 - 1, seeds.BASE1 % (2**61 - 1)
    assert int(p.of(np.array([5]), np.array([90]))[0]) == sum((int(x[5 + i]) + 1) * pow(base, i, prime) for i in range(85)) % prime
    assert [int(v) for v in seeds.sliding_min(np.array([5, 3, 4, 9, 1, 7]), 3)] == [3, 3, 1, 1]
    for k in (3, 8, 12, 16, 30):
        g = seeds.byte_grams(np.r_[x, x], k)
        assert len(g) == 2 * len(x) - k + 1 and (g[: len(x) - k + 1] == g[len(x) :]).all() and len(np.unique(g[: len(x) - k + 1])) > (len(x) - k) * (0.99 if k > 3 else 0.9)


@pytest.mark.parametrize("n", [256, 1024, 4096])
def test_thue_morse(spark, n):
    """Two words that every polynomial hash modulo 2**64 confuses are two words; so are their bytes."""
    t = [bin(i).count("1") % 2 for i in range(n)]
    a, b = "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)
    rest = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(df).collect()} == {1: 0, 2: 0, 3: 13}


def test_texts_over_a_chunk(spark):
    """Texts longer than what a task hashes at once; the repeat lies across the border."""
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}" for _ in range(160_000)]
    text, rest = " ".join(words), " ".join(words[130_000:])
    assert len(text) > seeds.CHUNK
    df = spark.createDataFrame([(1, text), (2, "x y " + rest), (3, "z" * (seeds.CHUNK + 100))], "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in substring_dedup.dedup(df).collect()} == {1: 0, 2: 30_000, 3: 0}
    assert {x.doc_id: x.n_removed for x in suffix_dedup.dedup(df).collect()} == {1: 0, 2: len(rest) + 1, 3: 0}
