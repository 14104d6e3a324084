"""Fits the boosted trees of ``pii.py`` with Spark ML: ``python -m ionsift.llm.pii_train``.

The labelled candidates are synthetic (``PER_KIND`` of each kind and label, seeded); four fifths fit the trees, the
rest calibrates each kind's threshold: the lowest one above which the share of positives is ``PRECISION``, 0 at least.
"""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionsift.llm import pii

PER_KIND, SEED, DEPTH, ROUNDS, STEP, PRECISION = 400, 7, 4, 24, 0.3, 0.98
#: How far below a score a threshold stands, so that the order of a sum's terms doesn't matter.
MARGIN = 1e-6


def candidates(seed: int = SEED, n: int = PER_KIND) -> list[tuple[str, str, str, str, int]]:
    """(kind, span, before, after, label)"""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvy") for _ in range(r.randint(3, 9)))
    prose = lambda: " ".join(word() for _ in range(5)) + " "
    cue = {"email": ["e-mail: ", "contact me at ", "write to ", "mail "], "ip": ["ip ", "host ", "server addr ", "client "], "card": ["card ", "visa: ", "credit card no ", "payment by card "], "phone": ["call ", "tel. ", "phone: ", "mobile ", "fax "]}
    off = ["order no ", "invoice ", "version ", "page ", "ref ", "total ", "section ", "id: "]

    def check(digits: str) -> str:
        for d in "0123456789":
            x = digits + d
            if sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(x))) % 10 == 0:
                return x
        raise AssertionError

    def positive(kind: str) -> str:
        if kind == "email":
            o, c = r.choice(["()", "[]", "{}"])
            dot = r.choice([f" {o}dot{c} ", f"{o}dot{c}", "."])
            top = r.choice(["com", "org", "net", "de", "fr", "io", "co.uk", "info"])
            if r.random() < 0.3:
                return f"{word()}{r.choice([' @ ', ' @', '@ '])}{word()}{r.choice(['.', ' . '])}{top}"
            if r.random() < 0.2:
                return f"{word()} at {word()} dot {top}"
            return f"{word()}{r.choice([' ', ''])}{o}at{c}{r.choice([' ', ''])}{word()}{dot}{top}"
        if kind == "ip":
            if r.random() < 0.4:
                return r.choice(["[.]", "(.)", "[dot]", " [.] "]).join(str(r.randint(0, 255)) for _ in range(4))
            parts = [f"{r.getrandbits(16):x}" for _ in range(8)]
            if r.random() < 0.4:
                b = r.randint(1, 4)
                parts[b : b + r.randint(1, 3)] = [""]
            return ":".join(parts)
        if kind == "card":
            if r.random() < 0.25:
                x, s = check(r.choice(["34", "37"]) + num(12)), r.choice(["  ", ".", "/", " - "])
                return s.join((x[:4], x[4:10], x[10:]))
            x, s = check(num(15)), r.choice(["  ", ".", "/", " - "])
            return s.join((x[:4], x[4:8], x[8:12], x[12:]))
        s = r.choice(["-", ".", " "])
        if r.random() < 0.25:
            return f"00{r.randint(1, 99)}{s}{num(3)}{s}{num(4)}{s}{num(3)}"
        return r.choice([f"({num(3)}) {num(3)}{s}{num(4)}", f"{num(3)}{s}{num(3)}{s}{num(4)}", f"0{num(2)}{s}{num(4)}{s}{num(4)}"])

    def negative(kind: str) -> str:
        if kind == "email":
            o, c = r.choice(["()", "[]", "{}"])
            return r.choice([f"{word()} {o}at{c} {word()}.{word()}", f"{num(1)} @ {num(1)}.{num(2)}", f"{word()} @ {num(2)}.{num(2)}", f"{word()} at {word()} dot {word()}"])
        if kind == "ip":
            return r.choice([f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", f"{num(1)}::::", f"{num(2)}:{num(2)}:{num(2)}:", "[.]".join(str(r.randint(256, 999)) for _ in range(4)), f"{num(2)}:{num(2)}:{num(2)}:{num(3)}"])
        if kind == "card":
            s = r.choice([" ", "-", ".", "/"])
            return r.choice([s.join((num(4), num(4), num(4), num(r.randint(1, 7)))), s.join((f"3{r.choice('47')}{num(2)}", num(6), num(5)))])
        s = r.choice(["-", ".", "/", " "])
        return r.choice([f"{r.randint(1900, 2030)}{s}{num(2)}{s}{num(3)}", f"{num(2)}{s}{num(2)}{s}{r.randint(1900, 2030)}", f"{num(2)} {num(3)} {num(3)}", f"{num(2)} {num(4)} {num(5)}", f"{num(3)}.{num(3)}.{num(3)}", f"00{r.randint(1, 9)}{num(9)}"])

    rows = []
    for kind in pii.KINDS:
        for i in range(n):
            rows.append((kind, positive(kind), prose() + (r.choice(cue[kind]) if kind in ("card", "phone") or r.random() < 0.7 else ""), r.choice([" ", ".", ", ", "\n"]), 1))
            bare = kind in ("card", "phone") and i % 3 == 0
            rows.append((kind, positive(kind) if bare else negative(kind), prose() + (r.choice(off) if bare or r.random() < 0.5 else ""), r.choice([" ", ".", ", ", " " + word()]), 0))
    return rows


def featured(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    df = spark.createDataFrame(rows, "kind string, hit string, before string, after string, label int")
    parts = [df.where(F.col("kind") == k).select("kind", F.col("label").cast("double").alias("label"), F.array(*pii.features(k, F.col("hit"), F.col("before"), F.col("after"))).alias("fs")) for k in pii.KINDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def tree(text: str) -> object:
    """A printed Spark ML tree as nested lists."""
    lines = [x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def read(i: int) -> tuple[object, int]:
        if m := re.match(r"Predict: (\S+)", lines[i]):
            return float(m[1]), i + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i])
        left, i = read(i + 1)
        right, i = read(i + 1)
        return [int(m[1]), float(m[2]), left, right], i

    return read(0)[0]


def fit(spark: SparkSession) -> dict:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = candidates()
    held = [x for i, x in enumerate(rows) if i // 2 % 5 == 0]
    kept = [x for i, x in enumerate(rows) if i // 2 % 5]
    made = GBTClassifier(maxDepth=DEPTH, maxIter=ROUNDS, stepSize=STEP, seed=SEED).fit(featured(spark, kept).select("label", array_to_vector("fs").alias("features")).coalesce(1))
    trees = [{"w": w, "node": tree(t.toDebugString)} for t, w in zip(made.trees, made.treeWeights, strict=True)]
    scored = featured(spark, held).withColumn("m", pii.margin([F.col("fs")[i] for i in range(len(pii.FEATURES))], trees))
    rows = scored.select("kind", "label", "m").collect()
    return {"features": list(pii.FEATURES), "trees": trees, "thresholds": {k: threshold([(r.m, r.label) for r in rows if r.kind == k]) for k in pii.KINDS}}


def threshold(scored: list[tuple[float, float]]) -> float:
    best = max(m for m, _ in scored)
    right = 0.0
    for i, (m, label) in enumerate(sorted(scored, reverse=True), 1):
        right += label
        if label and right >= PRECISION * i:
            best = m - MARGIN
    return max(0.0, best)


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    (Path(__file__).parent / "pii_model.json").write_text(json.dumps(fit(session), indent=1))
