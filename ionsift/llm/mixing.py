"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies are its source's target over its size (times its own weight, if weights are given). The whole
part is copies that are certain; the rest is its inclusion probability in a sample of fixed size, counted in words: within a
source and a class of sizes, documents stand in the order of their random odds over their inclusion odds, and the first of
them are taken up to the class's expected words. Classes go from the longest texts down, and what a class can't spend
goes on to the next. Ranks are cut at buckets, so no source or class is ever sorted or held in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionsift.llm.common import NOT_SPACE, materialize

#: Parts of a word in which expected words are summed, exactly.
UNIT = 1 << 20
#: Rows of a table of sources or size classes that are broadcast, at most; they are counted.
MOST_ROWS = 100_000
#: Splits of a joined key beyond that.
SALTS = 32


@dataclass(frozen=True)
class Mix:
    """Sources in order weigh ``weights``, repeating; none takes over ``most`` times its size."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    seed: int = 13
    buckets: int = 4096  # of ranks; a class's last bucket is taken whole or not at all

    def __post_init__(self):
        if not self.weights or min(self.weights) < 1 or self.most < 1:
            raise ValueError("weights and the most copies are positive whole numbers")


def _beside(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins a table with one row for each key: broadcast if its counted rows are few, else by salted keys."""
    if small.limit(MOST_ROWS + 1).count() <= MOST_ROWS:
        return rows.join(F.broadcast(small), on, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.hash("u"), F.lit(SALTS))).join(salted, [*on, "__salt"], how).drop("__salt")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``: that of ``source`` (distinct, null last) by code point, from 0.

    Places are counted in two passes: up to 255 sources, those with the smallest hashes, cut the order into stretches.
    """
    some = sources.where("source is not null").select("source").orderBy(F.xxhash64("source"), "source").limit(255).collect()
    cuts = F.array(*map(F.lit, sorted((r.source for r in some), key=str.encode))).cast("array<string>")
    part = F.when(F.col("source").isNull(), len(some) + 1).otherwise(F.size(F.filter(cuts, lambda b: b <= F.col("source"))))
    dealt = sources.withColumn("part", part)
    n = dict(dealt.groupBy("part").count().collect())
    before = np.cumsum([0, *(n.get(k, 0) for k in range(len(some) + 2))]).tolist()
    order = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("place", F.row_number().over(order) - 1 + F.get(F.array(*map(F.lit, before)), F.col("part"))).drop("part")


def with_targets(sources: DataFrame, how: Mix) -> DataFrame:
    """Adds ``target`` to ``place, source_size``: shares of all words by weight, capped, the excess shared anew among the rest."""
    w = F.get(F.array(*map(F.lit, how.weights)), (F.col("place") % len(how.weights)).cast("int"))
    weighed = sources.withColumn("w", w.cast("long"))
    most = how.most * F.col("source_size")
    total, full = weighed.agg(F.sum("source_size")).first()[0] or 0, F.lit(False)
    while True:
        spent, weight = weighed.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("w")))).first()
        left, weight = F.lit(total - (spent or 0)).cast("long") * F.col("w"), F.lit(weight or 1).cast("long")
        above = full | (most * weight < left)
        if not weighed.where(above & ~full).limit(1).count():
            return weighed.withColumn("target", F.when(full, most.cast("double")).otherwise(left / weight)).drop("w")
        full = above


def _scaled(rows: DataFrame, sources: DataFrame, how: Mix) -> DataFrame:
    """``source, scale``: expected copies for each unit of weight, so that capped copies make the target where they can."""
    level = sources.select("source_id", "target").withColumn("scale", F.lit(0.0))
    last = None
    while True:
        near = _beside(rows.where("weight > 0"), level, ["source_id"])
        capped = (F.col("scale") * F.col("weight")) >= how.most
        sums = near.groupBy("source_id").agg(F.sum(F.when(capped, how.most * F.col("size"))).alias("spent"), F.sum(F.when(~capped, F.col("weight") * F.col("size"))).alias("open"), F.count_if(capped).alias("n"))
        joined = level.join(sums, "source_id", "left")
        scale = F.when(F.col("open") > 0, F.greatest("scale", (F.col("target") - F.coalesce("spent", F.lit(0))) / F.col("open"))).otherwise(F.col("scale"))
        level = materialize(joined.select("source_id", "target", scale.alias("scale"), F.coalesce("n", F.lit(0)).alias("n")), "scales")
        n = level.agg(F.sum("n")).first()[0]
        if n == last:
            return level.select("source_id", "scale")
        last, level = n, level.drop("n")


def _cut(how: Mix):
    """applyInPandas over one source's buckets: ``size_class, cut``; buckets below the cut are taken.

    Rows: at most one for each class (64) and bucket.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        carry, out, tempting = 0.0, [], []
        for size_class, rows in sorted(pdf.groupby("size_class"), reverse=True):
            rows = rows.sort_values("bucket")
            quota = rows["expected"].sum() / UNIT + carry
            taken = rows["words"].cumsum()
            n = int((taken <= quota).sum())
            carry = quota - (float(taken.iloc[n - 1]) if n else 0.0)
            cut = int(rows["bucket"].iloc[n]) if n < len(rows) else how.buckets
            out.append([size_class, cut])
            if n < len(rows):
                tempting.append((float(rows["words"].iloc[n]), len(out) - 1))
        # one more bucket, if that comes nearer to the target
        near = min(((abs(carry - w), k) for w, k in tempting), default=(carry, None))
        if near[0] < carry:
            out[near[1]][1] += 1
        return pd.DataFrame({"source_id": pdf["source_id"].iloc[0], "size_class": [a for a, _ in out], "cut": [b for _, b in out]})

    return run


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a digest of the key: the same in every run."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, how: Mix = Mix(), weight: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of each row of ``docs`` (``doc_id, text, source``).

    ``size`` counts the words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none and are never taken. Null sources are
    one source, the last. ``weight`` names a column of relative wishes within a source (null, NaN or not above 0: no
    copies); without it all documents of a source are equal. ``taken = copies * size``. Ranks come from digests of the
    ids (of the texts, where an id is null), so reruns agree; rows that repeat an id share its rank. Other columns are not
    carried. A source's taken words miss its target by at most half of its longest text, as long as it has at most
    ``buckets`` texts in each class of sizes (more: by at most half a bucket of one class); short texts bring it nearer.
    """
    wish = F.lit(1.0) if weight is None else F.nanvl(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    size = F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long")
    rows = materialize(docs.select("doc_id", "source", size.alias("size"), uniform(key, how.seed).alias("u"), wish.alias("weight")), "sizes")
    sources = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = materialize(with_targets(sources, how).withColumn("source_id", F.col("place").cast("long")), "sources")
    named = sources.select(F.struct("source").alias("key"), "source_id", "source_size", "target")
    rows = _beside(rows.withColumn("key", F.struct("source")), named, ["key"]).drop("key")
    if weight is None:
        expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    else:
        rows = _beside(rows, _scaled(rows, sources, how), ["source_id"], "left")
        expected = F.least(F.col("scale") * F.col("weight"), F.lit(float(how.most)))
    rows = rows.withColumn("expected", F.when(F.col("size") > 0, expected).otherwise(F.lit(0.0)))
    rows = rows.withColumn("sure", F.floor("expected")).withColumn("p", F.col("expected") - F.col("sure")).withColumn("size_class", F.length(F.bin("size")))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("odds", F.when(F.col("p") > 0, odds))
    bucket = F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * how.buckets), F.lit(how.buckets - 1))
    rows = rows.withColumn("bucket", F.when(F.col("odds").isNotNull(), bucket))
    buckets = rows.where("bucket is not null").groupBy("source_id", "size_class", "bucket").agg(F.sum("size").alias("words"), F.sum(F.floor(F.col("p") * F.col("size") * UNIT)).alias("expected"))
    cuts = materialize(buckets.groupBy("source_id").applyInPandas(_cut(how), "source_id long, size_class int, cut long"), "cuts")
    rows = _beside(rows, cuts, ["source_id", "size_class"], "left")
    copies = F.col("sure") + F.coalesce((F.col("bucket") < F.col("cut")).cast("long"), F.lit(0))
    return rows.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
