"""Embedding near-dedup: random projections decoded to E8 lattice points in several tables, neighbouring cells probed, cosine verified.

A vector stands in one cell of each table (a cell is one E8 point for each block of eight projections) and probes the
cells nearest to it beside that. Pairs that meet in a cell, one of them as its owner, are compared in double precision.
Equal vectors are one class with a count, so they are never paired; cells with many classes are compared block by
block. A pair counts only where it first meets, so no list of pairs is shuffled or made distinct.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionsift.llm.common import components, materialize

U = np.uint64


@dataclass(frozen=True)
class Lattice:
    """With the defaults a pair of cosine 0.95 in 64 dimensions meets in one table with probability 0.58, in any of the eight with 0.999."""

    tables: int = 8
    blocks: int = 2
    scale: float = 0.5
    probes: int = 5
    seed: int = 17
    block_rows: int = 1024  # classes of a cell compared at once


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEAR = _minimal_vectors()


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer entries of even sum."""
    f = np.rint(y)
    e = y - f
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    k = np.abs(e[odd]).argmax(1)
    f[odd, k] += np.where(e[odd, k] >= 0, 1.0, -1.0)
    return f


def decode_e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the closer of the nearest integer and half-integer ones."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((((y - b) ** 2).sum(1) < ((y - a) ** 2).sum(1))[:, None], b, a)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def _cell_hash(doubled: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name for each cell; ``doubled`` holds twice the lattice points, so integers."""
    h = np.full(len(doubled), U(table + 1))
    for k in range(doubled.shape[1]):
        h = _mix(h * U(0x100000001B3) + doubled[:, k].astype(np.int64).view(U))
    return h


def cells(x: np.ndarray, how: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: each one's own cell in every table, and the cells that it probes there."""
    n, d = x.shape
    own = np.empty((n, how.tables), U)
    probed = np.empty((n, how.tables, how.probes), U)
    for t in range(how.tables):
        r = np.random.default_rng((how.seed, t, d)).normal(size=(d, 8 * how.blocks)) * how.scale
        y = (x @ r).reshape(n * how.blocks, 8)
        c = decode_e8(y)
        gain = ((y - c) @ NEAR.T).reshape(n, -1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, : how.probes]
        c2 = (c.reshape(n, how.blocks, 8) * 2).astype(np.int64)
        own[:, t] = _cell_hash(c2.reshape(n, -1), t)
        for p in range(how.probes):
            moved = c2.copy()
            moved[np.arange(n), best[:, p] // len(NEAR)] += (NEAR[best[:, p] % len(NEAR)] * 2).astype(np.int64)
            probed[:, t, p] = _cell_hash(moved.reshape(n, -1), t)
    return own, probed


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision from lists of one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _key_rows(how: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(width):
                part = batch.filter(pa.array(width == d))
                for i in range(0, part.num_rows, 2048):
                    some = part.slice(i, 2048)
                    own, probed = cells(_matrix(some.column("vector")), how)
                    n, k = len(own), how.tables * how.probes
                    keys = np.concatenate([own.reshape(-1), probed.reshape(-1)]).view(np.int64)
                    rep = some.column("rep").to_numpy(zero_copy_only=False)
                    table = np.concatenate([np.tile(np.arange(how.tables), n), np.tile(np.repeat(np.arange(how.tables), how.probes), n)]).astype(np.int32)
                    yield pa.record_batch(
                        [pa.array(keys), pa.array(table), pa.array(np.concatenate([np.repeat(rep, how.tables), np.repeat(rep, k)])), pa.array(np.arange(len(keys)) < n * how.tables)],
                        names=["cell", "table", "rep", "owns"],
                    )

    return run


#: How far a block product may lie below the exact sum of a pair of unit vectors.
SLACK = 1e-9
LINKED = "rep long, links long, root long"


def _local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest place that each place reaches over pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(rows: pa.Table, cosine: float, how: Lattice) -> pa.RecordBatch | None:
    """One block pair of a cell: counts and local roots of the pairs that first meet here."""
    rep = rows.column("rep").to_numpy()
    order = np.argsort(rep, kind="stable")
    rows, rep = rows.take(pa.array(order)), rep[order]
    owns, block, many = (rows.column(c).to_numpy() for c in ("owns", "block", "many"))
    x = _matrix(rows.column("vector").combine_chunks())
    table, cell = int(rows.column("table")[0].as_py()), rows.column("cell").to_numpy()[:1].view(U)[0]
    split = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    links, us, vs = np.zeros(len(rep), np.int64), [], []
    known = np.zeros(len(rep), bool)  # the cells of those in a close pair only
    own, probed = np.zeros((len(rep), how.tables), U), np.zeros((len(rep), how.tables, how.probes), U)
    for b in range(0, len(rep), 512):
        s = slice(b, b + 512)
        close = x[s] @ x.T >= cosine - SLACK  # block products differ in their last bits; the exact sum decides below
        close &= np.arange(len(rep))[None, :] > np.arange(b, min(b + 512, len(rep)))[:, None]
        close &= owns[s, None] | owns[None, :]
        if split:
            close &= block[s, None] != block[None, :]
        u, v = np.nonzero(close)
        u = u + b
        if not len(u):
            continue
        exact = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
        u, v = u[exact], v[exact]
        fresh = np.setdiff1d(np.r_[u, v], np.flatnonzero(known))
        if len(fresh):
            own[fresh], probed[fresh] = cells(x[fresh], how)
            known[fresh] = True
        seen = np.zeros(len(u), bool)
        for t in range(table):
            a, c = own[u, t], own[v, t]
            seen |= (a == c) | (probed[v, t] == a[:, None]).any(1) | (probed[u, t] == c[:, None]).any(1)
        a, c = own[u, table], own[v, table]
        both = owns[u] & owns[v]
        # one owns the cell, the other probes it: the reverse meeting in the other's cell counts if that cell is smaller
        other = np.where(owns[u], c, a)
        back = np.where(owns[u], (probed[u, table] == c[:, None]).any(1), (probed[v, table] == a[:, None]).any(1))
        seen |= ~both & back & (other < cell)
        u, v = u[~seen], v[~seen]
        np.add.at(links, u, many[v])
        np.add.at(links, v, many[u])
        us.append(u)
        vs.append(v)
    if not us or not sum(map(len, us)):
        return None
    root = _local_roots(len(rep), np.concatenate(us), np.concatenate(vs))
    has = np.flatnonzero(links > 0)
    return pa.record_batch([pa.array(rep[has]), pa.array(links[has]), pa.array(rep[root[has]])], names=["rep", "links", "root"])


def _compare_rows(cosine: float, how: Lattice):
    """mapInArrow over rows sorted by cell and block pair; it holds one block pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            if rows.num_rows > 1 and (out := _compare(rows, cosine, how)) is not None:
                yield out

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "i", "j")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for b, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                key = tuple(keys[:, b])
                if held and key != last:
                    yield from flush()
                    held.clear()
                held.append(batch.slice(b, e - b))
                last = key
        if held:
            yield from flush()

    return run


def link(vectors: DataFrame, cosine: float = 0.95, how: Lattice = Lattice(), id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept`` for each row of ``vectors``.

    Null, empty and zero vectors, ones with null or non-finite entries, and rows with a null id link with nothing.
    Vectors of different lengths don't link. ``n_links`` counts the other ids linked directly; a row that repeats an id
    with its vector counts once and gets the same result. Other columns are not carried; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("vector")
    good = F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).withColumn("good", F.coalesce(good, F.lit(False)))
    named = rows.where("good").withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    classes = materialize(named.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("many"), F.first("vector").alias("vector")), "classes")
    keys = materialize(classes.select("rep", "vector").mapInArrow(_key_rows(how), "cell long, table int, rep long, owns boolean"), "cells")
    full = keys.groupBy("cell", "table").agg(F.count(F.lit(1)).alias("n"), F.count_if("owns").alias("own")).where("n > 1 and own > 0")
    met = keys.join(full, ["cell", "table"]).withColumn("blocks", F.ceil(F.col("n") / how.block_rows).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cell", "table", "rep", "owns", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    beside = met.join(classes.select("rep", "many", "vector"), "rep").repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = materialize(beside.mapInArrow(_compare_rows(cosine, how), LINKED), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "rep")
    per_class = classes.select("h1", "h2", "rep", "many").join(links, "rep", "left").join(roots, "rep", "left")
    per_class = per_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = named.select("id", "h1", "h2").join(per_class, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionAll(alone).select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
