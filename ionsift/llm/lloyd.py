"""Centroid clustering by dual-tree Lloyd rounds on integers.

The vectors stand in blocks, each with a cover tree that is built once and written with it. A round builds a cover tree of
the centroids too and walks both at once: a pair of nodes whose least distance is above what another pair guarantees is
dropped; a vector node with one centroid left goes to it whole, a leaf with several is compared exactly. Tasks return sums
for each centroid, so only the centroids pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionsift.llm.common import forget, materialize

#: Integer components beyond this (either sign) would let an exact squared distance of 64 of them leave 64 bits.
LARGEST = 1 << 27
#: Bounds are of doubles; by so much, relatively, they are widened, so that no nearest centroid or tie is pruned.
SLACK = 1e-9
#: A block of vectors with its tree: rows in tree order, as 32-bit integers.
BLOCKS = "ids array<bigint>, points binary, nodes binary, radius binary"


@dataclass(frozen=True)
class Lloyd:
    """``clusters`` centroids, ``rounds`` updates; component x counts as floor(scale * x). ``dim`` is at most 64."""

    clusters: int = 8
    rounds: int = 10
    dim: int = 64
    scale: float = 1024.0
    seed: int = 3
    block: int = 1024  # vectors of one cover tree
    leaf: int = 16

    def __post_init__(self):
        if not 1 <= self.dim <= 64 or self.clusters < 1 or self.rounds < 0:
            raise ValueError("1 to 64 components, one cluster at least, no negative number of rounds")


@dataclass
class Tree:
    """Rows in depth-first order: a node holds rows ``begin .. end - 1``, its centre is the first of them, none is farther
    than ``radius``. ``first .. last - 1`` are its children; a leaf has none."""

    order: np.ndarray
    nodes: np.ndarray  # begin, end, first, last
    radius: np.ndarray


def _net(x: np.ndarray, reach: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres (row numbers) over ``reach`` apart, and for each row the place of a centre at most ``reach`` away.

    Row 0 is the first centre. None if it takes more than ``most`` centres.
    """
    centres, own = [0], np.zeros(len(x), np.int64)
    low = ((x - x[0]) ** 2).sum(1)
    while low[far := int(low.argmax())] > reach * reach:
        if len(centres) >= most:
            return None
        d = ((x - x[far]) ** 2).sum(1)
        closer = d < low
        low[closer], own[closer] = d[closer], len(centres)
        centres.append(far)
    return np.array(centres), own


def cover_tree(x: np.ndarray, leaf: int) -> Tree:
    """A node's children are a net at half its radius; equal rows share a leaf whatever their number.

    Rows of which more than half would be centres lie too evenly to be told apart and make a leaf, unless ``leaf`` is 1.
    """
    x = x.astype(np.float64)
    order, nodes, radius, at = np.arange(len(x)), [[0, len(x), 0, 0]], [], 0
    while at < len(nodes):
        begin, end = nodes[at][:2]
        rows = x[order[begin:end]]
        radius.append(float(np.sqrt(((rows - rows[0]) ** 2).sum(1).max())))
        net = _net(rows, radius[-1] / 2, len(rows) if leaf == 1 else len(rows) // 2) if end - begin > leaf and radius[-1] > 0 else None
        if net is not None:
            centres, own = net
            behind = np.ones(len(rows), np.int64)
            behind[centres] = 0
            order[begin:end] = order[begin:end][np.lexsort((behind, own))]
            cuts = np.r_[0, np.cumsum(np.bincount(own))] + begin
            nodes[at][2:] = [len(nodes), len(nodes) + len(centres)]
            nodes += [[int(b), int(e), 0, 0] for b, e in zip(cuts[:-1], cuts[1:])]
        at += 1
    return Tree(order, np.array(nodes, np.int32), np.array(radius))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer rows."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # every product and sum is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        d = x - row
        out[:, j] = (d * d).sum(1)
    return out


def _opened(nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All children of the nodes, and for each the place of its parent in ``at``."""
    n = nodes[at, 3] - nodes[at, 2]
    parent = np.repeat(np.arange(len(at)), n)
    return np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + nodes[at, 2][parent], parent


def nearest(x: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> np.ndarray:
    """The place of the nearest centroid (ties: the smallest) of each row.

    ``x`` stands in the order of ``tree``; ``over`` is the tree of ``centroids``, with leaves of one.
    """
    best = np.empty(len(x), np.int64)
    points, places = x[tree.nodes[:, 0]].astype(np.float64), over.order[over.nodes[:, 0]]
    spots = centroids[places].astype(np.float64)
    leaf, several = tree.nodes[:, 3] == tree.nodes[:, 2], over.nodes[:, 3] > over.nodes[:, 2]
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of a vector node and a centroid node
    while len(v):
        gap = points[v] - spots[c]
        d = np.sqrt((gap * gap).sum(1))
        sure = np.full(len(leaf), np.inf)  # no row of the node is farther from its nearest centroid
        np.minimum.at(sure, v, d + tree.radius[v])
        stay = d - tree.radius[v] - over.radius[c] <= sure[v] * (1 + SLACK) + SLACK
        v, c = v[stay], c[stay]
        wide = several[c] & (leaf[v] | (over.radius[c] >= tree.radius[v]))  # the wider side is opened first
        waits, mixed = (np.bincount(v[x_], minlength=len(leaf)) > 0 for x_ in (wide, several[c]))
        done = ~waits & (leaf | ((np.bincount(v, minlength=len(leaf)) == 1) & ~mixed))
        for node in np.unique(v[done[v]]):
            begin, end = tree.nodes[node, :2]
            have = np.sort(places[c[v == node]])
            for b in range(begin, end, 4096):
                some = slice(b, min(b + 4096, end))
                best[some] = have[squared(x[some], centroids[have]).argmin(1)] if len(have) > 1 else have[0]
        whole = ~waits[v] & ~done[v]
        below_v, of_v = _opened(tree.nodes, v[whole])
        below_c, of_c = _opened(over.nodes, c[wide])
        kept = waits[v] & ~wide
        v, c = np.concatenate([v[kept], below_v, v[wide][of_c]]), np.concatenate([c[kept], c[whole][of_v], below_c])
    return best


def _pack(ids: list, x: np.ndarray, how: Lloyd) -> pa.RecordBatch:
    tree = cover_tree(x, how.leaf)
    return pa.record_batch(
        [pa.array([[ids[i] for i in tree.order]], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in (x[tree.order].astype(np.int32), tree.nodes, tree.radius))],
        names=["ids", "points", "nodes", "radius"],
    )


def _plant(how: Lloyd):
    """mapInArrow: ``id, vector`` rows to blocks with their trees; one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            x = np.floor(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, how.dim) * how.scale).astype(np.int64)
            names = batch.column("id").to_pylist()
            for b in range(0, len(x), how.block):
                ids += names[b : b + how.block]
                rows.append(x[b : b + how.block])
                if len(ids) >= how.block:
                    every = np.concatenate(rows)
                    yield _pack(ids[: how.block], every[: how.block], how)
                    ids, rows = ids[how.block :], [every[how.block :]]
        if ids:
            yield _pack(ids, np.concatenate(rows), how)

    return run


def _assigned(batch: pa.RecordBatch, i: int, dim: int, distinct: np.ndarray, number: np.ndarray, over: Tree) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block and the number of each one's centroid."""
    raw = {k: batch.column(k)[i].as_py() for k in ("points", "nodes", "radius")}
    x = np.frombuffer(raw["points"], np.int32).reshape(-1, dim).astype(np.int64)
    tree = Tree(np.arange(len(x)), np.frombuffer(raw["nodes"], np.int32).reshape(-1, 4), np.frombuffer(raw["radius"]))
    return x, number[nearest(x, tree, distinct, over)]


def _over(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, Tree]:
    """Distinct centroids, the smallest number of each, and their tree."""
    number = np.sort(np.unique(centroids, axis=0, return_index=True)[1])
    return centroids[number], number, cover_tree(centroids[number], 1)


def _sums(centroids: np.ndarray):
    """mapInArrow: blocks to one row for each cluster of the task, with its count and sums."""
    distinct, number, over = _over(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                x, best = _assigned(batch, i, centroids.shape[1], distinct, number, over)
                n += np.bincount(best, minlength=len(n))
                np.add.at(total, best, x)
        has = np.flatnonzero(n)
        yield pa.record_batch([pa.array(has), pa.array(n[has]), pa.array(list(total[has]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _rows(centroids: np.ndarray):
    distinct, number, over = _over(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, best = _assigned(batch, i, centroids.shape[1], distinct, number, over)
                gap = x - centroids[best]
                yield pa.record_batch([batch.column("ids")[i].values, pa.array(best.astype(np.int32)), pa.array((gap * gap).sum(1))], names=["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, how: Lloyd = Lloyd(), id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector that takes part.

    Vectors of ``dim`` components take part, none of them null or non-finite or, scaled, beyond 2**27 (exact distances
    would not fit 64 bits). They start from the ``clusters`` rows with the smallest sha256 of ``seed:id`` (equal ones: by
    vector), or all if fewer; rows with a null id are clustered but never start one. A centroid becomes floor(sum / count)
    of its rows, an empty one stays. ``distance`` is squared. Repeated rows count as often as they stand there; an empty
    table gives no rows. Other columns are not carried. Only centroids and their sums pass the driver.
    """
    spark = vectors.sparkSession
    fine = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(F.floor(e * how.scale)) <= LARGEST))
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where((F.size("vector") == how.dim) & fine)
    start = rows.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col("id").cast("string")), 256), "vector").limit(how.clusters).collect()
    kinds = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        none = rows.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).where("false")
        return none.join(spark.createDataFrame([], kinds), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    centroids = np.floor(np.array([r.vector for r in start]) * how.scale).astype(np.int64)
    blocks = materialize(rows.mapInArrow(_plant(how), BLOCKS), "blocks")
    for _ in range(how.rounds):
        parts = blocks.select("points", "nodes", "radius").mapInArrow(_sums(centroids), "cluster long, n long, total array<bigint>")
        big = "decimal(38,0)"
        each = parts.select("cluster", F.col("n").cast(big).alias("n"), F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast(big)).alias("x"))
        moved = centroids.copy()
        for r in each.collect():  # clusters x components
            moved[r.cluster, r["at"]] = int(r.x) // int(r.n)
        if (moved == centroids).all():
            break  # all later rounds would give the same
        centroids = moved
    found = materialize(blocks.mapInArrow(_rows(centroids), "id long, cluster int, distance long"), "assigned")
    forget(blocks)
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame([(k, d, sum(inertia.values()), digest[k]) for k, d in sorted(inertia.items())], kinds)
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
