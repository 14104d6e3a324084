"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its shingle hashes. Its point has a coordinate for each group of hashes: how many shingles fall
there. The summed coordinate minima of two points bound the overlap of their sets from above, and so do those of a
point and a tree node's maxima. One tree over all points would meet nearly every query in nearly every node, because the
counts of unrelated texts of one length differ little. So each tree holds one group of documents that may be linked:

1. Equal sets are one class; only its first document goes on.
2. A linked pair shares a certain number of its lowest hashes. Documents that share fewer with all others together are out.
3. Of the rest, those whose shingles mostly stand nowhere else are out. A linked pair shares a shingle among each one's
   rarest; documents connected by such shingles are a group.
4. Within a group trees find candidates by their bounds, and the sets decide. Pairs that are connected already aren't
   looked at again, and only what connects is handed on, so a group of n near copies gives about n rows. Large groups
   are cut into blocks: first each block by itself with the group's common centres, then all blocks against those
   that are not yet part of the group's largest component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionsift.llm import seeds
from ionsift.llm.common import components, forget, materialize, tidy

SHINGLE, PERCENT = 4, 85
#: Documents in a tree's leaf, of a group's block, and of each group that all its blocks hold.
LEAF, BLOCK, CENTRES = 16, 64, 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingle hashes, ascending."""
    for i, j in seeds.chunks(bounds):
        units, docs = seeds.word_units(LOWER[data[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i])
        grams = seeds.word_grams(units, k)
        for b, e in zip(docs[:-1].tolist(), docs[1:].tolist()):
            if e - b >= k:
                yield np.unique(grams[b : e - k + 1])
            elif e > b:
                yield seeds.mix(seeds.word_grams(units[b:e], e - b) + np.uint64(e - b))
            else:
                yield np.zeros(0, np.uint64)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set it links with, at least."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """Shared ones among the lowest hashes that step 2 asks of a set of n."""
    return n // 10 + 1


def _list(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _summary_rows(k: int, percent: int):
    """mapInArrow: texts -> size, two sums of mixed hashes that name the set, its lowest hashes and how many of them must be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = seeds.texts(batch.column("text"))
            n, s1, s2, low, needed = [], [], [], [], []
            for u in shingle_sets(data, bounds, k):
                size = len(u)
                most = least_overlap(size, percent)
                n.append(size)
                s1.append(u.sum(dtype=np.uint64))
                s2.append(seeds.mix(u * np.uint64(seeds.BASE1)).sum(dtype=np.uint64))
                low.append(u[: min(size, size - most + spare(size))].view(np.int64))
                needed.append(min(spare(most), least_overlap(most, percent)))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int32()), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2)], _list(low, np.int64), pa.array(needed, pa.int32())],
                names=["doc", "n", "s1", "s2", "low", "needed"],
            )

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = seeds.texts(batch.column("text"))
            held: list[np.ndarray] = []
            begin = size = 0
            for i, u in enumerate(shingle_sets(data, bounds, k)):
                held.append(u.view(np.int64))
                size += len(u)
                if size > 1 << 20 or i == batch.num_rows - 1:
                    yield pa.record_batch([batch.column("doc_id").slice(begin, len(held)), _list(held, np.int64)], names=["doc", "shingles"])
                    begin, held, size = i + 1, [], 0

    return run


def group_counts(own: np.ndarray, shingles: np.ndarray, n: int, groups: int) -> np.ndarray:
    """The points: for each of n sets how many of its shingles fall into each group (a power of two) of hashes."""
    group = (shingles.view(np.uint64) >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64)
    return np.bincount(own * groups + group, minlength=n * groups).reshape(n, groups)


class CountTree:
    """A packed R-tree over count vectors: leaves of neighbours by size, then by the widest coordinate, under a level of nodes."""

    def __init__(self, counts: np.ndarray, n: np.ndarray, leaf: int = LEAF):
        wide = int(np.argmax(counts.std(0))) if len(counts) else 0
        by_size = np.argsort(n, kind="stable")
        slab = max(leaf, int(np.ceil(np.sqrt(len(n) / leaf))) * leaf)
        self.order = np.concatenate([s[np.argsort(counts[s, wide], kind="stable")] for s in np.split(by_size, range(slab, len(n), slab))])
        kind = np.uint16 if len(counts) and counts.max() < 1 << 16 else np.int64
        self.counts, self.n = counts[self.order].astype(kind), n[self.order]
        self.begin = np.arange(0, len(n), leaf)
        self.most = np.maximum.reduceat(self.counts, self.begin)
        self.low, self.high = np.minimum.reduceat(self.n, self.begin), np.maximum.reduceat(self.n, self.begin)
        self.up = np.arange(0, len(self.begin), leaf)
        self.up_most = np.maximum.reduceat(self.most, self.up)
        self.up_low, self.up_high = np.minimum.reduceat(self.low, self.up), np.maximum.reduceat(self.high, self.up)
        self.leaf = leaf

    def _children(self, a: np.ndarray, node: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        child = (begin[node][:, None] + np.arange(self.leaf)).reshape(-1)
        a = np.repeat(a, self.leaf)
        return a[child < n], child[child < n]

    def search(self, counts: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose bound reaches the threshold: 100 * overlap >= percent * union."""
        counts = counts.astype(self.counts.dtype)
        step = max(1, (1 << 22) // max(1, counts.shape[1]))

        def passes(q: np.ndarray, at: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near = (100 * n[q] >= percent * low[at]) & (100 * high[at] >= percent * n[q])
            q, at = q[near], at[near]
            keep = np.empty(len(q), bool)
            for i in range(0, len(q), step):
                x, y = q[i : i + step], at[i : i + step]
                # overlap o of sizes a and b reaches the threshold iff (100 + percent) * o >= percent * (a + b)
                keep[i : i + step] = (100 + percent) * np.minimum(counts[x], most[y]).sum(1, dtype=np.int64) >= percent * (n[x] + low[y])
            return q[keep], at[keep]

        q, node = np.repeat(np.arange(len(n)), len(self.up)), np.tile(np.arange(len(self.up)), len(n))
        q, node = passes(q, node, self.up_most, self.up_low, self.up_high)
        q, node = passes(*self._children(q, node, self.up, len(self.begin)), self.most, self.low, self.high)
        q, at = passes(*self._children(q, node, self.begin, len(self.n)), self.counts, self.n, self.n)
        return q, self.order[at]


def connect(sets: list[np.ndarray], side: np.ndarray, known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``sets``: about as many as there are sets, never all pairs.

    Sets that carry the same number in ``known`` are connected already. Of sides 0 and 1 only pairs across are looked at;
    other sides are looked at within themselves too.
    """
    size = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), size)
    groups = 1 << int(np.clip(int(np.median(size)).bit_length(), 6, 9))
    counts = group_counts(own, flat, len(sets), groups)
    q, p = CountTree(counts, size).search(counts, size, percent)
    keep = (q < p) & (known[q] != known[p]) & ~((side[q] == side[p]) & (side[q] < 2))
    q, p = q[keep], p[keep]
    if not len(q):
        return []
    local = np.unique(flat, return_inverse=True)[1]
    have = np.zeros(int(local.max()) + 1, bool)
    comp = np.unique(known, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    # documents with most candidates come first: they connect most, and what is connected needs no more looks
    degree = np.bincount(np.concatenate([q, p]), minlength=len(sets))
    swap = degree[p] > degree[q]
    q, p = np.where(swap, p, q), np.where(swap, q, p)
    order = np.lexsort((q, -degree[q]))
    q, p = q[order], p[order]
    edges = np.flatnonzero(np.r_[seeds.sorted_groups(q), True])
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        a, b = int(q[i]), p[i:j]
        b = b[comp[b] != comp[a]]
        if not len(b):
            continue
        mine = local[begin[a] : begin[a + 1]]
        have[mine] = True
        if len(b) * 4 < len(sets):
            over = np.array([np.count_nonzero(have[local[begin[x] : begin[x + 1]]]) for x in b.tolist()])
        else:
            over = np.add.reduceat(have[local], begin[:-1], dtype=np.int64)[b]
        have[mine] = False
        for x in b[(100 + percent) * over >= percent * (size[a] + size[b])].tolist():
            if comp[x] != comp[a]:
                links.append((a, x))
                comp[comp == comp[x]] = comp[a]
    return links


def _link_rows(percent: int):
    """mapInArrow over ``doc, comp, side, shingles`` sorted by tree (``g, i, j``) -> links ``u, v``."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held)
        doc, comp, side = (table.column(c).to_numpy() for c in ("doc", "comp", "side"))
        if len(doc) < 2 or len(np.unique(comp)) < 2:
            return None
        cut, flat = seeds.lists(table.column("shingles").combine_chunks())
        flat = flat.to_numpy(zero_copy_only=False)
        links = connect([flat[b:e] for b, e in zip(cut[:-1].tolist(), cut[1:].tolist())], side, comp, percent)
        if not links:
            return None
        u, v = np.array(links).T
        return pa.record_batch([pa.array(doc[u]), pa.array(doc[v])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("g", "i", "j")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for b, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                key = tuple(keys[:, b].tolist())
                if held and key != last:
                    if (made := settle(held)) is not None:
                        yield made
                    held = []
                held.append(batch.slice(b, e - b))
                last = key
        if held and (made := settle(held)) is not None:
            yield made

    return run


def _near_groups(sets: DataFrame, percent: int) -> DataFrame:
    """``doc, g`` for the documents of ``sets`` (``doc, shingles``) that may be linked: step 3."""
    tokens = sets.select("doc", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    listed = tokens.join(several, "token").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("shared"))
    # the rarest n - most + 1 of a set; those that stand nowhere else come first and connect nothing
    beyond = F.size("shared") - F.expr(f"({percent} * n + 99) div 100")
    rare = materialize(listed.where(beyond >= 0).select("doc", F.explode(F.slice("shared", 1, beyond + 1)["token"]).alias("token")), "rare")
    low = rare.groupBy("token").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("token", "low")
    groups = components(rare.join(low, "token").select(F.col("doc").alias("u"), F.col("low").alias("v")))
    forget(rare)
    first = groups.select("component_id", F.col("component_id").alias("g")).distinct()
    out = materialize(groups.select(F.col("id").alias("doc"), F.col("component_id").alias("g")).unionAll(first), "groups")
    forget(groups)
    return out


def _connected(sets: DataFrame, groups: DataFrame, percent: int) -> list[DataFrame]:
    """``u, v``: links that connect all that is linked in each group, in one or two tables: step 4."""
    spark = sets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    find = lambda rows: rows.select("doc", "comp", "side", "shingles", "g", "i", "j").repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(tidy(_link_rows(percent)), "u long, v long")
    centres = F.array(*[F.min_by("doc", F.xxhash64("doc", F.lit(2 + t))) for t in range(CENTRES)])
    count = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m"), centres.alias("centres"))
    placed = groups.join(count, "g").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("blocks")).cast("int")).drop("m")
    members = materialize(sets.join(placed, "doc"), "members")
    # each block by itself; a group's centres stand in all its blocks and connect what is like them
    is_centre = F.array_contains("centres", F.col("doc"))
    where = F.when(is_centre, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    alone = members.withColumn("i", F.explode(where)).withColumns({"j": F.col("i"), "side": F.lit(2), "comp": F.col("doc")})
    first = materialize(find(alone), "first")
    if not members.where("blocks > 1").limit(1).count():
        forget(members)
        return [first]
    # the blocks of large groups: those outside of the largest component against all
    comp = components(first)
    large = members.where("blocks > 1").drop("block", "centres").join(comp.select(F.col("id").alias("doc"), F.col("component_id").alias("comp")), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    large = materialize(large.select("g", "doc", "comp", "shingles"), "large")
    sizes = large.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("g").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("inside"), F.sum("c").alias("m")).where("m > inside")
    rest = large.join(main, "g").withColumns({"apart": F.col("comp") != F.col("main"), "rests": F.ceil((F.col("m") - F.col("inside")) / BLOCK).cast("int"), "mains": F.ceil(F.col("inside") / BLOCK).cast("int")})
    block = F.pmod(F.xxhash64("doc", F.lit(2)), F.when(F.col("apart"), F.col("rests")).otherwise(F.col("mains"))).cast("int")
    # blocks of the rest are numbered before those of the largest component; a tree holds two blocks, or one of the rest
    rest = rest.withColumn("block", F.when(F.col("apart"), block).otherwise(F.col("rests") + block))
    others = F.when(F.col("apart"), F.sequence(F.lit(0), F.col("rests") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))
    paired = rest.withColumn("with", F.explode(others)).withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    paired = paired.withColumn("side", F.when(F.col("i") == F.col("j"), 2).when(F.col("block") == F.col("i"), 0).otherwise(1))
    second = materialize(find(paired), "second")
    forget(members, comp, large)
    return [first, second]


def link(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, n_shingles, component_id`` for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set holds its distinct ``k``-word shingles, or its
    whole sequence if it has fewer words. Two documents link if 100 * intersection >= ``percent`` * union; texts
    without words (null and empty ones too) link with nothing. A null id has no component and links with nothing. Rows that
    repeat an id with its text get the same result; an id must not stand for two texts. Other columns are not carried; an
    empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    summary = materialize(docs.mapInArrow(tidy(_summary_rows(k, percent)), "doc long, n int, s1 long, s2 long, low array<long>, needed int"), "summary", small=True)
    known = summary.where("doc is not null and n > 0")
    classes = materialize(known.groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep")), "classes")

    firsts = known.select("doc", "low", "needed").join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"])
    tokens = firsts.select("doc", "needed", F.explode("low").alias("token"))
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    open_ = materialize(tokens.join(several, "token").groupBy("doc", "needed").agg(F.count(F.lit(1)).alias("c")).where("c >= needed").select(F.col("doc").alias("doc_id")), "open")
    sets = materialize(docs.join(open_, "doc_id", "left_semi").mapInArrow(tidy(_set_rows(k)), "doc long, shingles array<long>").dropDuplicates(["doc"]), "sets", small=True)
    groups = _near_groups(sets, percent)
    links = _connected(sets, groups, percent)
    comp = components(reduce(DataFrame.unionAll, links))
    of_rep = comp.withColumnRenamed("id", "rep")

    per_class = classes.join(of_rep, "rep", "left").select("n", "s1", "s2", F.coalesce("component_id", "rep").alias("component_id"))
    out = known.select("doc", "n", "s1", "s2").join(per_class, ["n", "s1", "s2"]).select("doc", "n", "component_id")
    alone = summary.where("doc is null or n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    done = materialize(out.unionAll(alone), "linked")
    forget(summary, classes, open_, sets, groups, comp, *links)
    return done.select(F.col("doc").alias(id), F.col("n").cast("long").alias("n_shingles"), "component_id")
