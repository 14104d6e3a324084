"""Benchmark decontamination: CGK random walks over short stretches of words find places near a benchmark item; word edit distance
then decides.

``e`` edits leave at least one stretch of ``m // (e + 1)`` of an item's ``m`` words as it was. So a walk stays within a
stretch of that many words: at step j it emits the word under its pointer and moves on if that word's j-th random bit is 1,
up to the stretch's last word. Every word of every document starts a walk, and so does every word of an item that has a
whole stretch after it; thus each stretch of a document within the allowed edits shares a key with its item, whatever the
item's length and wherever the edits stand. A candidate is checked over the item-sized window around it, with as many words
on either side as edits are allowed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionsift.llm import seeds
from ionsift.llm.ngram_join import LOWER

U = np.uint64
SLICE = 1 << 20


@dataclass(frozen=True)
class Walks:
    """Every leak is found: the walks' lengths follow from ``edits``."""

    steps: int = 3  # steps of a walk for each word of its stretch
    edits: float = 0.2  # allowed word edits as a share of the item's words
    seed: int = 23
    block: int = 20_000  # items broadcast at once
    block_bytes: int = 8_000_000  # and bytes of their texts; an index takes about 40 bytes a word

    def most(self, n: int) -> int:
        """Allowed edits of an item of n words."""
        return int(self.edits * n + 1e-9)

    def stretch(self, n: int) -> int:
        """Words in a row that the allowed edits leave somewhere in an item of n words."""
        return n // (self.most(n) + 1)


def _words(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return seeds.word_units(data, np.array([0, len(data)]))[0]


def walk_keys(words: np.ndarray, how: Walks, used: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(words in a stretch, key of each start); the walks run over all words in a row."""
    n = len(words)
    padded = np.concatenate([words, np.zeros(max(used), U)])
    bits = seeds.mix(padded ^ U(0x51ED270B0A1F39C1 * how.seed % (1 << 64)))
    now, bit = np.empty(n, U), np.empty(n, U)
    for t in used:
        at = np.arange(n)
        last = at + (t - 1)
        keys = np.full(n, U(t))
        for j in range(how.steps * t):
            np.take(padded, at, out=now, mode="clip")
            keys ^= now
            keys *= U(seeds.BASE1)
            keys ^= keys >> U(32)
            np.take(bits, at, out=bit, mode="clip")
            at += (bit >> U(j % 64) & U(1)).astype(np.int64)
            np.minimum(at, last, out=at)
        yield t, keys * U(seeds.BASE2)


@dataclass
class Index:
    """Walk keys of a block of items."""

    items: list[np.ndarray]
    ids: list[int]
    used: tuple[int, ...]
    keys: dict[int, np.ndarray]
    of: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    distinct: list[np.ndarray]  # words of each item


def build_index(items: list[tuple[int, str]], how: Walks) -> Index | None:
    words = [(i, _words(t)) for i, t in items]
    words = [(i, w) for i, w in words if len(w)]
    if not words:
        return None
    rows: dict[int, list[int]] = defaultdict(list)
    for k, (_, w) in enumerate(words):
        rows[how.stretch(len(w))].append(k)
    keys, of, offset = {}, {}, {}
    for t, ks in rows.items():
        sizes = np.array([len(words[k][1]) for k in ks])
        _, key = next(walk_keys(np.concatenate([words[k][1] for k in ks]), how, (t,)))
        at = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = np.flatnonzero(at + t <= np.repeat(sizes, sizes))
        order = whole[np.argsort(key[whole])]
        keys[t], of[t], offset[t] = key[order], np.repeat(np.array(ks), sizes)[order], at[order]
    return Index([w for _, w in words], [i for i, _ in words], tuple(sorted(rows)), keys, of, offset, [np.unique(w) for _, w in words])


def blocks(items: Iterator[tuple[int, str]], how: Walks) -> Iterator[list[tuple[int, str]]]:
    """Items in a row, bounded in number and in bytes; an item that is over the bound by itself stands alone."""
    held: list[tuple[int, str]] = []
    size = 0
    for item in items:
        n = len(item[1].encode())
        if held and (len(held) >= how.block or size + n > how.block_bytes):
            yield held
            held, size = [], 0
        held.append(item)
        size += n
    if held:
        yield held


def least_edits(item: np.ndarray, text: np.ndarray) -> int:
    """Least number of word edits between the item and any stretch of the text (bit-parallel over the item's words)."""
    m = len(item)
    places: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item.tolist()):
        places[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for w in text.tolist():
        eq = places.get(w, 0)
        x = eq | down
        same = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(same | up) & full, up & same
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(x | plus) & full, plus & x
        best = min(best, score)
    return best


def _candidates(index: Index, words: np.ndarray, docs: np.ndarray, maybe: dict[int, np.ndarray], how: Walks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, item, place where the item would begin) wherever a walk of both is the same, about ``SLICE`` at a time."""
    for t, keys in walk_keys(words, how, index.used):
        place = np.flatnonzero(maybe[t][(keys >> U(44)).astype(np.int64)])
        low = np.searchsorted(index.keys[t], keys[place], "left")
        n = np.searchsorted(index.keys[t], keys[place], "right") - low
        place, low, n = place[n > 0], low[n > 0], n[n > 0]
        total = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(total, total[a] - n[a] + SLICE, "right")))
            p, m = np.repeat(place[a:b], n[a:b]), n[a:b]
            q = np.arange(len(p)) + np.repeat(low[a:b] - (np.cumsum(m) - m), m)
            yield np.searchsorted(docs, p, "right") - 1, index.of[t][q], p - index.offset[t][q]
            a = b


def _near(item: np.ndarray, distinct: np.ndarray, most: int, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the windows lack few enough of the item's distinct words: an edit takes at most one of them away."""
    size = len(item) + 4 * most
    out = np.empty(len(low), bool)
    step = max(1, SLICE // size)
    for a in range(0, len(low), step):
        at = low[a : a + step, None] + np.arange(size)
        inside = at < high[a : a + step, None]
        have = words[np.minimum(at, len(words) - 1)]
        which = np.minimum(np.searchsorted(distinct, have), len(distinct) - 1)
        seen = np.zeros((len(at), len(distinct)), bool)
        row, col = np.nonzero(inside & (distinct[which] == have))
        seen[row, which[row, col]] = True
        out[a : a + step] = len(distinct) - seen.sum(axis=1) <= most
    return out


def _find_rows(sent, how: Walks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        # a small table answers for most keys that no item has them
        maybe = {}
        for t, keys in index.keys.items():
            maybe[t] = np.zeros(1 << 20, bool)
            maybe[t][(keys >> U(44)).astype(np.int64)] = True
        for batch in batches:
            data, bounds = seeds.texts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            found: dict[tuple[int, int], int] = {}
            for i, j in seeds.chunks(bounds):
                words, docs = seeds.word_units(LOWER[data[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i])
                if not len(words):
                    continue
                for doc, of, begin in _candidates(index, words, docs, maybe, how):
                    order = np.lexsort((begin, doc, of))
                    doc, of, begin = doc[order], of[order], begin[order]
                    new = seeds.sorted_groups(of, doc, begin)
                    doc, of, begin = doc[new], of[new], begin[new]
                    edges = np.flatnonzero(np.r_[seeds.sorted_groups(of), True])
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                        k = int(of[a])
                        item, most = index.items[k], how.most(len(index.items[k]))
                        d = doc[a:b]
                        low = np.maximum(docs[d], begin[a:b] - 2 * most)
                        high = np.minimum(docs[d + 1], begin[a:b] + len(item) + 2 * most)
                        near = _near(item, index.distinct[k], most, words, low, high)
                        d, low, high = d[near], low[near], high[near]
                        # windows that overlap are read as one
                        new = np.r_[True, (d[1:] != d[:-1]) | (low[1:] > high[:-1])] if len(d) else near[:0]
                        first = np.flatnonzero(new)
                        for x, y in zip(first.tolist(), np.r_[first[1:], len(d)].tolist()):
                            have = found.get((i + int(d[x]), k))
                            if have == 0:
                                continue
                            n = least_edits(item, words[low[x] : high[y - 1]])
                            if n <= most and (have is None or n < have):
                                found[i + int(d[x]), k] = n
            if found:
                rows = sorted(found.items())
                yield pa.record_batch([pa.array([int(ids[d]) for (d, _), _ in rows], pa.int64()), pa.array([index.ids[k] for (_, k), _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int32())], names=["doc_id", "item_id", "edits"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, how: Walks = Walks()) -> DataFrame:
    """``doc_id, item_id, edits``: each pair of a document and an item that leaks into it, with the fewest word edits seen.

    An item leaks if a stretch of the document is within ``how.edits`` of the item's words, in word insertions,
    deletions and replacements; words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Null and empty texts and items, and
    rows with null ids, match nothing. Rows that repeat a document or an item give one pair. The items are read in
    blocks of ``how.block`` or ``how.block_bytes``, each broadcast by itself, so the documents are read once for each block and never shuffled;
    only the pairs found are.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    out = spark.createDataFrame([], "doc_id long, item_id long, edits int")
    for held in blocks(((row.item_id, row.text) for row in items.orderBy("item_id", "text").toLocalIterator()), how):
        if index := build_index(held, how):
            out = out.unionAll(texts.mapInArrow(_find_rows(spark.sparkContext.broadcast(index), how), "doc_id long, item_id long, edits int"))
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: Walks = Walks()) -> DataFrame:
    """``docs`` without the documents that an item leaks into; rows with a null id stay."""
    return docs.join(leaks(docs, benchmark, how).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
