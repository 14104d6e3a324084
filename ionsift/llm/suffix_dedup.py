"""Suffix-array dedup over bytes: a hash-compared suffix sort finds the strings that documents share.

Anchors deal the suffixes out, so that equal strings of ``size`` bytes meet in one task. There the contested suffixes
are sorted by mergesort; two suffixes are compared in logarithmic time by binary search for their common extension
over prefix polynomial hashes. Neighbours in sorted order with a common extension of ``size`` bytes share a string,
which the bytes themselves confirm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ionsift.llm import seeds

GRAM, SIZE = 16, 50
#: Stretches sorted at once in a task, about; of an anchor context with over twice as many Spark groups the strings themselves.
ROWS = 1 << 15


#: Bytes that suffixes are first sorted by as a number.
HEAD = 8


def common_extension(sums: seeds.Prefix, a: np.ndarray, b: np.ndarray, limit: np.ndarray, known: int = 0) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to limit, by binary search over hashes; ``known`` are common anyway."""
    high = limit.astype(np.int64)
    low = np.minimum(high, known)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_] + 1) >> 1
        same = sums.same(a[open_], b[open_], mid)
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)
        open_ = open_[low[open_] < high[open_]]
    return low


def _less_equal(data: np.ndarray, sums: seeds.Prefix, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the suffix at a sorts before the one at b or equals it; each ends with its stretch, and their heads are equal."""
    left = np.minimum(ends[a] - a, ends[b] - b)
    n = common_extension(sums, a, b, left, HEAD)
    out = ends[a] - a <= ends[b] - b
    differ = n < left
    out[differ] = data[a[differ] + n[differ]] <= data[b[differ] + n[differ]]
    return out


def sort_suffixes(data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The starts ``at`` in suffix order, each suffix running to ``ends`` of its place.

    First by ``HEAD`` bytes as a number; classes of equal numbers then by mergesort, all runs of a width at once, each
    element of a left run placed by binary search in its sibling run.
    """
    head = np.zeros(len(at), np.uint64)
    for i in range(HEAD):
        p = at + i
        inside = p < ends[at]
        head = (head << np.uint64(8)) | np.where(inside, data[np.where(inside, p, 0)], 0).astype(np.uint64)
    order = np.argsort(head, kind="stable")
    out, head = at[order], head[order]
    new = seeds.sorted_groups(head)
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(out)])
    # only classes of two or more are merged
    several = np.repeat(size > 1, size)
    place = np.flatnonzero(several)
    if not len(place):
        return out
    x = out[place]
    first = np.repeat(begin, size)[place]
    first = first - place + np.arange(len(place))  # where the element's class begins among the merged
    length = np.repeat(size, size)[place]
    sums = seeds.Prefix(data)
    width, most = 1, int(length.max())
    while width < most:
        i = np.arange(len(x)) - first
        is_left = i // width % 2 == 0
        left = np.flatnonzero(is_left)
        sibling = (i[left] // width + 1) * width
        low, high = np.minimum(sibling, length[left]), np.minimum(sibling + width, length[left])
        begin = low.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            # an element passes those of its sibling run that are smaller
            passes = ~_less_equal(data, sums, ends, x[left[todo]], x[first[left[todo]] + mid])
            low[todo] = np.where(passes, mid + 1, low[todo])
            high[todo] = np.where(passes, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        target = first[left] + i[left] + (low - begin)
        merged, free = np.empty_like(x), np.ones(len(x), bool)
        merged[target] = x[left]
        free[target] = False
        merged[free] = x[~is_left]  # the right runs' elements keep their order
        x = merged
        width *= 2
    out[place] = x
    return out


def shared_windows(data: np.ndarray, bounds: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches of bytes (one of ``doc`` each): the places whose ``size`` bytes also start in a smaller doc, and their stretches."""
    length = np.diff(bounds)
    ends = np.repeat(bounds[1:], length)
    at = np.flatnonzero(np.arange(len(data)) + size <= ends)
    if len(at) < 2:
        return at[:0], at[:0]
    own = np.searchsorted(bounds, at, "right") - 1
    sorted_ = sort_suffixes(data, ends, at)
    sums = seeds.Prefix(data)
    a, b = sorted_[:-1], sorted_[1:]
    near = sums.same(a, b, size)
    # the bytes confirm what the hashes say
    hit = np.flatnonzero(near)
    for i in range(0, len(hit), 1 << 16):
        h = hit[i : i + (1 << 16)]
        near[h] = (data[a[h][:, None] + np.arange(size)] == data[b[h][:, None] + np.arange(size)]).all(1)
    new = np.r_[True, ~near]
    docs = doc[np.searchsorted(bounds, sorted_, "right") - 1]
    low = np.minimum.reduceat(docs, np.flatnonzero(new))[np.cumsum(new) - 1]
    gone = np.zeros(len(data), bool)
    gone[sorted_[docs > low]] = True
    keep = gone[at]
    return at[keep], own[keep]


def _sort(size: int):
    """(doc, start, bytes) of stretches -> the runs of windows that the suffix sort finds in a smaller document too."""

    def settle(doc: np.ndarray, start: np.ndarray, values: pa.Array) -> pa.RecordBatch:
        data, bounds = seeds.texts(values)
        at, own = shared_windows(data, bounds, doc, size)
        return seeds.merged(doc, own, at - bounds[own], start)

    return settle


def _windows(size: int):
    def run(values: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        data, bounds = seeds.texts(values)
        raw = data.tobytes()
        ends = np.repeat(bounds[1:], np.diff(bounds))
        at = np.flatnonzero(np.arange(len(data)) + size <= ends)
        own = np.searchsorted(bounds, at, "right") - 1
        return own, at - bounds[own], [raw[i : i + size] for i in at.tolist()]

    return run


def repeats(docs: DataFrame, gram: int = GRAM, size: int = SIZE, most: int = ROWS) -> DataFrame:
    """``doc, start, n``: places ``start .. start + n - 1`` whose ``size`` bytes also start in a smaller doc_id."""
    found = seeds.seek(docs, "byte", gram, size)
    sorted_ = seeds.contested(docs, found, "byte", gram, size, most, _sort(size), _windows(size))
    return found.where("not contested").select("doc", "start", "n").unionAll(sorted_)


def _finish(size: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, rows = seeds.lists(batch.column("at"))
            start = rows.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
            stop = start + rows.field("n").to_numpy(zero_copy_only=False) + size - 1
            size_, gone, spans, digest, kept_text = [], [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                raw = text.as_py() or b""
                b, e = seeds.covered(len(raw), start[cut[i] : cut[i + 1]], stop[cut[i] : cut[i + 1]])
                edges = [0, *np.column_stack([b, e]).ravel().tolist(), len(raw)]
                out = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])) if len(b) else raw
                size_.append(len(raw))
                gone.append(len(raw) - len(out))
                spans.append(len(b))
                digest.append(hashlib.sha256(out).hexdigest())
                kept_text.append(out if texts else None)
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (size_, gone, spans)], pa.array(digest, pa.string()), pa.array(kept_text, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, gram: int = GRAM, size: int = SIZE, texts: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``: each text's UTF-8 bytes without those that repeat a smaller doc_id.

    A byte goes if a string of ``size`` bytes that covers it also starts in a document with a smaller id; strings are
    judged on the input and never cross documents. ``kept`` (binary; a cut may split a character) is null unless
    ``texts``. Null and empty texts have no bytes. Repeats within one document, and rows that repeat an id with its
    text, take nothing from each other; an id must not stand for two texts. A row with a null id loses nothing and
    takes nothing. Other columns are not carried.
    """
    found = repeats(docs, gram, size)
    joined = seeds.with_stretches(docs.select("doc_id", "text"), found, "left").select("doc_id", "text", "at")
    return joined.mapInArrow(_finish(size, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
