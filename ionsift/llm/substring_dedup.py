"""Substring dedup over words: seed on winnowed anchors, extend the matches both ways, keep what reaches the threshold.

Documents are joined on the anchors of their segments. Equal segments are one match; of different segments under one
anchor the match is extended word by word to either side, as far as the segments go, and kept as a maximal repeat where
it reaches the threshold. The extension compares the words themselves: equal stretches of doubling length get equal
ranks, so all matches under an anchor are extended at once instead of pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ionsift.llm import seeds

GRAM, SIZE = 4, 13
#: Contested segments held at once in a task, about.
ROWS = 1 << 15


def ranks(units: np.ndarray, size: int) -> np.ndarray:
    """A number for each ``size`` neighbouring units, equal exactly where the units are."""
    rank, have = np.unique(units, return_inverse=True)[1].astype(np.int64), 1
    while have < size and len(rank):
        step = min(have, size - have)
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def _words(values: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Words of the stretches in a row, and each stretch's bounds."""
    split = [v.as_py().split() for v in values]
    return [w for v in split for w in v], np.concatenate([[0], np.cumsum([len(v) for v in split])]).astype(np.int64)


def _starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of all windows that lie within one stretch."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


def extend(size: int):
    """(doc, start, words) of segments -> the maximal repeats that also stand in a smaller document."""

    def settle(doc: np.ndarray, start: np.ndarray, values: pa.Array) -> pa.RecordBatch:
        words, bounds = _words(values)
        own, at = _starts(bounds, size)
        window = ranks(pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(), size)[bounds[own] + at]
        low = np.full(int(window.max()) + 1 if len(window) else 0, np.iinfo(np.int64).max)
        np.minimum.at(low, window, doc[own])
        again = doc[own] > low[window]
        return seeds.merged(doc, own[again], at[again], start)

    return settle


def _windows(size: int):
    def run(values: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        words, bounds = _words(values)
        own, at = _starts(bounds, size)
        return own, at, [b" ".join(words[i : i + size]) for i in (bounds[own] + at).tolist()]

    return run


def repeats(docs: DataFrame, gram: int = GRAM, size: int = SIZE, most: int = ROWS) -> DataFrame:
    """``doc, start, n``: windows ``start .. start + n - 1`` (of ``size`` words each) that also start in a smaller doc_id."""
    found = seeds.seek(docs, "word", gram, size)
    extended = seeds.contested(docs, found, "word", gram, size, most, extend(size), _windows(size))
    return found.where("not contested").select("doc", "start", "n").unionAll(extended)


def _finish(size: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, rows = seeds.lists(batch.column("at"))
            start = rows.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
            stop = start + rows.field("n").to_numpy(zero_copy_only=False) + size - 1
            words_, gone, digest, kept_text = [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                words = (text.as_py() or b"").split()
                b, e = seeds.covered(len(words), start[cut[i] : cut[i + 1]], stop[cut[i] : cut[i + 1]])
                kept = words
                if len(b):
                    edges = [0, *np.column_stack([b, e]).ravel().tolist(), len(words)]
                    kept = [w for x, y in zip(edges[::2], edges[1::2]) for w in words[x:y]]
                out = b" ".join(kept)
                words_.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(out).hexdigest())
                kept_text.append(out if texts else None)
            yield pa.record_batch([batch.column("doc_id"), pa.array(words_, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, gram: int = GRAM, size: int = SIZE, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept``: each document without the words that repeat a smaller doc_id.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``size`` words that covers it also starts in a
    document with a smaller id; windows are judged on the input. Null and empty texts have no words. Repeats within
    one document, and rows that repeat an id with its text, take nothing from each other; an id must not stand for
    two texts. ``kept`` is null unless ``texts``. A row with a null id loses nothing and takes nothing. Other columns are not carried.
    """
    found = repeats(docs, gram, size)
    joined = seeds.with_stretches(docs.select("doc_id", "text"), found, "left").select("doc_id", "text", "at")
    return joined.mapInArrow(_finish(size, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
