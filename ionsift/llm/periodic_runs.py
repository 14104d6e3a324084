"""Periodic run detection with bit-parallel lags.

The words of a text become numbers and the numbers bit planes, each one big integer with a bit for every word. For a lag q
the planes are XORed with themselves shifted by q and the mismatches ORed, so a stretch of zeros is a stretch of words
that equal the word q places on. ANDs with shifts that double leave only the stretches that are long enough.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ionsift.llm.common import fresh

RUNS = ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("period", LongType()))
#: Lags from here on are first looked at on the multiples of the lag.
GRID_FROM = 256
#: Texts of a batch are answered in groups of at most so many bytes (or one text).
GROUP = 8 << 20


@dataclass(frozen=True)
class Runs:
    """A run has at least ``words`` words and ``repeats`` periods."""

    words: int = 24
    repeats: int = 3

    def __post_init__(self):
        if self.words < 2 or self.repeats < 2:
            raise ValueError("a run has two words and two periods at least")


def planes(ids: np.ndarray) -> list[int]:
    """One integer for each bit of the numbers: bit i of it belongs to word i."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]


def long_ones(x: int, n: int) -> int:
    """Bit i stays where bits i .. i + n - 1 of ``x`` are all ones."""
    have = 1
    while have < n and x:
        step = min(have, n - have)
        x &= x >> step
        have += step
    return x


def stretches(x: int, n: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of ones among the ``n`` lowest bits."""
    bits = np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(bits, prepend=np.uint8(0), append=np.uint8(0)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _on_grid(ids: np.ndarray, q: int) -> bool:
    """Whether two multiples of q in a row hold the word q places on; words that repeat over 2q places always do so."""
    at = ids[::q]
    same = at[1:] == at[:-1]
    return bool((same[1:] & same[:-1]).any())


def find_runs(ids: np.ndarray, how: Runs = Runs()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the numbers, by start and period.

    With at least two periods, a stretch that repeats at lag q and has a smaller period p has its largest common divisor
    as a period too, so it is the very run found at that smaller lag; such bits are cleared before they are read.
    """
    n, out = len(ids), []
    if n < how.words:
        return out
    plane, known = planes(ids), defaultdict(list)  # lag -> runs of a divisor of it
    for q in range(1, n // how.repeats + 1):
        again = known.pop(q, ())
        if q >= GRID_FROM and not _on_grid(ids, q):
            continue
        need = max(how.words - q, (how.repeats - 1) * q)
        whole, miss, left = (1 << (n - q)) - 1, 0, 1
        for k in range(0, len(plane), 2):  # two planes decide most lags
            for p in plane[k : k + 2]:
                miss |= p ^ (p >> q)
            left = long_ones(whole & ~miss, need)
            if not left:
                break
        for start, length in again:
            left &= ~(((1 << (length - q - need + 1)) - 1) << start)
        if not left:
            continue
        for begin, end in stretches(left, n):
            length = end - begin + need - 1 + q
            out.append((begin, length, q))
            for m in range(2 * q, length // how.repeats + 1, q):
                known[m].append((begin, length))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: it lies in no run, or in the first period of every run that holds it."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def _rows(text: str, how: Runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, starts, lengths, periods, cuts, out, begin, held = [], [], [], [], [0], [], 0, 0

            def flush(end: int) -> pa.RecordBatch:
                part = batch.slice(begin, end - begin)
                runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], ["start", "length", "period"]))
                return pa.record_batch([*part.columns, pa.array(n, pa.int64()), runs, pa.array(out, pa.binary()).cast(pa.string())], names=[*part.schema.names, "n", "runs", "collapsed"])

            for i, value in enumerate(batch.column(text).cast(pa.binary())):
                words = (value.as_py() or b"").split()
                number: dict[bytes, int] = {}
                ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                found = find_runs(ids, how)
                if found:
                    words = [words[k] for k in np.flatnonzero(kept(len(words), found))]
                for column, values in zip((starts, lengths, periods), zip(*found)):
                    column.extend(values)
                n.append(len(ids))
                cuts.append(len(starts))
                out.append(b" ".join(words))
                held += len(out[-1])
                if held > GROUP:
                    yield flush(i + 1)
                    n, starts, lengths, periods, cuts, out, begin, held = [], [], [], [], [0], [], i + 1, 0
            if n:
                yield flush(batch.num_rows)

    return run


def with_runs(docs: DataFrame, how: Runs = Runs(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``runs`` (array of start, length, period, by start and period) and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest period q (words q apart are
    equal) that no neighbouring word extends. ``collapsed`` holds the words that lie in no run or in the first q words of
    every run that holds them, joined by blanks. Null and empty texts have no words, no runs and an empty ``collapsed``.
    Rows, repeats and null ids stay as they are; a column of ``docs`` that has one of the three names gives way. No shuffle:
    a text is held by one task, and nothing else is.
    """
    added = ("n_words", "runs", "collapsed")
    rest = [c for c in docs.columns if c.lower() not in added]
    own = fresh(docs, "__text")
    row = F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias(fresh(docs, "__none")))
    slim = docs.select(row.alias("row"), F.col(text).cast("string").alias(own))
    schema = StructType(list(slim.schema.fields)).add("n", LongType()).add("runs", RUNS).add("collapsed", StringType())
    made = slim.mapInArrow(_rows(own, how), schema)
    return made.select(*[F.col("row")[c].alias(c) for c in rest], F.col("n").alias("n_words"), "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """Of runs by start and period, the one with the greatest exact length / period; the first of equals; null for none."""
    better = lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.try_element_at(runs, F.lit(1)), better))


def as_lines(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
