"""Arrow kernels for whole groups of points (a frame, a window, a precursor's spectrum), vectorised over many groups at once.

``by_groups`` deals the points out by group, so each point is shuffled once, and hands a kernel whole groups until a few
hundred thousand points are there; a group is the largest unit that a task holds. Kernels see the group as a number and
work on sorted integer keys, so neither a point nor a scan is ever visited in a Python loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ionsift.model import MOST, Halo, Smooth, Streak

#: Points that a kernel is given at once, unless one group has more.
ROWS = 200_000


def by_groups(points: DataFrame, by: tuple[str, ...], kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType | str | None = None) -> DataFrame:
    """Applies ``kernel(points, group numbers)`` to whole groups of ``by``; nulls of ``by`` are a group too.

    Points are dealt out by the first column of ``by``, as a struct: mapInArrow asks for no distribution, so where a join
    before deals by the plain column, Spark leaves out an equal repartition, and may then broadcast the join's other side
    at run time and read the points as they were, which tears groups apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, due = 0, ROWS

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            keys = [c for name in by for c in (table[name].is_null().to_numpy(), table[name].fill_null(0).to_numpy())]
            new = np.zeros(table.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            end = table.num_rows if last else int(new.nonzero()[0].max(initial=0))  # the last group may go on
            held[:] = table.slice(end).to_batches()
            if end:
                yield from kernel(table.slice(0, end).combine_chunks(), np.cumsum(new[:end])).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= due:
                    yield from flush(False)
                    rows = sum(b.num_rows for b in held)
                    due = rows + max(rows, ROWS)  # a group that goes on and on is looked at seldom
        if held:
            yield from flush(True)

    return points.repartition(F.struct(by[0])).sortWithinPartitions(*by).mapInArrow(run, schema or points.schema)


def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy().astype(np.int64) for n in names]


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and for each the place of its range."""
    n = np.maximum(end - begin, 0)
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) - (np.cumsum(n) - n)[own] + begin[own], own


class Rows:
    """Points sorted by group, scan and TOF; boxes around points are ranges of such rows, one for each scan of the box."""

    def __init__(self, group: np.ndarray, scan: np.ndarray, tof: np.ndarray, reach_scan: int, reach_tof: int):
        # margins keep a box from reaching into the next scan or group
        self.wide = int(tof.max(initial=0)) + 2 * reach_tof + 2
        self.tall = int(scan.max(initial=0)) + 2 * reach_scan + 2
        line = group * self.tall + scan + reach_scan
        self.order = np.lexsort((tof, line))
        self.key = (line * self.wide + tof + reach_tof)[self.order]
        if len(line) and (int(line.max()) + 1) * self.wide > 1 << 62:
            raise ValueError("indices of scans and TOF are too large")

    def box(self, down: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For each sorted row the range of rows ``down`` scans on, from TOF + low to TOF + high."""
        at = self.key + down * self.wide
        return np.searchsorted(self.key, at + low), np.searchsorted(self.key, at + high, "right")


class Extremes:
    """Largest values of ranges, by a table of the maxima of 1, 2, 4, ... values from each place on."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (step := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-step], last[step:]))

    def over(self, begin: np.ndarray, end: np.ndarray, empty: int) -> np.ndarray:
        n = end - begin
        out = np.full(len(n), empty, np.int64)
        level = np.frexp(np.maximum(n, 1))[1] - 1
        for k in np.unique(level[n > 0]):
            at = np.flatnonzero((level == k) & (n > 0))
            out[at] = np.maximum(self.levels[k][begin[at]], self.levels[k][end[at] - (1 << int(k))])
        return out


def streak_mask(group: np.ndarray, scan: np.ndarray, tof: np.ndarray, intensity: np.ndarray, p: Streak) -> np.ndarray:
    """Whether each point lies on a run of its TOF index (one pass).

    The points of a profile are a range of the points in TOF order, between the places where the window's events stand.
    """
    w, tall = p.mz_half_width, int(scan.max(initial=0)) + p.max_internal_gap + 3
    key = group * (int(tof.max(initial=0)) + 2 * w + 2) + tof + w
    order = np.argsort(key, kind="stable")
    centres, own = np.unique(key, return_inverse=True)
    near, at = ranges(np.searchsorted(key[order], centres - w), np.searchsorted(key[order], centres + w, "right"))
    cell = at * tall + scan[order[near]]
    by_cell = np.argsort(cell, kind="stable")
    cell, first = np.unique(cell[by_cell], return_index=True)
    value = np.add.reduceat(intensity[order[near[by_cell]]], first) if len(first) else np.zeros(0, np.int64)
    cell, value = cell[value > 0], value[value > 0]
    total = np.cumsum(value)
    on = value >= p.min_window_intensity
    cell, value, total = cell[on], value[on], total[on]
    if not len(cell):
        return np.zeros(len(scan), bool)
    # keys of two centres lie over the gap apart, as scans leave a margin
    starts = np.flatnonzero(np.r_[True, np.diff(cell) > p.max_internal_gap + 1])
    ends = np.r_[starts[1:], len(cell)] - 1
    good = (ends - starts + 1 >= p.min_feature_length) & (total[ends] - total[starts] + value[starts] >= p.min_feature_intensity)
    begin, end = cell[starts[good]], cell[ends[good]]
    mine = own * tall + scan
    run = np.searchsorted(begin, mine, "right") - 1
    return (run >= 0) & (mine <= end[np.maximum(run, 0)]) if len(begin) else np.zeros(len(scan), bool)


def halo_mask(group: np.ndarray, scan: np.ndarray, tof: np.ndarray, intensity: np.ndarray, p: Halo) -> np.ndarray:
    """Whether each point is not outshone by another TOF index of its box."""
    s, m = p.scan_half_width, p.mz_idx_half_width
    if m < 1 or not len(scan):
        return np.ones(len(scan), bool)
    rows = Rows(group, scan, tof, s, m)
    bright = Extremes(intensity[rows.order])
    best = np.zeros(len(scan), np.int64)
    for down in range(-s, s + 1):
        for low, high in ((-m, -1), (1, m)):
            best = np.maximum(best, bright.over(*rows.box(down, low, high), 0))
    out = np.empty(len(scan), bool)
    out[rows.order] = intensity[rows.order].astype(np.float64) >= float(p.peak_fraction) * best.astype(np.float64)
    return out


def smoothed(group: np.ndarray, scan: np.ndarray, tof: np.ndarray, intensity: np.ndarray, p: Smooth) -> np.ndarray:
    """Rounded means over the points of each box (one pass), by sums up to each row."""
    if not len(scan):
        return intensity
    s, m = p.scan_half_width, p.mz_idx_half_width
    rows = Rows(group, scan, tof, s, m)
    upto = np.r_[0, np.cumsum(intensity[rows.order])]
    total, n = np.zeros(len(scan), np.int64), np.zeros(len(scan), np.int64)
    for down in range(-s, s + 1):
        begin, end = rows.box(down, -m, m)
        total += upto[end] - upto[begin]
        n += end - begin
    out = np.empty(len(scan), np.int64)
    out[rows.order] = (total + n // 2) // n
    return out


def survivors(group: np.ndarray, scan: np.ndarray, tof: np.ndarray, intensity: np.ndarray, p: Streak | None, h: Halo | None) -> np.ndarray:
    """Row numbers of the points that the streak filter, ``iterations`` times, and then the halo leave."""
    alive = np.arange(len(scan))
    steps = [lambda *x: streak_mask(*x, p)] * (p.iterations if p else 0) + ([lambda *x: halo_mask(*x, h)] if h else [])
    for step in steps:
        alive = alive[step(group[alive], scan[alive], tof[alive], intensity[alive])]
    return alive


def clean(points: DataFrame, by: tuple[str, ...], p: Streak | None = None, h: Halo | None = None) -> DataFrame:
    """Streak filter on its own survivors, then the halo; all within one shuffle."""
    if not (p and p.iterations) and (h is None or h.mz_idx_half_width < 1):
        return points

    def kernel(table: pa.Table, group: np.ndarray) -> pa.Table:
        return table.take(pa.array(survivors(group, *columns(table, "scan", "tof", "intensity"), p, h)))

    return by_groups(points, by, kernel)


def summed(points: DataFrame, by: tuple[str, ...], p: Streak, h: Halo | None = None) -> DataFrame:
    """``by, scan, tof`` of the cells that survive in each group's summed spectrum (sums clipped to 32 bits), within one shuffle."""
    rows = points.select(*by, "scan", "tof", "intensity")

    def kernel(table: pa.Table, group: np.ndarray) -> pa.Table:
        scan, tof, intensity = columns(table, "scan", "tof", "intensity")
        order = np.lexsort((tof, scan, group))
        new = np.ones(len(order), bool)
        new[1:] = False
        for c in (group, scan, tof):
            new[1:] |= np.diff(c[order]) != 0
        first = order[new]
        total = np.minimum(np.add.reduceat(intensity[order], np.flatnonzero(new)), MOST)
        kept = first[survivors(group[first], scan[first], tof[first], total, p, h)]
        return table.select([*by, "scan", "tof"]).take(pa.array(kept))

    return by_groups(rows, by, kernel, rows.select(*by, "scan", "tof").schema)


def smooth(points: DataFrame, p: Smooth, by: tuple[str, ...]) -> DataFrame:
    """Intensities become the rounded means over their boxes, ``iterations`` times."""

    def kernel(table: pa.Table, group: np.ndarray) -> pa.Table:
        scan, tof, intensity = columns(table, "scan", "tof", "intensity")
        for _ in range(p.iterations):
            intensity = smoothed(group, scan, tof, intensity, p)
        at = table.schema.get_field_index("intensity")
        return table.set_column(at, table.schema.field(at), pa.array(intensity).cast(table.schema.field(at).type))

    return by_groups(points, by, kernel) if p.iterations else points
