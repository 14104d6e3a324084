"""Centroiders: a point's group depends on those of brighter points near it, and on nothing else in its frame.

So all points that no undecided brighter point can reach are decided at once, round by round, with the result of going
through the frame's points from the brightest down. Rounds work on arrays of all points of many frames; Spark deals the
frames out once, and since groups and cells never cross frames, their sums are taken where the frame is: nothing is
shuffled or hashed by group. Points that differ in their id only are interchangeable, so ids aren't needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionsift.model import MOST, BoxCentroid, Watershed
from ionsift.operators.kernels import Extremes, Rows, by_groups, columns, ranges

#: Groups that the watershed makes in a frame, at most; it stops there, and the frame's fainter points are dropped.
MAX_GROUPS = 100_000
#: Points whose boxes are listed at once.
LISTED = 20_000


def places(frame: np.ndarray, scan: np.ndarray, tof: np.ndarray, intensity: np.ndarray, point_id: np.ndarray | None = None) -> np.ndarray:
    """Each point's place, brightest first within its frame; ties: smaller scan, TOF, id (if given, else as they stand)."""
    out = np.empty(len(frame), np.int64)
    out[np.lexsort((*([] if point_id is None else [point_id]), tof, scan, -intensity, frame))] = np.arange(len(frame))
    return out


def sorted_starts(*keys: np.ndarray) -> np.ndarray:
    """Where stretches of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def box_groups(frame: np.ndarray, scan: np.ndarray, tof: np.ndarray, place: np.ndarray, p: BoxCentroid) -> np.ndarray:
    """The place of the seed whose box takes each point.

    A free point that is the brightest free one within twice its box is a seed: no seed before it can reach it or a point
    of its box. It takes all free points of its box.
    """
    out, free, n = np.empty(len(frame), np.int64), np.arange(len(frame)), len(frame)
    s, m = p.scan_half, p.mz_idx_half
    while len(free):
        rows = Rows(frame[free], scan[free], tof[free], 2 * s, 2 * m)
        free = free[rows.order]
        first = n - place[free]  # larger is earlier
        best, every = first, Extremes(first)
        for down in range(-2 * s, 2 * s + 1):
            best = np.maximum(best, every.over(*rows.box(down, -2 * m, 2 * m), 0))
        seeds, taken = Extremes(np.where(best == first, first, 0)), np.zeros(len(free), np.int64)
        for down in range(-s, s + 1):
            taken = np.maximum(taken, seeds.over(*rows.box(down, -m, m), 0))
        out[free[taken > 0]] = n - taken[taken > 0]
        free = free[taken == 0]
    return out


def watershed_groups(frame: np.ndarray, scan: np.ndarray, tof: np.ndarray, intensity: np.ndarray, place: np.ndarray, p: Watershed, max_groups: int = MAX_GROUPS) -> np.ndarray:
    """The place of each point's seed; -1 for none.

    A point joins the group of the nearest placed point in its box (city-block distance; then the brighter seed; then the
    smaller grid cell and place), unless it is too far in TOF from that group's seed; else it seeds a group if bright enough.
    It is decided once all brighter points of its box are.
    """
    n, wide, tall = len(frame), max(1, p.box_scan), max(1, p.box_mz_idx)
    rows = Rows(frame, scan, tof, p.box_scan, p.box_mz_idx)
    frame, scan, tof, intensity, place = (x[rows.order] for x in (frame, scan, tof, intensity, place))
    of_place = np.empty(n, np.int64)
    of_place[place] = np.arange(n)

    def near(some: np.ndarray):
        """(place in ``some``, point) of the points in the boxes of some points, a bounded number of boxes at a time."""
        for b in range(0, len(some), LISTED):
            part = rows.key[some[b : b + LISTED]]
            at, to = [], []
            for down in range(-p.box_scan, p.box_scan + 1):
                k = part + down * rows.wide
                q, own = ranges(np.searchsorted(rows.key, k - p.box_mz_idx), np.searchsorted(rows.key, k + p.box_mz_idx, "right"))
                at.append(own)
                to.append(q)
            yield b + np.concatenate(at), np.concatenate(to)

    waits = np.zeros(n, np.int64)  # brighter points of the box that are not decided
    for at, q in near(np.arange(n)):
        waits += np.bincount(at[place[q] < place[at]], minlength=n)
    group = np.full(n, -1, np.int64)
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        later, chosen = [], np.full(len(ready), -1, np.int64)
        for at, q in near(ready):
            me = ready[at]
            later.append(q[place[q] > place[me]])
            on = (place[q] < place[me]) & (group[q] >= 0)
            at, q, me = at[on], q[on], me[on]
            seed = of_place[group[q]]
            on = np.abs(tof[me] - tof[seed]) <= p.max_tof_offset
            at, q, me, seed = at[on], q[on], me[on], seed[on]
            order = np.lexsort((place[q], tof[q] // tall, scan[q] // wide, -intensity[seed], np.abs(scan[me] - scan[q]) + np.abs(tof[me] - tof[q]), at))
            first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
            chosen[at[first]] = group[q[first]]
        alone = (chosen < 0) & (intensity[ready] >= p.min_seed_intensity)
        chosen[alone] = place[ready[alone]]
        group[ready] = chosen
        less = np.bincount(np.concatenate(later), minlength=n)
        waits -= less
        ready = np.flatnonzero((waits == 0) & (less > 0))
    # a frame is finished with its last seed: fainter points are dropped
    seeds = np.sort(place[group == place])
    own = frame[of_place[seeds]]
    at = np.arange(len(seeds)) - np.searchsorted(own, own)
    last = np.full(int(frame.max(initial=0)) + 1, n, np.int64)
    last[own[at == max_groups - 1]] = seeds[at == max_groups - 1]
    group[(place > last[frame]) | (max_groups < 1)] = -1
    out = np.empty(n, np.int64)
    out[rows.order] = group
    return out


def means(x: np.ndarray, weight: np.ndarray, total: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rounded means of ``x`` over stretches that begin at ``first``, by ``weight`` with sums ``total``; 0 where those are 0."""
    low = np.minimum.reduceat(x, first)
    above = x - np.repeat(low, np.diff(first, append=len(x)))
    if (2 * int(above.max()) + 1) * int(weight.max()) * len(x) >= 1 << 62:
        weight, total = weight.astype(object), total.astype(object)  # whole numbers of any size
    upto = (2 * np.add.reduceat(above * weight, first) + total) // (2 * np.maximum(total, 1))
    return np.where(total == 0, 0, low + upto).astype(np.int64)


def _centroids(points: DataFrame, grouping, least: int) -> DataFrame:
    """``frame_id, scan, tof, intensity``: means of groups of ``least`` intensity; those on one cell of a frame are summed, clipped to 32 bits."""

    def kernel(table: pa.Table, frame: np.ndarray) -> pa.Table:
        scan, tof, intensity = columns(table, "scan", "tof", "intensity")
        group = grouping(frame, scan, tof, intensity, places(frame, scan, tof, intensity))
        order = np.argsort(group, kind="stable")
        order = order[np.searchsorted(group[order], 0) :]  # without those that have no group
        first = sorted_starts(group[order])
        at, s, t, total = order[first], scan[:0], tof[:0], intensity[:0]
        if len(first):
            weight = intensity[order]
            if int(weight.max()) * len(weight) >= 1 << 62:
                weight = weight.astype(object)
            total = np.add.reduceat(weight, first)
            s, t = (means(x[order], weight, total, first) for x in (scan, tof))
            enough = total >= least
            at, s, t, total = at[enough], s[enough], t[enough], total[enough]
        cell = np.lexsort((t, s, frame[at]))
        at, s, t, total = at[cell], s[cell], t[cell], total[cell]
        first = sorted_starts(frame[at], s, t)
        total = np.minimum(np.add.reduceat(total, first), MOST) if len(first) else total
        return pa.table([table["frame_id"].take(pa.array(at[first])), pa.array(s[first].astype(np.int32)), pa.array(t[first]), pa.array(total)], names=["frame_id", "scan", "tof", "intensity"])

    needed = points.select(F.col("frame_id").cast("long").alias("frame_id"), "scan", "tof", "intensity")
    return by_groups(needed, ("frame_id",), kernel, "frame_id long, scan int, tof long, intensity long")


def watershed(points: DataFrame, p: Watershed = Watershed(), max_groups: int = MAX_GROUPS) -> DataFrame:
    """``frame_id, scan, tof, intensity``: intensity-weighted means of watershed groups; those on one cell are summed.

    A frame with ``max_groups`` groups is finished: its remaining, fainter points are dropped.
    """
    return _centroids(points, lambda *x: watershed_groups(*x, p, max_groups), max(p.min_centroid_total, 0))


def box_centroid(points: DataFrame, p: BoxCentroid = BoxCentroid()) -> DataFrame:
    """``frame_id, scan, tof, intensity``: intensity-weighted means of small boxes around the brightest free points."""
    return _centroids(points, lambda frame, scan, tof, intensity, place: box_groups(frame, scan, tof, place, p), max(p.min_total, 1))
