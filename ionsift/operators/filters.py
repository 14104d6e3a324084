"""Noise filters: vertical streaks, horizontal halos, and their cross-frame and per-window forms.

All keep a subset of the points. ``by`` names the columns within which neighbours count (a frame, a window, a precursor).
The streak filter and the halo have two forms with the same rows: ``arrow`` hands whole groups to kernels, so each point is
shuffled once for all passes; ``sql`` stays in the JVM, at the price of a copy of each point for each row of its box.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionsift.functions.scalars import numbered
from ionsift.model import MOST, Halo, Streak
from ionsift.operators import kernels

FRAME = ("frame_id",)


def streak_runs(points: DataFrame, p: Streak, by: tuple[str, ...] = FRAME) -> DataFrame:
    """``by, c, s0, s1``: for each TOF index c that occurs, the scan spans of runs that are long and bright enough.

    The profile of c sums intensities of TOF c - w .. c + w by scan. A scan is occupied if its sum is positive and reaches
    the window floor; runs break where occupied scans lie more than the gap + 1 apart; length counts occupied scans, the
    intensity of a run sums its whole span.
    """
    centres = points.select(*by, F.col("tof").alias("c")).distinct()
    w = p.mz_half_width
    cells = points.groupBy(*by, "scan", "tof").agg(F.sum("intensity").alias("intensity"))
    spread = cells.select(*by, "scan", "intensity", F.explode(F.sequence(F.col("tof") - w, F.col("tof") + w)).alias("c")) if w else cells.select(*by, "scan", "intensity", F.col("tof").alias("c"))
    if w:
        spread = spread.join(centres, [*by, "c"], "left_semi")
    profile = spread.groupBy(*by, "c", "scan").agg(F.sum("intensity").alias("v")).where("v > 0")
    along = Window.partitionBy(*by, "c").orderBy("scan")
    running = along.rowsBetween(Window.unboundedPreceding, 0)
    summed = profile.withColumn("cs", F.sum("v").over(running)).where(F.col("v") >= p.min_window_intensity)
    broken = summed.withColumn("brk", F.when(F.col("scan") - F.lag("scan").over(along) > p.max_internal_gap + 1, 1).otherwise(0))
    runs = broken.withColumn("run", F.sum("brk").over(running)).groupBy(*by, "c", "run").agg(F.min("scan").alias("s0"), F.max("scan").alias("s1"), F.count(F.lit(1)).alias("n"), (F.max("cs") - F.min(F.col("cs") - F.col("v"))).alias("total"))
    return runs.where((F.col("n") >= p.min_feature_length) & (F.col("total") >= p.min_feature_intensity)).select(*by, "c", "s0", "s1")


def streak_once(points: DataFrame, p: Streak = Streak(), by: tuple[str, ...] = FRAME, form: str = "arrow") -> DataFrame:
    """Points that lie on a run of their own TOF index, faint ones within its span too."""
    if form == "arrow":
        return kernels.clean(points, by, replace(p, iterations=1))
    runs = streak_runs(points, p, by)
    here = points.alias("p")
    on = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in by] + [F.col("p.tof") == F.col("r.c"), F.col("p.scan").between(F.col("r.s0"), F.col("r.s1"))]
    return here.join(runs.alias("r"), on, "left_semi")


def streak(points: DataFrame, p: Streak = Streak(), by: tuple[str, ...] = FRAME, form: str = "arrow") -> DataFrame:
    """The streak filter applied to its own survivors, ``p.iterations`` times; 0 keeps all. Longer SQL chains are cut by checkpoints."""
    if form == "arrow":
        return kernels.clean(points, by, p)
    for i in range(p.iterations):
        points = streak_once(points, p, by, form)
        if i % 3 == 2 and i + 1 < p.iterations and not points.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            points = points.checkpoint()
    return points


def halo(points: DataFrame, p: Halo, by: tuple[str, ...] = FRAME, form: str = "arrow") -> DataFrame:
    """Drops points fainter than a fraction of the brightest point of another TOF index in the box around them; points alone stay.

    In SQL each point visits the scans of its box, so the box becomes two RANGE frames over TOF and no join is needed.
    """
    if form == "arrow":
        return kernels.clean(points, by, None, p)
    s, m = p.scan_half_width, p.mz_idx_half_width
    if m < 1:
        return points
    out = points.columns
    spread = points.withColumn("__d", F.explode(F.sequence(F.lit(-s), F.lit(s)))).withColumn("__scan", F.col("scan") + F.col("__d"))
    order = Window.partitionBy(*by, "__scan").orderBy("tof")
    left, right = (F.max("intensity").over(order.rangeBetween(*r)) for r in ((-m, -1), (1, m)))
    seen = spread.withColumns({"__l": left, "__r": right}).where("__d = 0")
    best = F.greatest(F.coalesce("__l", F.lit(0)), F.coalesce("__r", F.lit(0))).cast("double")
    return seen.where(F.col("intensity").cast("double") >= F.lit(float(p.peak_fraction)) * best).select(*out)


def clean(points: DataFrame, p: Streak, h: Halo | None, by: tuple[str, ...] = FRAME, form: str = "arrow") -> DataFrame:
    """The streak filter and, if given, the halo on its survivors."""
    if form == "arrow":
        return kernels.clean(points, by, p, h)
    kept = streak(points, p, by, form)
    return halo(kept, h, by, form) if h else kept


def combine(points: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Intensities summed per cell of ``by``, clipped to 32 bits."""
    return points.groupBy(*by, "scan", "tof").agg(F.least(F.sum("intensity"), F.lit(MOST)).alias("intensity"))


def combine_and_filter(points: DataFrame, p: Streak, h: Halo | None, by: tuple[str, ...], form: str = "arrow") -> DataFrame:
    """Keys ``by, scan, tof`` of the combined spectrum that survive the streak filter and, if given, the halo."""
    if form == "arrow":
        return kernels.summed(points, by, p, h)
    return clean(combine(points, by), p, h, by, form).select(*by, "scan", "tof")


def neighbourhood_filter(points: DataFrame, frames: DataFrame, r: int, p: Streak, h: Halo | None = None) -> DataFrame:
    """MS1 points whose cell survives filtering of the summed spectrum of the frames up to ``r`` MS1 positions away.

    Positions count MS1 frames in order of frame_id; empty ones hold a position and add nothing.
    """
    place = numbered(frames.where("ms_ms_type = 0").select("frame_id"), "__at")
    centres = place.select(F.col("frame_id").alias("__centre"), F.explode(F.sequence(F.col("__at") - r, F.col("__at") + r)).alias("__at"))
    near = place.join(centres, "__at").select("frame_id", "__centre")
    spread = points.select("frame_id", "scan", "tof", "intensity").join(near, "frame_id")
    keys = combine_and_filter(spread, p, h, ("__centre",)).withColumnRenamed("__centre", "frame_id")
    return points.join(keys, ["frame_id", "scan", "tof"], "left_semi").select(*points.columns)


def with_precursor(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``precursor``: that of the frame's first window (by begin, then event) that holds the scan; null outside all."""
    listed = windows.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("scan_begin", "event", "scan_end", "precursor"))).alias("__w"))
    inside = F.filter("__w", lambda w: (w["scan_begin"] <= F.col("scan")) & (F.col("scan") < w["scan_end"]))
    return points.join(listed, "frame_id", "left").withColumn("precursor", F.try_element_at(inside, F.lit(1))["precursor"]).drop("__w")


def precursor_keys(points: DataFrame, windows: DataFrame, p: Streak, h: Halo | None = None) -> DataFrame:
    """``precursor, scan, tof`` cells that survive in the spectra summed by precursor; id 0 keeps nothing."""
    summed = with_precursor(points, windows).where("precursor is not null and precursor != 0")
    return combine_and_filter(summed, p, h, ("precursor",))


def precursor_filter(points: DataFrame, windows: DataFrame, p: Streak, h: Halo | None = None, keys: DataFrame | None = None) -> DataFrame:
    """MS/MS points in no window stay; the others stay if their cell survives in their precursor's summed spectrum.

    ``keys``, the surviving cells, are computed from ``points`` unless they are given.
    """
    owned = with_precursor(points, windows)
    kept = (precursor_keys(points, windows, p, h) if keys is None else keys).withColumn("__kept", F.lit(True))
    joined = owned.join(kept, ["precursor", "scan", "tof"], "left")
    return joined.where("precursor is null or __kept").select(*points.columns)


def per_window_filter(points: DataFrame, windows: DataFrame, p: Streak, h: Halo | None = None) -> DataFrame:
    """Streak filter (and halo) within each of a frame's disjoint intervals; points outside all are dropped.

    A frame without intervals is filtered whole.
    """
    listed = windows.groupBy("frame_id").agg(F.collect_list(F.struct("scan_begin", "scan_end")).alias("__w"))
    begin = F.try_element_at(F.filter("__w", lambda w: (w["scan_begin"] <= F.col("scan")) & (F.col("scan") < w["scan_end"])), F.lit(1))["scan_begin"]
    placed = points.join(listed, "frame_id", "left").withColumn("__window", F.when(F.col("__w").isNull(), -1).otherwise(begin)).where("__window is not null").drop("__w")
    return clean(placed, p, h, ("frame_id", "__window")).select(*points.columns)
