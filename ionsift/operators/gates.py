"""Geometric gates: predicates on a point's place; each does nothing where its geometry is missing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionsift.functions.scalars import mz_to_tof, scan_to_im
from ionsift.model import Calibration, Crop, Pads

#: Scans of a run whose gate is broadcast, at most: a gate has one row for each scan.
MOST_SCANS = 500_000


def merge_intervals(df: DataFrame, by: tuple[str, ...], begin: str = "scan_begin", end: str = "scan_end") -> DataFrame:
    """Half-open intervals merged where they touch or overlap; empty ones go."""
    order = Window.partitionBy(*by).orderBy(begin, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.where(F.col(end) > F.col(begin)).withColumn("__new", F.when(F.col(begin) <= before, 0).otherwise(1))
    numbered = flagged.withColumn("__k", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__k").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("__k")


def dia_intervals(info: DataFrame, windows: DataFrame) -> DataFrame:
    """``frame_id, scan_begin, scan_end``: each frame's merged intervals through its window group."""
    merged = merge_intervals(windows.select("window_group", "scan_begin", "scan_end"), ("window_group",))
    return info.join(merged, "window_group").select("frame_id", "scan_begin", "scan_end")


def dda_intervals(pasef: DataFrame) -> DataFrame:
    return merge_intervals(pasef.select("frame_id", "scan_begin", "scan_end"), ("frame_id",))


def dia_boxes(windows: DataFrame) -> DataFrame:
    """``scan_begin, scan_end, mz_lo, mz_hi`` of distinct complete windows."""
    w = windows.select("scan_begin", "scan_end", "isolation_mz", "isolation_width").distinct().dropna().where("scan_end > scan_begin")
    half = F.col("isolation_width") / 2
    return w.select("scan_begin", "scan_end", (F.col("isolation_mz") - half).alias("mz_lo"), (F.col("isolation_mz") + half).alias("mz_hi"))


def in_window(points: DataFrame, intervals: DataFrame, pad: int = 0) -> DataFrame:
    """Points in one of their frame's intervals, widened by ``pad`` scans; frames that are not listed pass whole."""
    listed = intervals.groupBy("frame_id").agg(F.collect_list(F.struct("scan_begin", "scan_end")).alias("__w"))
    inside = F.exists("__w", lambda w: (F.col("scan") >= w["scan_begin"] - pad) & (F.col("scan") < w["scan_end"] + pad))
    return points.join(listed, "frame_id", "left").where(F.col("__w").isNull() | inside).select(*points.columns)


def by_scan(gate: DataFrame) -> DataFrame:
    """``scan, tof_lo, tof_hi`` spans -> one row for each scan: its spans merged, their ends in two sorted arrays.

    ``steps`` are the powers of two, falling, that a binary search over them takes.
    """
    half_open = merge_intervals(gate.select("scan", "tof_lo", (F.col("tof_hi") + 1).alias("tof_end")), ("scan",), "tof_lo", "tof_end")
    listed = half_open.groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("tof_lo", "tof_end"))).alias("s"))
    steps = F.transform(F.sequence(F.floor(F.log2(F.size("s"))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return listed.select("scan", F.col("s.tof_lo").alias("__lo"), F.col("s.tof_end").alias("__end"), steps.alias("__steps"))


def _within(points: DataFrame, gate: DataFrame, num_scans: int, open_if_empty: bool = False) -> DataFrame:
    """Points in a span of their scan, found by binary search. A gate (spans, or ``by_scan`` of them) without spans lets nothing or, if asked to, all pass."""
    merged = gate if "__lo" in gate.columns else by_scan(gate)
    merged = F.broadcast(merged) if num_scans <= MOST_SCANS else merged
    # spans that begin at or before the point: the last of them is the only one that can hold it
    n = F.aggregate("__steps", F.lit(0), lambda n, step: F.when((n + step <= F.size("__lo")) & (F.get("__lo", n + step - 1) <= F.col("tof")), n + step).otherwise(n))
    inside = F.coalesce(F.col("tof") < F.get("__end", n - 1), F.lit(False))
    if open_if_empty:
        inside = inside | (gate.agg(F.count(F.lit(1))).scalar() == 0)
    return points.join(merged, "scan", "left" if open_if_empty else "inner").where(inside).select(*points.columns)


def box_gate_table(boxes: DataFrame, num_scans: int, c: Calibration, pads: Pads = Pads()) -> DataFrame:
    """``scan, tof_lo, tof_hi``: the boxes padded in Da and 1/K0, widened to whole indices, clipped to the run's scans."""
    ends = [mz_to_tof(F.greatest(F.col("mz_lo") - pads.mz_pad, F.lit(0.0)), c), mz_to_tof(F.greatest(F.col("mz_hi") + pads.mz_pad, F.lit(0.0)), c)]
    ims = [scan_to_im(F.col("scan_begin"), c), scan_to_im(F.col("scan_end"), c)]
    scans = [(F.least(*ims) - pads.im_pad - c.c) / c.d, (F.greatest(*ims) + pads.im_pad - c.c) / c.d]
    last = num_scans - 1
    b = boxes.select(
        F.greatest(F.floor(F.least(*ends)), F.lit(0)).alias("tof_lo"), F.greatest(F.ceil(F.greatest(*ends)), F.lit(0)).alias("tof_hi"),
        F.least(F.greatest(F.floor(F.least(*scans)), F.lit(0)), F.lit(last)).cast("int").alias("s0"), F.least(F.greatest(F.ceil(F.greatest(*scans)), F.lit(0)), F.lit(last)).cast("int").alias("s1"),
    )
    return b.select(F.explode(F.sequence("s0", "s1")).alias("scan"), "tof_lo", "tof_hi").distinct()


def dia_ms1_gate(points: DataFrame, boxes: DataFrame | None, num_scans: int, c: Calibration, pads: Pads = Pads(), built: DataFrame | None = None) -> DataFrame:
    """MS1 points inside any padded isolation box; ``built`` is the gate by scan, if it is there already."""
    return points if boxes is None or num_scans < 1 else _within(points, built if built is not None else box_gate_table(boxes, num_scans, c, pads), num_scans)


def polygon_gate_table(spark: SparkSession, ring: list[tuple[float, float]], num_scans: int, c: Calibration, pads: Pads = Pads()) -> DataFrame | None:
    """``scan, tof_lo, tof_hi`` inside the ring of (m/z, 1/K0), or None for fewer than three corners or no scans.

    Each scan is cut at its own 1/K0 and, with a mobility pad, at that much below and above: the three cuts' spans count
    together. Crossings of the ring's edges are paired in order (even-odd rule).
    """
    if len(ring) < 3 or num_scans < 1:
        return None
    edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (*a, *b))]) for a, b in zip(ring, [*ring[1:], ring[0]])])
    scans = spark.range(num_scans).select(F.col("id").cast("int").alias("scan"))
    cuts = [0.0] if pads.im_pad == 0 else [-pads.im_pad, 0.0, pads.im_pad]
    lines = scans.withColumn("y", F.explode(F.transform(F.array(*map(F.lit, cuts)), lambda d: scan_to_im(F.col("scan"), c) + d)))
    crossed = F.filter(edges, lambda e: (e["y0"] > F.col("y")) != (e["y1"] > F.col("y")))
    xs = F.array_sort(F.transform(crossed, lambda e: e["x0"] + (F.col("y") - e["y0"]) / (e["y1"] - e["y0"]) * (e["x1"] - e["x0"])))
    lines = lines.withColumn("xs", xs).where(F.size("xs") >= 2)
    spans = lines.select("scan", F.explode(F.transform(F.sequence(F.lit(1), F.floor(F.size("xs") / 2).cast("int")), lambda k: F.struct(F.element_at("xs", 2 * k - 1).alias("lo"), F.element_at("xs", 2 * k).alias("hi")))).alias("s"))
    low, high = F.greatest(F.col("s.lo") - pads.mz_pad, F.lit(0.0)), F.greatest(F.col("s.hi") + pads.mz_pad, F.lit(0.0))
    return spans.select("scan", F.greatest(F.floor(mz_to_tof(low, c)), F.lit(0)).alias("tof_lo"), F.greatest(F.ceil(mz_to_tof(high, c)), F.lit(0)).alias("tof_hi")).where("tof_hi >= tof_lo").distinct()


def polygon_gate(points: DataFrame, ring: list[tuple[float, float]], num_scans: int, c: Calibration, pads: Pads = Pads(), built: DataFrame | None = None) -> DataFrame:
    """MS1 points inside the selection polygon; a ring that covers no scan gates nothing."""
    gate = built if built is not None else polygon_gate_table(points.sparkSession, ring, num_scans, c, pads)
    return points if gate is None else _within(points, gate, num_scans, open_if_empty=True)


def crop_bounds(crop: Crop, num_scans: int, c: Calibration | None) -> dict[str, int]:
    """Inclusive index bounds of the region of interest; only those that are set."""
    out: dict[str, int] = {}
    if crop.mz_min is not None:
        out["tof_lo"] = max(0, math.floor(c.tof(crop.mz_min)))
    if crop.mz_max is not None:
        out["tof_hi"] = max(0, math.ceil(c.tof(crop.mz_max)))
    if crop.im_max is not None:
        out["scan_lo"] = max(0, math.floor(c.scan(crop.im_max)))
    if crop.im_min is not None:
        out["scan_hi"] = min(max(0, math.ceil(c.scan(crop.im_min))), max(0, num_scans - 1))
    return out


def crop_points(points: DataFrame, crop: Crop, num_scans: int, c: Calibration | None) -> DataFrame:
    """Points within the m/z, mobility and intensity bounds. Plain comparisons with literals, so a scan can take them."""
    b = crop_bounds(crop, num_scans, c)
    for column, op, value in (("tof", ">=", b.get("tof_lo")), ("tof", "<=", b.get("tof_hi")), ("scan", ">=", b.get("scan_lo")), ("scan", "<=", b.get("scan_hi")), ("intensity", ">=", crop.min_intensity), ("intensity", "<=", crop.max_intensity)):
        if value is not None:
            points = points.where(F.col(column) >= value if op == ">=" else F.col(column) <= value)
    return points


def rt_inside(crop: Crop):
    """Whether a frame's retention time (seconds) is within the bounds (minutes)."""
    rt = F.col("rt_seconds")
    low = rt >= crop.rt_min * 60 if crop.rt_min is not None else F.lit(True)
    return low & (rt <= crop.rt_max * 60) if crop.rt_max is not None else low
