"""The whole run: routing by MS level, then crop, smoothing and centroiding. A lazy plan; nothing runs until a sink does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionsift.functions.scalars import frame_sample
from ionsift.model import Geometry, Plan
from ionsift.operators import filters, gates, rewrite, stats
from ionsift.operators.centroid import box_centroid, watershed

COLUMNS = ["frame_id", "scan", "tof", "intensity"]


@dataclass
class Built:
    """What a run's frames share, if it was built before: cells that survive by precursor, and gates by scan."""

    cells: DataFrame | None = None
    boxes: DataFrame | None = None
    polygon: DataFrame | None = None


def _ms1(points: DataFrame, frames: DataFrame, geo: Geometry, plan: Plan, num_scans: int, built: Built) -> DataFrame:
    s = plan.stages
    if s.frame_half_width:
        out = filters.neighbourhood_filter(points, frames, s.frame_half_width, plan.streak, s.halo)
    else:
        out = filters.clean(points, plan.streak, s.halo)
    if s.dia_ms1 and geo.calibration and geo.dia_boxes is not None:
        out = gates.dia_ms1_gate(out, geo.dia_boxes, num_scans, geo.calibration, s.dia_ms1, built.boxes)
    if s.ms1_polygon and geo.calibration and geo.dia_windows is None:
        out = gates.polygon_gate(out, geo.polygon, num_scans, geo.calibration, s.ms1_polygon, built.polygon)
    return out


def _msms(points: DataFrame, geo: Geometry, plan: Plan, built: Built) -> tuple[DataFrame, bool]:
    """MS/MS survivors, and whether they were filtered as spectra of their own (then smoothing and centroiding apply)."""
    s = plan.stages
    dda = geo.pasef_windows is not None and s.denoise_msms is not None
    dia = geo.dia_windows is not None and s.denoise_msms is not None
    if dda:
        out, own = filters.precursor_filter(points, geo.pasef_windows, s.denoise_msms, s.halo, built.cells), False
    elif dia or s.all_frames:
        knobs = s.denoise_msms if dia else plan.streak
        if s.dia_per_window and geo.dia_windows is not None:
            out = filters.per_window_filter(points, geo.dia_windows, knobs, s.halo)
        else:
            out = filters.clean(points, knobs, s.halo)
        own = True
    else:
        out, own = points, False
    if s.dia_window is not None and geo.dia_windows is not None:
        out = gates.in_window(out, geo.dia_windows, s.dia_window)
    if s.dda_window is not None and geo.pasef_windows is not None:
        out = gates.in_window(out, gates.dda_intervals(geo.pasef_windows), s.dda_window)
    return out, own


def emitted_frames(frames: DataFrame, plan: Plan, sample: tuple[float, int] | None = None) -> DataFrame:
    """The frames with flags ``cropped`` (non-empty, outside the retention-time bounds) and ``processed`` (in the sample)."""
    out = frames.withColumn("cropped", (F.col("num_peaks") > 0) & ~gates.rt_inside(plan.crop) if plan.crop.has_rt() else F.lit(False))
    if sample is None:
        return out.withColumn("processed", F.lit(True))
    taken = frame_sample(frames.select("frame_id"), *sample).withColumn("processed", F.lit(True))
    return out.join(taken, "frame_id", "left").withColumn("processed", F.coalesce("processed", F.lit(False)))


def denoise(points: DataFrame, frames: DataFrame, plan: Plan = Plan(), geo: Geometry | None = None, num_scans: int | None = None, sample: tuple[float, int] | None = None, built: Built | None = None, levels: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``frame_id, scan, tof, intensity`` of what the run keeps.

    Gates and crops come after the noise filters, since they must not change whose neighbour a point is. The
    retention-time crop and the sample hold back frames from the output only: they still feed sums across frames.
    Without those sums they are applied first, where a scan can take them. ``built`` holds shared tables made before.
    ``levels`` are the points of MS1 and of MS/MS frames, if a source can read them apart: then no record is decoded for
    both and no join with the frames is needed.
    """
    geo, s, built = geo or Geometry(), plan.stages, built or Built()
    if num_scans is None:
        num_scans = frames.agg(F.coalesce(F.max("num_scans"), F.lit(0)).alias("n")).first()["n"]
    flags = emitted_frames(frames, plan, sample)
    shown = flags.where("processed and not cropped").select("frame_id", (F.col("ms_ms_type") == 0).alias("__ms1"))
    held_back = plan.crop.has_rt() or sample is not None
    crosses = s.frame_half_width > 0 or (geo.pasef_windows is not None and s.denoise_msms is not None)
    if levels is None:
        tagged = points.join(frames.select("frame_id", (F.col("ms_ms_type") == 0).alias("__ms1")), "frame_id")
        levels = tagged.where("__ms1").drop("__ms1"), tagged.where("not __ms1").drop("__ms1")
    if held_back and not crosses:
        levels = tuple(x.join(shown.select("frame_id"), "frame_id", "left_semi") for x in levels)
    ms1, ms2 = levels
    own = False
    if not plan.crop_only:
        ms1 = _ms1(ms1, frames, geo, plan, num_scans, built)
        ms2, own = _msms(ms2, geo, plan, built)
    if held_back and crosses:
        ms1, ms2 = (x.join(shown.select("frame_id"), "frame_id", "left_semi") for x in (ms1, ms2))

    def finish(x: DataFrame, filtered_here: bool) -> DataFrame:
        x = gates.crop_points(x, plan.crop, num_scans, geo.calibration)
        if filtered_here and s.smooth:
            x = rewrite.smooth(x, s.smooth)
        if filtered_here and s.watershed:
            x = watershed(x, s.watershed)
        elif filtered_here and s.box_centroid:
            x = box_centroid(x, s.box_centroid)
        return x.select(*COLUMNS)

    return finish(ms1, not plan.crop_only).unionAll(finish(ms2, own and not plan.crop_only))


def summary(points: DataFrame, kept: DataFrame, frames: DataFrame, plan: Plan = Plan(), sample: tuple[float, int] | None = None) -> DataFrame:
    return stats.run_stats(points, kept, emitted_frames(frames, plan, sample))
