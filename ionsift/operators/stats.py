"""Per-frame and per-run aggregates; frames without points stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_stats(points: DataFrame, frames: DataFrame) -> DataFrame:
    """``frame_id, num_peaks, max_intensity, summed_intensities`` of every frame."""
    some = points.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.max("intensity").alias("m"), F.sum("intensity").alias("s"))
    zero = F.lit(0).cast("long")
    return frames.select("frame_id").join(some, "frame_id", "left").select("frame_id", F.coalesce("n", zero).alias("num_peaks"), F.coalesce("m", zero).alias("max_intensity"), F.coalesce("s", zero).alias("summed_intensities"))


def acquisition(frames: DataFrame) -> DataFrame:
    """One row ``acquisition``: diaPASEF (9) anywhere beats ddaPASEF (8); MS1 only; else unknown."""
    a = frames.agg(F.coalesce(F.max((F.col("ms_ms_type") == 9).cast("int")), F.lit(0)).alias("dia"), F.coalesce(F.max((F.col("ms_ms_type") == 8).cast("int")), F.lit(0)).alias("dda"), F.coalesce(F.min((F.col("ms_ms_type") == 0).cast("int")), F.lit(0)).alias("ms1"))
    return a.select(F.when(F.col("dia") == 1, "DiaPasef").when(F.col("dda") == 1, "DdaPasef").when(F.col("ms1") == 1, "Ms1Only").otherwise("Unknown").alias("acquisition"))


def inventory(frames: DataFrame) -> DataFrame:
    """One row ``frames, ms1_frames, msms_frames, empty_frames``."""
    ms1 = F.col("ms_ms_type") == 0
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.count_if(ms1).alias("ms1_frames"), F.count_if(~ms1).alias("msms_frames"), F.count_if(F.col("num_peaks") == 0).alias("empty_frames"))


def run_stats(raw: DataFrame, kept: DataFrame, frames: DataFrame) -> DataFrame:
    """One row of reduction statistics. ``frames`` has ``cropped`` (emptied by retention time) and ``processed`` flags.

    Raw points of a cropped frame count by its ``num_peaks``, its raw intensity as 0.
    """
    per = frames.join(frame_stats(raw, frames).select("frame_id", F.col("num_peaks").alias("rp"), F.col("summed_intensities").alias("rs")), "frame_id")
    per = per.join(frame_stats(kept, frames).select("frame_id", F.col("num_peaks").alias("kp"), F.col("summed_intensities").alias("ks")), "frame_id")
    ms1, done = F.col("ms_ms_type") == 0, F.col("processed")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0)).cast("long")
    points = F.when(F.col("cropped"), F.col("num_peaks")).otherwise(F.col("rp"))
    out = per.agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(ms1).alias("ms1_frames"), F.count_if(~ms1).alias("msms_frames"), F.count_if(F.col("cropped") & done).alias("cropped_frames"), F.count_if(done).alias("processed_frames"),
        total(points, done).alias("raw_points"), total(F.col("kp"), done).alias("kept_points"), total(points, done & ms1).alias("raw_ms1_points"), total(F.col("kp"), done & ms1).alias("kept_ms1_points"),
        total(F.col("rs"), done & ~F.col("cropped")).alias("raw_summed_intensity"), total(F.col("ks"), done).alias("kept_summed_intensity"),
    )
    share = lambda k, r: F.when(F.col(r) > 0, F.round(F.lit(100.0) * F.col(k) / F.col(r), 2)).otherwise(0.0)
    return out.withColumns({"kept_pct": share("kept_points", "raw_points"), "ms1_kept_pct": share("kept_ms1_points", "raw_ms1_points")})
