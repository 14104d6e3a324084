"""Operators that rewrite intensities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionsift.model import Smooth
from ionsift.operators import kernels


def smooth(points: DataFrame, p: Smooth = Smooth(), by: tuple[str, ...] = ("frame_id",), form: str = "arrow") -> DataFrame:
    """Each intensity becomes the rounded mean over the points in its box, itself included; repeated on the result.

    ``arrow`` sums whole frames in a kernel, one shuffle for all passes; ``sql`` stays in the JVM and copies each point
    for each scan of its box. Both give the same rows.
    """
    if form == "arrow":
        return kernels.smooth(points, p, by)
    s, m, out = p.scan_half_width, p.mz_idx_half_width, points.columns
    for _ in range(p.iterations):
        spread = points.withColumn("__d", F.explode(F.sequence(F.lit(-s), F.lit(s)))).withColumn("__scan", F.col("scan") + F.col("__d"))
        box = Window.partitionBy(*by, "__scan").orderBy("tof").rangeBetween(-m, m)
        seen = spread.withColumns({"__s": F.sum("intensity").over(box), "__n": F.count(F.lit(1)).over(box)}).where("__d = 0")
        points = seen.withColumn("intensity", F.expr("(__s + __n div 2) div __n")).select(*out)
    return points


def running_average(points: DataFrame, frames: DataFrame) -> DataFrame:
    """``scan, tof, intensity``: rounded mean per cell over all listed frames, empty ones too; cells of mean 0 go."""
    some = frames.select("frame_id").distinct()
    n = some.agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = points.join(some, "frame_id", "left_semi").groupBy("scan", "tof").agg(F.sum("intensity").alias("s")).withColumn("n", n)
    return sums.select("scan", "tof", F.expr("(s + n div 2) div n").alias("intensity")).where("intensity > 0")
