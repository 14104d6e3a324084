"""A run derived from the test tables: points from ``lineitem``, frames from ``supplier``, and its geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionsift.model import Calibration, Crop

CALIBRATION = Calibration(10.0, (1700.0**0.5 - 10.0) / 127.0, 1.6, -1.0 / 127.0)
RING = [(200.0, 0.7), (1500.0, 1.0), (1500.0, 1.5), (200.0, 1.1)]
CROP = Crop(mz_min=300.0, mz_max=1200.0, im_min=0.8, im_max=1.4, min_intensity=5_000, max_intensity=90_000)
RT_CROP = Crop(rt_min=1.0, rt_max=5.0)
NUM_SCANS = 128
WINDOWS = [(1, 0, 40, 400.0, 300.0), (1, 40, 80, 800.0, 300.0), (2, 10, 50, 400.0, 300.0), (2, 60, 100, 1200.0, 300.0), (3, 5, 30, 400.0, 300.0), (3, 20, 70, 800.0, 300.0), (3, 90, 90, 1200.0, 300.0)]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.selectExpr(
        "CAST(l_suppkey AS LONG) AS frame_id",
        "CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS LONG) AS point_id",
        "CAST(l_orderkey % 128 AS INT) AS scan", "CAST(l_partkey % 128 AS LONG) AS tof", "CAST(floor(l_extendedprice) AS LONG) AS intensity",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without ids, for operators that don't need them: no window over the frame."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.selectExpr("CAST(l_suppkey AS LONG) AS frame_id", "CAST(l_orderkey % 128 AS INT) AS scan", "CAST(l_partkey % 128 AS LONG) AS tof", "CAST(floor(l_extendedprice) AS LONG) AS intensity")


def frames(spark: SparkSession, sf_dir: str, msms: int = 9, drop_empty: bool = False) -> DataFrame:
    """One frame per supplier; every fourth is MS1. With ``drop_empty`` those with id % 10 = 7 count as empty."""
    n = cells(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    out = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("frame_id")).join(n, "frame_id", "left")
    peaks = F.coalesce("n", F.lit(0).cast("long"))
    if drop_empty:
        peaks = F.when(F.col("frame_id") % 10 == 7, F.lit(0).cast("long")).otherwise(peaks)
    return out.select("frame_id", F.lit(NUM_SCANS).alias("num_scans"), peaks.alias("num_peaks"), F.when(F.col("frame_id") % 4 == 0, 0).otherwise(msms).alias("ms_ms_type"), (F.col("frame_id") * 6.0).cast("double").alias("rt_seconds"))


def without_empty(df: DataFrame) -> DataFrame:
    return df.where("frame_id % 10 != 7")


def dia_info(frames_: DataFrame) -> DataFrame:
    return frames_.where("ms_ms_type != 0 and frame_id % 16 != 13").select("frame_id", (F.col("frame_id") % 4).alias("window_group"))


def dia_windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "window_group long, scan_begin int, scan_end int, isolation_mz double, isolation_width double")


def listed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window for each row of ``lineitem``: overlapping, repeated, empty and incomplete ones too."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "CAST(l_suppkey AS LONG) AS frame_id", "CAST(l_orderkey % 128 AS INT) AS scan_begin", "CAST(l_orderkey % 128 + l_linenumber - 1 AS INT) AS scan_end",
        "CAST(CASE WHEN l_partkey % 7 <> 0 THEN 300 + 25 * (l_partkey % 16) END AS DOUBLE) AS isolation_mz", "CAST(25 AS DOUBLE) AS isolation_width",
    )


def pasef_windows(frames_: DataFrame) -> DataFrame:
    """For MS/MS frames one window each; eight neighbouring frames share a precursor."""
    begin = (F.expr("(16 * (frame_id div 8)) % 96 + frame_id % 3")).cast("int")
    return frames_.where("ms_ms_type != 0").select("frame_id", begin.alias("scan_begin"), (begin + 25).alias("scan_end"), F.expr("1 + frame_id div 8").alias("precursor"), F.lit(0).cast("long").alias("event"))
