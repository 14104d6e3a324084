"""Queries of the point-cloud operators over the derived run, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionsift.functions.scalars import frame_sample, scan_to_im, tof_to_mz
from ionsift.model import BoxCentroid, Geometry, Halo, Pads, Plan, Smooth, Stages, Streak, Watershed
from ionsift.operators import centroid, filters, gates, rewrite, stats
from ionsift.plans import fixtures as fx
from ionsift.plans import oracles as o
from ionsift.plans.pipeline import denoise, emitted_frames
from ionsift.sources import tdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COLS = ("frame_id", "scan", "tof", "intensity")
DEFAULT, TIGHT, THIN = Streak(), Streak(min_window_intensity=20_000, min_feature_intensity=400_000), Streak(1, 3, 0, 5_000, 150_000)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _level(spark, d, ms1: bool) -> DataFrame:
    return fx.cells(spark, d).where("frame_id % 4 = 0" if ms1 else "frame_id % 4 != 0").join(fx.frames(spark, d).select("frame_id"), "frame_id", "left_semi")


def _intervals(spark, d) -> DataFrame:
    return gates.dia_intervals(fx.dia_info(fx.frames(spark, d)), fx.dia_windows(spark))


@query(o.query(o.PTS, o.streak("k", "pts", 3, 2, 5), select=f"SELECT {o.COLS} FROM k"))
def streak_once(spark, d):
    return filters.streak_once(fx.cells(spark, d), DEFAULT).select(*COLS)


@query(o.query(o.PTS, o.streak("a", "pts", 3, 2, 5, 20_000, 400_000), o.streak("b", "a", 3, 2, 5, 20_000, 400_000), select=f"SELECT {o.COLS} FROM b"))
def streak_thresholds(spark, d):
    return filters.streak(fx.cells(spark, d), TIGHT).select(*COLS)


@query(o.query(o.PTS, o.streak("a", "pts", 1, 0, 3, 5_000, 150_000), o.streak("b", "a", 1, 0, 3, 5_000, 150_000), select=f"SELECT {o.COLS} FROM b"))
def streak_narrow(spark, d):
    return filters.streak(fx.cells(spark, d), THIN).select(*COLS)


@query(o.query(o.PTS, o.streak("a", "pts", 3, 2, 5), o.streak("b", "a", 3, 2, 5), select=f"SELECT {o.COLS} FROM b"))
def streak_iterated(spark, d):
    return filters.streak(fx.cells(spark, d), DEFAULT).select(*COLS)


@query(o.query(o.PTS, o.halo("h", "pts", 0.15, 2, 8), select=f"SELECT {o.COLS} FROM h"))
def halo(spark, d):
    return filters.halo(fx.cells(spark, d), Halo(0.15, 8, 2)).select(*COLS)


@query(o.query(o.PTS, o.streak("a", "pts", 3, 2, 5), o.streak("b", "a", 3, 2, 5), o.halo("h", "b", 0.15, 2, 80), select=f"SELECT {o.COLS} FROM h"))
def streak_halo(spark, d):
    return filters.halo(filters.streak(fx.cells(spark, d), DEFAULT), Halo()).select(*COLS)


@query(o.query(o.PTS, o.smooth("s", "pts"), select=f"SELECT {o.IDS} FROM s"))
def smooth(spark, d):
    return rewrite.smooth(fx.points(spark, d), Smooth())


@query(o.query(o.PTS, o.smooth("s", "pts"), o.smooth("t", "s"), select=f"SELECT {o.IDS} FROM t"))
def smooth_iter2(spark, d):
    return rewrite.smooth(fx.points(spark, d), Smooth(iterations=2))


@query(o.query(o.PTS, o.frames(), "n AS (SELECT count(*) AS n FROM frames)", select="SELECT scan, tof, CAST((s + n // 2) // n AS BIGINT) AS intensity FROM (SELECT scan, tof, sum(intensity) AS s FROM pts WHERE frame_id IN (SELECT frame_id FROM frames) GROUP BY scan, tof), n WHERE (s + n // 2) // n > 0"))
def running_average(spark, d):
    return rewrite.running_average(fx.cells(spark, d), fx.frames(spark, d))


@query(o.query(o.PTS, o.frames(), o.PLACES, o.CENTRED, o.streak("k", "centred", 1, 2, 5, by="centre"), select="SELECT p.frame_id, p.scan, p.tof, p.intensity FROM pts p SEMI JOIN k ON k.centre = p.frame_id AND k.scan = p.scan AND k.tof = p.tof"))
def neighborhood_combine(spark, d):
    return filters.neighbourhood_filter(fx.cells(spark, d), fx.frames(spark, d), 1, Streak(1, 5, 2, 0, 0, 1)).select(*COLS)


@query(o.query(o.PTS, o.frames(), o.MS2, o.DIA, o.DIA_FRAMES, select=f"SELECT {o.COLS} FROM {o.gated(0)}"))
def in_window_gate(spark, d):
    return gates.in_window(_level(spark, d, False), _intervals(spark, d)).select(*COLS)


@query(o.query(o.PTS, o.frames(), o.MS2, o.DIA, o.DIA_FRAMES, select=f"SELECT {o.COLS} FROM {o.gated(3)}"))
def in_window_pad(spark, d):
    return gates.in_window(_level(spark, d, False), _intervals(spark, d), 3).select(*COLS)


@query(o.query(o.PTS, o.frames(), o.MS2, o.DIA, o.DIA_FRAMES, o.per_window("k", 3, 2, 5), select=f"SELECT {o.COLS} FROM k"))
def per_window_filter(spark, d):
    return filters.per_window_filter(_level(spark, d, False), _intervals(spark, d), Streak(iterations=1)).select(*COLS)


@query(o.query(o.LISTED, o.merged("g", "listed", "frame_id"), select="SELECT frame_id, scan_begin, scan_end FROM g"))
def interval_merge(spark, d):
    return gates.merge_intervals(fx.listed_windows(spark, d), ("frame_id",))


@query(o.query(o.frames(8), o.PASEF, o.merged("g", "pasef", "frame_id"), select="SELECT frame_id, scan_begin, scan_end FROM g"))
def dda_windows(spark, d):
    return gates.dda_intervals(fx.pasef_windows(fx.frames(spark, d, 8)))


@query(o.query(o.frames(), o.DIA, o.DIA_FRAMES, select="SELECT frame_id, scan_begin, scan_end FROM iv"))
def dia_windows(spark, d):
    return _intervals(spark, d)


@query(o.query(o.LISTED, select="SELECT DISTINCT scan_begin, scan_end, isolation_mz - isolation_width / 2 AS mz_lo, isolation_mz + isolation_width / 2 AS mz_hi FROM listed WHERE scan_end > scan_begin AND isolation_mz IS NOT NULL"))
def dia_boxes(spark, d):
    return gates.dia_boxes(fx.listed_windows(spark, d))


@query(o.query(o.PTS, select=f"SELECT {o.COLS} FROM {o.cropped('pts')}"))
def crop_points(spark, d):
    return gates.crop_points(fx.cells(spark, d), fx.CROP, fx.NUM_SCANS, fx.CALIBRATION).select(*COLS)


_EMPTIED = "SELECT f.frame_id, coalesce(n, 0) AS num_peaks, coalesce(m, 0) AS max_intensity, CAST(coalesce(s, 0) AS BIGINT) AS summed_intensities, f.num_peaks > 0 AND NOT (rt_seconds BETWEEN 60 AND 300) AS cropped FROM frames f LEFT JOIN (SELECT frame_id, count(*) AS n, max(intensity) AS m, sum(intensity) AS s FROM pts WHERE frame_id % 10 <> 7 AND frame_id * 6.0 BETWEEN 60 AND 300 GROUP BY 1) USING (frame_id)"


@query(o.query(o.PTS, o.frames(empty=True), select=_EMPTIED))
def crop_rt(spark, d):
    """Frames outside the bounds stay, empty and marked; empty frames never count as cropped."""
    flags = emitted_frames(fx.frames(spark, d, drop_empty=True), Plan(crop=fx.RT_CROP))
    kept = fx.without_empty(fx.cells(spark, d)).join(flags.where("not cropped").select("frame_id"), "frame_id", "left_semi")
    return stats.frame_stats(kept, flags).join(flags.select("frame_id", "cropped"), "frame_id")


@query(o.query(o.PTS, o.frames(), o.MS1, o.DIA, o.box_gate(), select=f"SELECT {o.COLS} FROM {o.BOXED % 'ms1'}"))
def dia_ms1_gate(spark, d):
    return gates.dia_ms1_gate(_level(spark, d, True), gates.dia_boxes(fx.dia_windows(spark)), fx.NUM_SCANS, fx.CALIBRATION).select(*COLS)


@query(o.query(o.PTS, o.frames(), o.MS1, o.polygon(0.0, 0.0), select=f"SELECT {o.COLS} FROM {o.INSIDE % 'ms1'}"))
def polygon_gate(spark, d):
    return gates.polygon_gate(_level(spark, d, True), fx.RING, fx.NUM_SCANS, fx.CALIBRATION, Pads(0.0, 0.0)).select(*COLS)


@query(o.query(o.PTS, o.frames(), o.MS1, o.polygon(5.0, 0.05), select=f"SELECT {o.COLS} FROM {o.INSIDE % 'ms1'}"))
def polygon_gate_padded(spark, d):
    return gates.polygon_gate(_level(spark, d, True), fx.RING, fx.NUM_SCANS, fx.CALIBRATION).select(*COLS)


@query(o.query(o.PTS, o.frames(8), o.MS2, o.PASEF, o.OWNED, o.SUMMED, o.streak("keys", "summed", 0, 1, 4, by="precursor"), select="SELECT precursor, scan, tof FROM keys"))
def msms_combine(spark, d):
    return filters.precursor_keys(_level(spark, d, False), fx.pasef_windows(fx.frames(spark, d, 8)), Streak(0, 4, 1, 0, 0, 1))


@query(o.query(o.PTS, o.frames(8), o.MS2, o.PASEF, o.OWNED, o.SUMMED, o.streak("keys", "summed", 0, 1, 4, by="precursor"), o.MAPPED, select=f"SELECT {o.COLS} FROM mapped"))
def msms_mapback(spark, d):
    return filters.precursor_filter(_level(spark, d, False), fx.pasef_windows(fx.frames(spark, d, 8)), Streak(0, 4, 1, 0, 0, 1)).select(*COLS)


@query(o.query(o.PTS, o.frames(empty=True), select="SELECT f.frame_id, coalesce(n, 0) AS num_peaks, coalesce(m, 0) AS max_intensity, CAST(coalesce(s, 0) AS BIGINT) AS summed_intensities FROM frames f LEFT JOIN (SELECT frame_id, count(*) AS n, max(intensity) AS m, sum(intensity) AS s FROM pts WHERE frame_id % 10 <> 7 GROUP BY 1) USING (frame_id)"))
def frame_stats(spark, d):
    return stats.frame_stats(fx.without_empty(fx.cells(spark, d)), fx.frames(spark, d, drop_empty=True))


_RUN = """SELECT count(*) AS frames, count(*) FILTER (ms_ms_type = 0) AS ms1_frames, count(*) FILTER (ms_ms_type <> 0) AS msms_frames, count(*) FILTER (crop) AS cropped_frames, count(*) AS processed_frames,
 CAST(sum(num_peaks) AS BIGINT) AS raw_points, CAST(sum(kp) AS BIGINT) AS kept_points, CAST(sum(num_peaks) FILTER (ms_ms_type = 0) AS BIGINT) AS raw_ms1_points, CAST(sum(kp) FILTER (ms_ms_type = 0) AS BIGINT) AS kept_ms1_points,
 CAST(coalesce(sum(rs) FILTER (NOT crop), 0) AS BIGINT) AS raw_summed_intensity, CAST(sum(ks) AS BIGINT) AS kept_summed_intensity,
 round(100.0::DOUBLE * sum(kp) / sum(num_peaks), 2) AS kept_pct, round(100.0::DOUBLE * sum(kp) FILTER (ms_ms_type = 0) / sum(num_peaks) FILTER (ms_ms_type = 0), 2) AS ms1_kept_pct
FROM (SELECT f.*, num_peaks > 0 AND NOT (rt_seconds BETWEEN 60 AND 300) AS crop, coalesce(r.s, 0) AS rs, coalesce(k.n, 0) AS kp, coalesce(k.s, 0) AS ks FROM frames f
 LEFT JOIN (SELECT frame_id, sum(intensity) AS s FROM pts WHERE frame_id % 10 <> 7 GROUP BY 1) r USING (frame_id)
 LEFT JOIN (SELECT frame_id, count(*) AS n, sum(intensity) AS s FROM k WHERE frame_id % 10 <> 7 AND frame_id * 6.0 BETWEEN 60 AND 300 GROUP BY 1) k USING (frame_id))"""


@query(o.query(o.PTS, o.frames(empty=True), o.streak("k", "pts", 3, 2, 5), select=_RUN))
def run_stats(spark, d):
    plan = Plan(crop=fx.RT_CROP)
    flags = emitted_frames(fx.frames(spark, d, drop_empty=True), plan)
    raw = fx.without_empty(fx.cells(spark, d))
    kept = filters.streak_once(raw, DEFAULT).join(flags.where("not cropped").select("frame_id"), "frame_id", "left_semi")
    return stats.run_stats(raw, kept, flags)


@query(o.query(o.frames(empty=True), select="SELECT count(*) AS frames, count(*) FILTER (ms_ms_type = 0) AS ms1_frames, count(*) FILTER (ms_ms_type <> 0) AS msms_frames, count(*) FILTER (num_peaks = 0) AS empty_frames FROM frames"))
def frame_inventory(spark, d):
    return stats.inventory(fx.frames(spark, d, drop_empty=True))


@query(o.query(o.frames(), select="SELECT CASE WHEN bool_or(ms_ms_type = 9) THEN 'DiaPasef' WHEN bool_or(ms_ms_type = 8) THEN 'DdaPasef' WHEN bool_and(ms_ms_type = 0) THEN 'Ms1Only' ELSE 'Unknown' END AS acquisition FROM frames"))
def acquisition(spark, d):
    return stats.acquisition(fx.frames(spark, d))


@query(o.query(o.PTS, select=f"SELECT frame_id, point_id, round({o.MZ % 'tof'}, 6) AS mz, round({o.IM % 'scan'}, 6) AS one_over_k0 FROM pts"))
def calibrate(spark, d):
    return fx.points(spark, d).select("frame_id", "point_id", F.round(tof_to_mz(F.col("tof"), fx.CALIBRATION), 6).alias("mz"), F.round(scan_to_im(F.col("scan"), fx.CALIBRATION), 6).alias("one_over_k0"))


@query(o.query(o.PTS, select=f"SELECT {o.COLS} FROM pts WHERE frame_id % 10 <> 7 AND frame_id IN (SELECT s_suppkey FROM supplier)"))
def codec_roundtrip(spark, d):
    return tdf.decode(tdf.encode(fx.without_empty(fx.cells(spark, d)), fx.frames(spark, d, drop_empty=True))).select(*COLS)


@query(o.query(o.PTS, o.frames(), o.MS2, o.streak("a", "ms2", 3, 2, 5), o.halo("h", "a", 0.15, 2, 8), select=f"SELECT {o.COLS} FROM h"))
def msms_whole_frame(spark, d):
    """Without windows, MS/MS frames are filtered as wholes, as spectra of their own."""
    plan = Plan(Streak(iterations=1), Stages(all_frames=True, halo=Halo(0.15, 8, 2)))
    return denoise(fx.cells(spark, d), fx.frames(spark, d), plan, num_scans=fx.NUM_SCANS).where("frame_id % 4 != 0")


_DIA_PLAN = Plan(Streak(iterations=1), Stages(halo=Halo(0.15, 8, 2), denoise_msms=Streak(iterations=1), dia_window=0, dia_per_window=True, dia_ms1=Pads()), fx.CROP)
_PW = o.per_window("w", 3, 2, 5)


@query(o.query(o.PTS, o.frames(), o.MS1, o.MS2, o.DIA, o.DIA_FRAMES, o.box_gate(), o.streak("a", "ms1", 3, 2, 5), o.halo("ah", "a", 0.15, 2, 8), f"ab AS {o.BOXED % 'ah'}", _PW, o.halo("wh", "w", 0.15, 2, 8, "frame_id, win"), f"wg AS {o.gated(0, 'wh')}",
       select=f"SELECT {o.COLS} FROM {o.cropped('ab')} UNION ALL SELECT {o.COLS} FROM {o.cropped('wg')}"))
def pipeline_dia(spark, d):
    geo = Geometry(dia_windows=_intervals(spark, d), dia_boxes=gates.dia_boxes(fx.dia_windows(spark)), calibration=fx.CALIBRATION)
    return denoise(fx.cells(spark, d), fx.frames(spark, d), _DIA_PLAN, geo, fx.NUM_SCANS)


_DDA_PLAN = Plan(Streak(), Stages(halo=Halo(), denoise_msms=Streak(0, 4, 1, 0, 0, 1), dda_window=0, ms1_polygon=Pads()))


@query(o.query(o.PTS, o.frames(8), o.MS1, o.MS2, o.PASEF, o.polygon(5.0, 0.05), o.streak("a", "ms1", 3, 2, 5), o.streak("b", "a", 3, 2, 5), o.halo("h", "b", 0.15, 2, 80), o.OWNED, o.SUMMED, o.streak("sk", "summed", 0, 1, 4, by="precursor"), o.halo("keys", "sk", 0.15, 2, 80, "precursor"), o.MAPPED, "iv AS (SELECT frame_id, scan_begin, scan_end FROM pasef)",
       select=f"SELECT {o.COLS} FROM {o.INSIDE % 'h'} UNION ALL SELECT {o.COLS} FROM {o.gated(0, 'mapped')}"))
def pipeline_dda(spark, d):
    frames = fx.frames(spark, d, 8)
    geo = Geometry(pasef_windows=fx.pasef_windows(frames), polygon=fx.RING, calibration=fx.CALIBRATION)
    return denoise(fx.cells(spark, d), frames, _DDA_PLAN, geo, fx.NUM_SCANS)


@query(o.query(o.PTS, select="SELECT frame_id, scan, tof, CAST(sum(intensity) AS BIGINT) AS intensity FROM pts GROUP BY 1, 2, 3 HAVING max(intensity) >= 50000 AND sum(intensity) >= 80000"))
def watershed_cells(spark, d):
    return centroid.watershed(fx.cells(spark, d), Watershed(0, 0, 50_000, 80_000, 0))


@query(o.query(o.PTS, select="SELECT frame_id, scan, tof, CAST(sum(intensity) AS BIGINT) AS intensity FROM pts GROUP BY 1, 2, 3 HAVING sum(intensity) >= 80000"))
def box_cells(spark, d):
    return centroid.box_centroid(fx.cells(spark, d), BoxCentroid(0, 0, 80_000))


_CONSERVED = o.query(o.PTS, select="SELECT frame_id, CAST(sum(intensity) AS BIGINT) AS intensity FROM pts GROUP BY 1")


@query(_CONSERVED)
def watershed_conserved(spark, d):
    return centroid.watershed(fx.cells(spark, d)).groupBy("frame_id").agg(F.sum("intensity").alias("intensity"))


@query(_CONSERVED)
def box_conserved(spark, d):
    return centroid.box_centroid(fx.cells(spark, d)).groupBy("frame_id").agg(F.sum("intensity").alias("intensity"))


@query(o.watershed(10, 3, 10))
def watershed(spark, d):
    return centroid.watershed(fx.cells(spark, d))


@query(o.box_centroid(2, 2))
def box_centroid(spark, d):
    return centroid.box_centroid(fx.cells(spark, d))


def _mul(x: str, k: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {k}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"


@query(f"""WITH a AS (SELECT CAST(s_suppkey AS BIGINT) AS frame_id, row_number() OVER (ORDER BY s_suppkey) - 1 + 123 AS i FROM supplier),
 b AS (SELECT frame_id, {_mul('i', 0x9E3779B97F4A7C15)} AS z FROM a), c AS (SELECT frame_id, {_mul('xor(z, z >> 30)', 0xBF58476D1CE4E5B9)} AS z FROM b),
 e AS (SELECT frame_id, {_mul('xor(z, z >> 27)', 0x94D049BB133111EB)} AS z FROM c) SELECT frame_id FROM e WHERE xor(z, z >> 31) <= 4611686018427387904""")
def frame_sample_quarter(spark, d):
    return frame_sample(fx.frames(spark, d).select("frame_id"), 0.25, 123)
