"""Streams of frames: each micro-batch holds whole frames, so the batch plan runs on it as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ionsift.model import Geometry, Plan
from ionsift.plans.pipeline import denoise


def denoise_stream(packed: DataFrame, plan: Plan, sink: Callable[[DataFrame, int], None], checkpoint: str, geo: Geometry | None = None, num_scans: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Denoises a stream with one row per frame: ``frame_id, num_scans, ms_ms_type, rt_seconds, points`` (array of point structs).

    Sums across frames would need frames that are not in the batch, so those stages are refused.
    """
    if plan.stages.frame_half_width or (geo and geo.pasef_windows is not None and plan.stages.denoise_msms):
        raise ValueError("a stream of single frames cannot be summed across frames")

    def each(batch: DataFrame, number: int) -> None:
        points = batch.selectExpr("frame_id", "posexplode(points) AS (point_id, p)").selectExpr("frame_id", "CAST(point_id AS LONG) AS point_id", "p.scan", "p.tof", "p.intensity")
        frames = batch.selectExpr("frame_id", "num_scans", "CAST(size(points) AS LONG) AS num_peaks", "ms_ms_type", "rt_seconds")
        sink(denoise(points, frames, plan, geo, num_scans), number)

    writer = packed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
