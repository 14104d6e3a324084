"""Running a job under control (progress, cancellation), and pulling single frames of a run."""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionsift.model import Calibration, Geometry, Plan
from ionsift.operators import filters, gates
from ionsift.plans.pipeline import Built, denoise
from ionsift.sources import tdf


class Cancelled(Exception):
    """The job was cancelled."""


class Control:
    """``with Control(spark, progress): ...``: Spark jobs of the block form one group.

    ``progress(done, total)`` is called from a thread of its own with the frames finished so far: a writer adds each to
    ``frames``, an accumulator, and states ``total``. ``cancel()``, from any thread, stops the running jobs; the block
    then raises :class:`Cancelled`.
    """

    def __init__(self, spark: SparkSession, progress: Callable[[int, int], None] | None = None, every: float = 0.2):
        self.context, self.progress, self.every = spark.sparkContext, progress, every
        self.group, self.cancelled, self.over = f"ionsift-{uuid.uuid4().hex}", False, threading.Event()
        self.frames, self.total = self.context.accumulator(0), 0

    def cancel(self) -> None:
        self.cancelled = True
        self.context.cancelJobGroup(self.group)

    def _look(self) -> None:
        # a task that runs again adds its frames again
        self.progress(min(self.frames.value, self.total), self.total)

    def _watch(self) -> None:
        while not self.over.wait(self.every):
            self._look()

    def __enter__(self) -> Control:
        if self.cancelled:
            raise Cancelled
        self.context.setJobGroup(self.group, "ionsift", True)
        if self.progress:
            self.thread = threading.Thread(target=self._watch, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.over.set()
        if self.progress:
            self.thread.join()
            self._look()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.context.setLocalProperty(key, None)
        if self.cancelled and kind is not Cancelled:
            raise Cancelled from error


class RunContext:
    """A run opened once, whose frames are pulled one by one: ``len(run)``, ``run.is_ms1(i)``, ``run.process(i)``.

    Indices follow frame ids. A frame has the points that the whole run keeps of it; crops and samples belong to the
    writer, so a plan with them is refused. What frames share is built when the run is opened and held in tables: the
    surviving cells of ddaPASEF precursors, bucketed by precursor, and the MS1 gates, one row for each scan. A pull then
    reads only the records of frames that feed it, and the buckets of its precursors, so its
    work doesn't grow with the run. ``frames()`` goes through all frames in one query instead. Use it in a ``with``
    block, or call ``close``, to drop the tables.

    ``geometry`` defaults to what the folder says, without a calibration, which is the user's to give.
    """

    #: Points of MS/MS frames for each bucket of surviving cells.
    BUCKET = 1_000_000

    def __init__(self, spark: SparkSession, path: str, plan: Plan = Plan(), geometry: Geometry | None = None):
        if plan.crop != type(plan.crop)():
            raise ValueError("single frames are not cropped")
        self.spark, self.path, self.plan = spark, path, plan
        self.points, self.tables = tdf.read_points(spark, path), []
        self.frames_ = tdf.read_frames(spark, path)
        self.geometry = geometry if geometry is not None else tdf.geometry(spark, path)
        self.meta = self.frames_.orderBy("frame_id").collect()
        self.ms1 = [m.frame_id for m in self.meta if m.ms_ms_type == 0]
        self.place = {frame: k for k, frame in enumerate(self.ms1)}
        self.windows = [self._listed(df) for df in (self.geometry.pasef_windows, self.geometry.dia_windows)]
        self.num_scans = max((m.num_scans for m in self.meta), default=0)
        self.built = self._build()

    def __enter__(self) -> RunContext:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()

    @staticmethod
    def _listed(df: DataFrame | None) -> dict[int, list] | None:
        """Windows of each frame: metadata like the frame table, a few rows a frame."""
        if df is None:
            return None
        out: dict[int, list] = defaultdict(list)
        for r in df.collect():
            out[r.frame_id].append(r)
        return out

    def _held(self, df: DataFrame, buckets: int | None = None) -> DataFrame:
        name = f"ionsift_{uuid.uuid4().hex}"
        (df.repartition(buckets, "precursor").write.bucketBy(buckets, "precursor").sortBy("precursor") if buckets else df.coalesce(1).write).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def _build(self) -> Built:
        s, geo, built = self.plan.stages, self.geometry, Built()
        if self.plan.crop_only:
            return built
        if self._summed():
            cells = filters.precursor_keys(tdf.read_levels(self.spark, self.path)[1], geo.pasef_windows, s.denoise_msms, s.halo)
            n = sum(m.num_peaks for m in self.meta if m.ms_ms_type != 0)
            built.cells = self._held(cells, max(1, -(-n // self.BUCKET)))
        if s.dia_ms1 and geo.calibration and geo.dia_boxes is not None and self.num_scans:
            built.boxes = self._held(gates.by_scan(gates.box_gate_table(geo.dia_boxes, self.num_scans, geo.calibration, s.dia_ms1)))
        if s.ms1_polygon and geo.calibration and geo.dia_windows is None:
            spans = gates.polygon_gate_table(self.spark, geo.polygon, self.num_scans, geo.calibration, s.ms1_polygon)
            built.polygon = None if spans is None else self._held(gates.by_scan(spans))
        return built

    def _summed(self) -> bool:
        return self.geometry.pasef_windows is not None and self.plan.stages.denoise_msms is not None

    def __len__(self) -> int:
        return len(self.meta)

    def is_empty(self) -> bool:
        return not self.meta

    def is_ms1(self, i: int) -> bool:
        return self.meta[i].ms_ms_type == 0

    @property
    def ms1_frames(self) -> int:
        """The number of MS1 frames."""
        return len(self.ms1)

    @property
    def calibration(self) -> Calibration | None:
        return self.geometry.calibration

    def _needed(self, i: int) -> list[int]:
        """Frames that feed frame i."""
        own, r = self.meta[i], self.plan.stages.frame_half_width
        if own.ms_ms_type != 0 or self.plan.crop_only or not r:
            return [own.frame_id]
        at = self.place[own.frame_id]
        return self.ms1[max(0, at - r) : at + r + 1]

    def process(self, i: int) -> DataFrame:
        """``frame_id, scan, tof, intensity`` of frame i; only the frames that feed it are read."""
        some, own, geo, built = self._needed(i), self.meta[i], self.geometry, self.built
        of_frame = lambda df, by: None if df is None else self.spark.createDataFrame(by.get(own.frame_id, []), df.schema)
        geo = replace(geo, pasef_windows=of_frame(geo.pasef_windows, self.windows[0]), dia_windows=of_frame(geo.dia_windows, self.windows[1]))
        if built.cells is not None:
            ids = {r.precursor for r in self.windows[0].get(own.frame_id, []) if r.precursor}
            built = replace(built, cells=built.cells.where(F.col("precursor").isin(sorted(ids))))
        frames = self.frames_.where(F.col("frame_id").isin(some))
        points, none = tdf.read_points(self.spark, self.path, some), self.points.where("false")
        kept = denoise(points, frames, self.plan, geo, self.num_scans, built=built, levels=(points, none) if own.ms_ms_type == 0 else (none, points))
        return kept.where(F.col("frame_id") == own.frame_id)

    def frames(self) -> Iterator[tuple[int, pd.DataFrame]]:
        """(index, points) of every frame in order, empty ones too, from one query; the driver holds a stretch of frames at a time."""
        kept = denoise(self.points, self.frames_, self.plan, self.geometry, self.num_scans, built=self.built, levels=tdf.read_levels(self.spark, self.path))
        listed = kept.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("scan", "tof", "intensity"))).alias("points")).orderBy("frame_id")
        rows = listed.toLocalIterator()
        row = next(rows, None)
        for i, m in enumerate(self.meta):
            here = row is not None and row.frame_id == m.frame_id
            yield i, pd.DataFrame(row.points if here else [], columns=["scan", "tof", "intensity"])
            row = next(rows, None) if here else row
