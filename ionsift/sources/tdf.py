"""Type-2 frame records and run folders: codec, reader, writer, checks.

A run folder holds ``analysis.tdf`` (SQLite) and ``analysis.tdf_bin`` (records). The folder must be on storage that
all executors mount. The small metadata tables are read on the driver; points only in tasks.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ionsift.model import POINTS, Calibration, Geometry
from ionsift.operators import gates
from ionsift.operators.kernels import by_groups

#: Bytes of a record's header: its length and its scan count, little-endian.
HEADER = 8


class RecordError(ValueError):
    """A record that cannot be decoded."""


class ShortRecordError(RecordError):
    """It ends within its header."""


class ByteCountError(RecordError):
    """The length that it states is less than a header or more than there is."""


class CompressionError(RecordError):
    """Its payload isn't sound zstd."""


class MisalignedError(RecordError):
    """Its payload is empty or not whole 32-bit values."""


class ScanCountError(RecordError):
    """It states more scans than it has values, or more points in its scans than it has."""


def encode_record(num_scans: int, scan: np.ndarray, tof: np.ndarray, intensity: np.ndarray) -> bytes:
    """One record: header (length, scans) and zstd level 1 of the byte planes; without points the bare header.

    The values are the scan count, twice the points of each scan but the last, then for each point the TOF step (plus 1 at
    the start of a scan) and the intensity, by scan and TOF.
    """
    import zstandard

    if not len(scan):
        return struct.pack("<II", HEADER, num_scans)
    if scan.min() < 0 or scan.max() >= num_scans:
        raise ValueError(f"scan outside 0..{num_scans - 1}")
    order = np.lexsort((tof, scan))
    scan, tof, intensity = (x[order].astype(np.int64) for x in (scan, tof, intensity))
    step = np.diff(tof, prepend=0)
    starts = np.r_[True, scan[1:] != scan[:-1]]
    step[starts] = tof[starts] + 1
    sizes = 2 * np.bincount(scan, minlength=num_scans)[: num_scans - 1]
    values = np.concatenate([[num_scans], sizes, np.column_stack([step, intensity]).ravel()]).astype("<u4")
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T).tobytes()
    payload = zstandard.ZstdCompressor(level=1).compress(planes)
    return struct.pack("<II", HEADER + len(payload), num_scans) + payload


def decode_record(record: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(scans, scan, tof, intensity) of a record with payload."""
    import zstandard

    if len(record) < HEADER:
        raise ShortRecordError("short record")
    length, _ = struct.unpack_from("<II", record)
    if not HEADER <= length <= len(record):
        raise ByteCountError(f"invalid byte count {length}")
    try:
        planes = zstandard.ZstdDecompressor().decompress(record[HEADER : length], max_output_size=1 << 31)
    except zstandard.ZstdError as e:
        raise CompressionError(f"zstd: {e}") from None
    if len(planes) % 4 or not planes:
        raise MisalignedError("misaligned payload")
    values = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    scans = int(values[0])
    if scans > len(values):
        raise ScanCountError(f"{scans} scans in {len(values)} values")
    pairs = values[scans : scans + (len(values) - scans) // 2 * 2].reshape(-1, 2)
    sizes = values[1:scans] // 2
    sizes = np.append(sizes, len(pairs) - sizes.sum())
    if (sizes < 0).any():
        raise ScanCountError("scan sizes exceed the points")
    scan = np.repeat(np.arange(scans), sizes)
    total = np.cumsum(pairs[:, 0])
    first = np.cumsum(sizes) - sizes
    before = np.r_[0, total][first]
    return scans, scan, total - np.repeat(before, sizes) - 1, pairs[:, 1]


RECORDS = "frame_id long, record binary, num_peaks long, max_intensity long, summed_intensities long"


def encode(points: DataFrame, frames: DataFrame, done=None) -> DataFrame:
    """``frame_id, record`` of every frame, empty ones too, with the point count and the largest and summed intensity.

    ``done``, an accumulator, counts the frames.
    """
    def kernel(table: pa.Table, group: np.ndarray) -> pa.Table:
        edges = np.r_[np.flatnonzero(np.diff(group, prepend=-1)), len(group)]
        frames, scans = (table[c].to_numpy() for c in ("frame_id", "num_scans"))
        real = table["scan"].is_valid().to_numpy()
        columns = [table[c].fill_null(0).to_numpy().astype(np.int64) for c in ("scan", "tof", "intensity")]
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            scan, tof, intensity = (c[a:b][real[a:b]] for c in columns)
            out.append((int(frames[a]), encode_record(int(scans[a]), scan, tof, intensity), len(scan), int(intensity.max(initial=0)), int(intensity.sum())))
        if done is not None:
            done.add(len(out))
        kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 3]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["frame_id", "record", "num_peaks", "max_intensity", "summed_intensities"])

    rows = frames.select("frame_id", "num_scans").join(points.select("frame_id", "scan", "tof", "intensity"), "frame_id", "left")
    return by_groups(rows, ("frame_id",), kernel, RECORDS)


def decode(records: DataFrame) -> DataFrame:
    """Points of ``frame_id, record`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, record in zip(batch.column("frame_id").to_pylist(), batch.column("record")):
                if len(raw := record.as_py()) > HEADER:
                    yield _as_points(frame, raw)

    return records.select("frame_id", "record").mapInArrow(run, POINTS)


def _as_points(frame: int, record: bytes) -> pa.RecordBatch:
    _, scan, tof, intensity = decode_record(record)
    n = len(scan)
    return pa.record_batch([pa.array(np.full(n, frame)), pa.array(np.arange(1, n + 1)), pa.array(scan.astype(np.int32)), pa.array(tof), pa.array(intensity)], names=["frame_id", "point_id", "scan", "tof", "intensity"])


def _connect(path: str) -> sqlite3.Connection:
    if not all(os.path.isfile(f"{path}/{f}") for f in ("analysis.tdf", "analysis.tdf_bin")):
        raise ValueError(f"{path} is not a run folder")
    return sqlite3.connect(f"file:{path}/analysis.tdf?mode=ro", uri=True)


def _rows(path: str, sql: str, *needs: str, given: tuple = ()) -> list[tuple]:
    """The rows of a query; none where a needed table is missing."""
    db = _connect(path)
    try:
        have = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
        return db.execute(sql, given).fetchall() if set(needs) <= have else []
    finally:
        db.close()


def _local(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A metadata table whose size Spark knows, so that it broadcasts a small one to the points and shuffles for a large one."""
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds)))


L, I, D = pa.int64(), pa.int32(), pa.float64()


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    rows = _rows(path, "SELECT Id, NumScans, NumPeaks, MsMsType, CAST(Time AS REAL) FROM Frames ORDER BY Id")
    return _local(spark, rows, frame_id=L, num_scans=I, num_peaks=L, ms_ms_type=I, rt_seconds=D)


def read_pasef_windows(spark: SparkSession, path: str) -> DataFrame:
    rows = _rows(path, "SELECT Frame, ScanNumBegin, ScanNumEnd, coalesce(Precursor, 0) FROM PasefFrameMsMsInfo", "PasefFrameMsMsInfo")
    return _local(spark, [(*r, k) for k, r in enumerate(rows)], frame_id=L, scan_begin=I, scan_end=I, precursor=L, event=L)


def read_dia(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frame_id, window_group) with a frame's last row winning, and the windows."""
    both = ("DiaFrameMsMsInfo", "DiaFrameMsMsWindows")
    info = dict(_rows(path, "SELECT Frame, WindowGroup FROM DiaFrameMsMsInfo", *both))
    windows = _rows(path, "SELECT WindowGroup, ScanNumBegin, ScanNumEnd, IsolationMz, IsolationWidth FROM DiaFrameMsMsWindows", *both)
    return _local(spark, list(info.items()), frame_id=L, window_group=L), _local(spark, windows, window_group=L, scan_begin=I, scan_end=I, isolation_mz=D, isolation_width=D)


def read_polygon(path: str) -> list[tuple[float, float]]:
    """Corners of the selection polygon, or none if it is missing, uneven or too small."""
    # The permanent names of the two stored properties.
    names = ("IMS_PolygonFilter_Mass", "IMS_PolygonFilter_Mobility")
    out = []
    for name in names:
        got = _rows(path, f"SELECT Value FROM GroupProperties WHERE Property = (SELECT Id FROM PropertyDefinitions WHERE PermanentName = '{name}') LIMIT 1", "GroupProperties", "PropertyDefinitions")
        if not got or not isinstance(got[0][0], bytes):
            return []
        out.append(np.frombuffer(got[0][0][: len(got[0][0]) // 8 * 8], "<f8").tolist())
    return list(zip(*out)) if len(out[0]) == len(out[1]) >= 3 else []


def geometry(spark: SparkSession, path: str, calibration: Calibration | None = None) -> Geometry:
    """All that the folder says of the acquisition."""
    pasef = read_pasef_windows(spark, path)
    info, windows = read_dia(spark, path)
    dia = not windows.isEmpty()
    return Geometry(None if pasef.isEmpty() else pasef, gates.dia_intervals(info, windows) if dia else None, gates.dia_boxes(windows) if dia else None, read_polygon(path), calibration)


def read_acquired_mz(path: str) -> tuple[float, float] | None:
    rows = dict(_rows(path, "SELECT Key, Value FROM GlobalMetadata", "GlobalMetadata"))
    try:
        low, high = float(rows["MzAcqRangeLower"]), float(rows["MzAcqRangeUpper"])
    except (KeyError, ValueError):
        return None
    return (low, high) if high > low else None


def calibration_segments(path: str) -> tuple[int, int]:
    """Distinct m/z and mobility calibrations that frames refer to; 1 where the column is missing."""
    have = {r[1] for r in _rows(path, "PRAGMA table_info(Frames)")}
    return tuple(_rows(path, f"SELECT count(DISTINCT {c}) FROM Frames")[0][0] if c in have else 1 for c in ("MzCalibration", "TimsCalibration"))


class _Frames(InputPartition):
    def __init__(self, frames: list[tuple[int, int]]):
        self.frames = frames


def frame_list(frames: Iterable[int]) -> str:
    """Ids as the reader's option ``frames``: runs of ids as ranges, ``3,7-9``."""
    out: list[list[int]] = []
    for f in sorted(set(frames)):
        if out and out[-1][1] == f - 1:
            out[-1][1] = f
        else:
            out.append([f, f])
    return ",".join(str(a) if a == b else f"{a}-{b}" for a, b in out)


def _condition(f: Filter) -> tuple[str, tuple] | None:
    """A filter on ``frame_id`` as SQL on the frame table; None for any other."""
    if getattr(f, "attribute", None) != ("frame_id",):
        return None
    if isinstance(f, In):
        return "Id IN (SELECT value FROM json_each(?))", (json.dumps([v for v in f.value if v is not None]),)
    if isinstance(f, (IsNull, IsNotNull)):
        return f"Id IS {'NOT ' * isinstance(f, IsNotNull)}NULL", ()
    signs = {EqualTo: "=", EqualNullSafe: "IS", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
    return (f"Id {signs[type(f)]} ?", (f.value,)) if type(f) in signs else None


class TdfReader(DataSourceReader):
    """Partitions hold whole frames, up to ``bytes_per_partition`` of records each (a larger frame alone)."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("bytes_per_partition", 32 << 20))
        self.conditions: list[tuple[str, tuple]] = []
        if "frames" in options:
            ends = [[int(x) for x in r.split("-")] for r in options["frames"].split(",") if r]
            ranges = json.dumps([[e[0], e[-1]] for e in ends])
            self.conditions.append(("EXISTS (SELECT 1 FROM json_each(?) r WHERE f.Id BETWEEN json_extract(r.value, '$[0]') AND json_extract(r.value, '$[1]'))", (ranges,)))

    def partitions(self) -> list[_Frames]:
        # a record reaches to the next one's place; what no condition keeps is neither listed nor read
        places = "SELECT Id, TimsId, NumPeaks, coalesce(lead(TimsId) OVER (ORDER BY TimsId), ?) - TimsId AS size FROM Frames"
        kept = " AND ".join(["NumPeaks > 0", *(c for c, _ in self.conditions)])
        end = os.path.getsize(f"{self.path}/analysis.tdf_bin")
        out, held = [[]], 0
        for frame, at, size in _rows(self.path, f"SELECT Id, TimsId, size FROM ({places}) f WHERE {kept} ORDER BY TimsId", given=(end, *(v for _, vs in self.conditions for v in vs))):
            if out[-1] and held + size > self.most:
                out.append([])
                held = 0
            out[-1].append((frame, at))
            held += size
        return [_Frames(p) for p in out]

    def read(self, partition: _Frames) -> Iterator[pa.RecordBatch]:
        for frame, record in _records(self.path, partition.frames):
            yield _as_points(frame, record)


class PrunedReader(TdfReader):
    """Takes Spark's conditions on ``frame_id`` (equality, sets, ranges): only those frames are listed, read and decoded.

    Spark is asked to check them again, so that two scans under different conditions don't look alike to it.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.conditions += [taken for f in filters if (taken := _condition(f)) is not None]
        return filters


def _records(path: str, frames: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """The raw record of each (frame, place in the binary file)."""
    with open(f"{path}/analysis.tdf_bin", "rb") as f:
        for frame, at in frames:
            f.seek(at)
            head = f.read(HEADER)
            if len(head) < HEADER:
                raise ShortRecordError("short record")
            yield frame, head + f.read(max(0, struct.unpack("<II", head)[0] - HEADER))


class TdfSource(DataSource):
    """``spark.read.format("tdf").load(folder)``: the points of a run.

    The option ``frames`` (``3,7-9``) names the frames to read. With the option ``pruned`` conditions on ``frame_id`` prune
    frames too; Spark asks for that only where the setting of ``PUSHDOWN`` is on, and refuses such a reader where it is off.
    """

    @classmethod
    def name(cls) -> str:
        return "tdf"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> TdfReader:
        _connect(self.options["path"]).close()
        return (PrunedReader if self.options.get("pruned", "false").lower() == "true" else TdfReader)(self.options)


class TdfRecords(DataSource):
    """``records.write.format("tdf_records").option("frames", n).mode("append").save(folder)``: records at their places, in one commit."""

    @classmethod
    def name(cls) -> str:
        return "tdf_records"

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        names = [f.name for f in schema.fields]
        return RecordWriter(self.options["path"], int(self.options["start"]), [names.index(c) for c in WRITTEN])


#: Fixed value: Spark's setting for filters in Python sources.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def read_points(spark: SparkSession, path: str, frames: Iterable[int] | None = None, pruned: bool = False) -> DataFrame:
    """The points of a run, or of some of its frames; no other record is touched.

    With ``pruned`` conditions on ``frame_id`` reach the reader, for which the session's setting is turned on. Let a query
    scan such a table once only: Spark 4.1 keeps one plan of partitions for all scans of a table, that of the last one's
    conditions, so a union or self-join of it under two conditions would lose rows. ``frames`` has no such limit.
    """
    spark.dataSource.register(TdfSource)
    reader = spark.read.format("tdf")
    if frames is not None:
        reader = reader.option("frames", frame_list(frames))
    if pruned:
        spark.conf.set(PUSHDOWN, "true")
        reader = reader.option("pruned", "true")
    return reader.load(path)


def read_levels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The points of MS1 frames and those of MS/MS frames, each from its own records only."""
    return tuple(read_points(spark, path, [r[0] for r in _rows(path, f"SELECT Id FROM Frames WHERE MsMsType {sign} 0")]) for sign in ("=", "<>"))


def header_length(path: str) -> int:
    return max(0, _rows(path, "SELECT coalesce(min(TimsId), 0) FROM Frames")[0][0])


def _staging(spark: SparkSession, target: str) -> str:
    """A new folder for the records: in the cluster's checkpoint folder if it names one, else beside the run on its shared storage."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{named.rstrip('/')}/records-{uuid.uuid4().hex}" if named else f"file://{os.path.abspath(target)}.records-{uuid.uuid4().hex}"


def write_run(points: DataFrame, frames: DataFrame, source: str, target: str, force: bool = False, done=None) -> None:
    """Writes a run folder: the source's files and header, new records in frame order, updated metadata.

    Records go to a table first, which is the only time that ``points`` are computed; their lengths give the places, and
    tasks write their records there under one commit (``RecordWriter``). Only one row of numbers per frame reaches the
    driver. The source is checked before anything is touched, and the new folder takes the place of an old ``target``
    only when it is complete. ``done``, an accumulator, counts finished frames.
    """
    spark = points.sparkSession
    _connect(source).close()
    if os.path.realpath(source) == os.path.realpath(target):
        raise ValueError("a run is not written over itself")
    if os.path.exists(target) and not force:
        raise FileExistsError(target)
    made, staged = f"{target.rstrip('/')}.part-{uuid.uuid4().hex}", _staging(spark, target)
    try:
        shutil.copytree(source, made, ignore=lambda d, names: ["analysis.tdf_bin"] if os.path.samefile(d, source) else [])
        _write_records(points, frames, source, made, staged, done)
        if os.path.exists(target):
            replace_in_place(target.rstrip("/"), made)
        else:
            os.rename(made, target)
    finally:
        shutil.rmtree(made, ignore_errors=True)
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


#: What the record writer needs of each row.
WRITTEN = ("frame_id", "at", "record", "num_peaks", "max_intensity", "summed_intensities")


@dataclass
class Placed(WriterCommitMessage):
    """What one task wrote: of each frame its id, place, length and the numbers for the frame table."""

    rows: list[tuple[int, int, int, int, int, int]]


class RecordWriter(DataSourceWriter):
    """Puts records at their given places of a file that nobody reads until all are there.

    Each task reports what it wrote; an attempt that runs again, or one that is late, writes the same bytes to the same
    places. ``commit`` runs once, with one message for each task: it demands that the records lie end to end from
    ``start`` to the file's end and that every frame of the table has one, updates the frame table in one transaction
    and then gives the file its name. ``abort`` removes the file, so the folder has no binary file.
    """

    def __init__(self, path: str, start: int, order: list[int]):
        self.path, self.start, self.order = path, start, order
        self.made = f"{path}/analysis.tdf_bin.part"

    def write(self, rows: Iterator) -> Placed:
        out = []
        with open(self.made, "r+b") as f:
            for row in rows:
                frame, at, record, *numbers = (row[k] for k in self.order)
                f.seek(at)
                f.write(record)
                out.append((frame, at, len(record), *numbers))
            f.flush()
            os.fsync(f.fileno())
        return Placed(out)

    def commit(self, messages: list[Placed | None]) -> None:
        rows = sorted((r for m in messages if m is not None for r in m.rows), key=lambda r: r[1])
        db = sqlite3.connect(f"{self.path}/analysis.tdf")
        try:
            frames = {r[0] for r in db.execute("SELECT Id FROM Frames")}
            if len(rows) != len(frames) or {r[0] for r in rows} != frames:
                raise RecordError(f"{len(rows)} records for {len(frames)} frames")
            end = self.start
            for frame, at, size, *_ in rows:
                if at != end:
                    raise RecordError(f"frame {frame} stands at {at}, not {end}")
                end = at + size
            if end != os.path.getsize(self.made):
                raise RecordError(f"records end at {end}, the file doesn't")
            with db:
                db.executemany("UPDATE Frames SET TimsId = ?, NumPeaks = ?, MaxIntensity = ?, SummedIntensities = ? WHERE Id = ?", [(at, *numbers, frame) for frame, at, _, *numbers in rows])
                db.execute("UPDATE GlobalMetadata SET Value = '2' WHERE Key = 'TimsCompressionType'")
        finally:
            db.close()
        os.replace(self.made, f"{self.path}/analysis.tdf_bin")

    def abort(self, messages: list[Placed | None]) -> None:
        Path(self.made).unlink(missing_ok=True)


def _write_records(points: DataFrame, frames: DataFrame, source: str, made: str, staged: str, done=None) -> None:
    spark = points.sparkSession
    encode(points, frames, done).write.parquet(staged)
    records = spark.read.schema(RECORDS).parquet(staged)
    rows = records.select("frame_id", F.length("record").cast("long").alias("n")).orderBy("frame_id").toArrow()
    head, n = header_length(source), rows["n"].to_numpy()
    with open(f"{source}/analysis.tdf_bin", "rb") as f, open(f"{made}/analysis.tdf_bin.part", "wb") as g:
        g.write(f.read(head))
        g.truncate(head + int(n.sum()))
    places = spark.createDataFrame(pa.table({"frame_id": rows["frame_id"], "at": pa.array(head + np.cumsum(n) - n)}))
    spark.dataSource.register(TdfRecords)
    records.join(places, "frame_id").select(*WRITTEN).write.format("tdf_records").option("start", head).mode("append").save(made)


def replace_in_place(source: str, made: str) -> None:
    """Puts the folder ``made`` in the place of ``source``; if that fails, the source is put back."""
    backup = f"{source}.backup"
    os.rename(source, backup)
    try:
        os.rename(made, source)
    except OSError:
        os.rename(backup, source)
        raise
    shutil.rmtree(backup)


def validate(spark: SparkSession, path: str) -> DataFrame:
    """``frame_id, num_peaks, read`` of frames whose stored and read counts differ; no rows means that the run is sound."""
    n = read_points(spark, path).groupBy("frame_id").agg(F.count(F.lit(1)).alias("read"))
    return read_frames(spark, path).select("frame_id", "num_peaks").join(n, "frame_id", "full").withColumn("read", F.coalesce("read", F.lit(0))).where("num_peaks is distinct from read")


def _prints(scan: np.ndarray, tof: np.ndarray, intensity: np.ndarray) -> np.ndarray:
    """Four numbers below 2**32 for each point: the halves of two 64-bit hashes."""
    u = np.uint64
    x = (scan.astype(u) << u(32)) ^ tof.astype(u)
    out = []
    for salt in (u(0x9E3779B97F4A7C15), u(0xD1B54A32D192ED03)):
        z = x * (salt | u(1)) ^ (intensity.astype(u) + salt) * u(0xBF58476D1CE4E5B9)
        for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> u(shift))) * u(k)
        z ^= z >> u(31)
        out += [z & u(0xFFFFFFFF), z >> u(32)]
    return np.stack(out).astype(np.int64)


PRINTS = [f"p{k}" for k in range(4)]


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each frame of a batch of points: its points and the sums of their prints."""
    for batch in batches:
        if batch.num_rows:
            frame, scan, tof, intensity = (batch.column(c).to_numpy() for c in ("frame_id", "scan", "tof", "intensity"))
            own, at = np.unique(frame, return_inverse=True)
            sums = np.zeros((4, len(own)), np.int64)
            for k, p in enumerate(_prints(scan, tof, intensity)):
                np.add.at(sums[k], at, p)
            yield pa.record_batch([pa.array(own), pa.array(np.bincount(at, minlength=len(own)).astype(np.int64)), *map(pa.array, sums)], names=["frame_id", "n", *PRINTS])


def cross_check(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``frame_id, problem`` of frames whose raw record at ``TimsId`` isn't what the metadata and the point source say.

    Each record is read by itself and decoded; its scan count and its number of points are held against the ``Frames``
    table, and the points against ``read_points`` in any order, by sums of hashes over each side. No rows: codec and file
    agree. No frame's points are listed; only one row of sums for each frame is shuffled.
    """
    rows = _rows(path, "SELECT Id, TimsId, NumScans, NumPeaks FROM Frames WHERE NumPeaks > 0 ORDER BY Id")[:limit]
    wanted = _local(spark, rows, frame_id=L, at=L, num_scans=I, num_peaks=L)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for frame, at in zip(batch.column("frame_id").to_pylist(), batch.column("at").to_pylist()):
                try:
                    scans, *point = decode_record(next(_records(path, [(frame, at)]))[1])
                    out.append((frame, scans, len(point[0]), *_prints(*point).sum(1).tolist(), None))
                except RecordError as e:
                    out.append((frame, None, None, *[None] * 4, f"{type(e).__name__}: {e}"))
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * 4, pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["frame_id", "scans", "raw", *[f"r{k}" for k in range(4)], "error"])

    each = ", ".join(f"r{k} long" for k in range(4))
    raw = wanted.select("frame_id", "at").mapInArrow(run, f"frame_id long, scans int, raw long, {each}, error string")
    bad = {r.frame_id for r in raw.where("error is not null").select("frame_id").collect()}
    points = read_points(spark, path)
    if bad:  # the point source would stop at such a record
        points = read_points(spark, path, [r[0] for r in rows if r[0] not in bad])
    summed = points.select("frame_id", "scan", "tof", "intensity").mapInArrow(_printed, "frame_id long, n long, " + ", ".join(f"{p} long" for p in PRINTS))
    read = summed.groupBy("frame_id").agg(F.sum("n").alias("n"), *[F.sum(p).alias(p) for p in PRINTS])
    both = wanted.join(raw, "frame_id").join(read, "frame_id", "left")
    same = (F.col("raw") == F.col("n"))
    for k, p in enumerate(PRINTS):
        same = same & (F.col(f"r{k}") == F.col(p))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("scans") != F.col("num_scans"), F.lit("scan count"))
        .when(F.col("raw") != F.col("num_peaks"), F.lit("point count")).when(~F.coalesce(same, F.lit(False)), F.lit("points"))
    )
    return both.select("frame_id", problem.alias("problem")).where("problem is not null")


def dump(points: DataFrame, calibration, path: str) -> None:
    """CSV of points: m/z, mobility, intensity, scan, TOF."""
    from ionsift.functions.scalars import scan_to_im, tof_to_mz

    shown = points.select(F.format_string("%.5f", tof_to_mz(F.col("tof"), calibration)).alias("mz"), F.format_string("%.5f", scan_to_im(F.col("scan"), calibration)).alias("one_over_k0"), "intensity", "scan", "tof")
    shown.write.option("header", True).csv(path)


def is_run_folder(path: str) -> bool:
    return all((Path(path) / f).is_file() for f in ("analysis.tdf", "analysis.tdf_bin"))
