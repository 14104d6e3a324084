"""Records, run folders, the command line and streams."""

import json
import os
import shutil
import sqlite3
import struct
import threading
import time

import numpy as np
import pytest
import zstandard

from ionsift import cli, model
from ionsift.model import Plan, Stages, Streak
from ionsift.plans.context import Cancelled, Control, RunContext
from ionsift.plans.pipeline import denoise
from ionsift.sources import tdf
from ionsift.streaming.frames import denoise_stream


@pytest.mark.parametrize("points,scans", [([(42, 7, 9)], 700), ([(0, 5, 2**31 - 1), (699, 2**31 - 5, 3), (10, 7, 1), (10, 3, 2), (10, 3, 2)], 700)])
def test_record(points, scans):
    a = np.array(points)
    n, *back = tdf.decode_record(tdf.encode_record(scans, *a.T))
    assert n == scans and sorted(zip(*map(list, back))) == sorted(points)


def test_record_errors():
    none = np.zeros(0, np.int64)
    assert tdf.encode_record(512, none, none, none) == struct.pack("<II", 8, 512)
    good = tdf.encode_record(5, np.array([1]), np.array([1]), np.array([1]))
    payload = lambda *values: zstandard.ZstdCompressor().compress(np.array(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    record = lambda data: struct.pack("<II", 8 + len(data), 5) + data
    for bad, kind in (
        (b"1234567", tdf.ShortRecordError), (struct.pack("<I", 99) + good[4:20], tdf.ByteCountError), (struct.pack("<I", 4) + good[4:], tdf.ByteCountError),
        (struct.pack("<II", 8, 512), tdf.CompressionError), (record(b"not zstd"), tdf.CompressionError), (record(zstandard.ZstdCompressor().compress(b"12345")), tdf.MisalignedError),
        (record(payload(9, 0, 0)), tdf.ScanCountError), (record(payload(2, 40, 1, 1)), tdf.ScanCountError),
    ):
        with pytest.raises(kind) as e:
            tdf.decode_record(bad)
        assert isinstance(e.value, tdf.RecordError)
    with pytest.raises(ValueError):
        tdf.encode_record(5, np.array([5]), np.array([1]), np.array([1]))


@pytest.fixture
def run_folder(tmp_path):
    path = tmp_path / "run.d"
    path.mkdir()
    db = sqlite3.connect(path / "analysis.tdf")
    db.execute("CREATE TABLE Frames (Id, NumScans, NumPeaks, MsMsType, Time, TimsId, MaxIntensity, SummedIntensities, MzCalibration, TimsCalibration)")
    db.execute("CREATE TABLE GlobalMetadata (Key, Value)")
    db.executemany("INSERT INTO GlobalMetadata VALUES (?, ?)", [("TimsCompressionType", "1"), ("MzAcqRangeLower", "100"), ("MzAcqRangeUpper", "1700")])
    at, blob = 64, b"h" * 64
    for i in range(1, 7):
        pts = np.array([(s, 100 + i, 10) for s in range(10, 18)] + [(30, 5, 1)] if i != 3 else np.zeros((0, 3), np.int64)).reshape(-1, 3)
        record = tdf.encode_record(100, *pts.T)
        db.execute("INSERT INTO Frames VALUES (?, 100, ?, ?, ?, ?, 0, 0, 1, 1)", (i, len(pts), 0 if i % 2 else 9, i * 60.0, at))
        blob, at = blob + record, at + len(record)
    db.commit()
    db.close()
    (path / "analysis.tdf_bin").write_bytes(blob)
    return str(path)


def test_run_folder(spark, run_folder, tmp_path):
    out, report = str(tmp_path / "out.d"), str(tmp_path / "r.json")
    a = cli.parse([run_folder, out, "--report", report, "--rt-max", "4.5"])
    done = cli.run(spark, a)
    assert done["stats"]["frames"] == 6 and done["stats"]["cropped_frames"] == 2 and done["acquisition"] == "DiaPasef"
    written = json.loads((tmp_path / "r.json").read_text())
    assert written == json.loads(json.dumps(done)) and written["config"]["crop"]["rt_max"] == 4.5 and written["output"] == out and not written["dry_run"]
    assert written["stats"]["raw_points"] == 45 and 0 < written["stats"]["kept_points"] < 45 and written["elapsed_seconds"] > 0
    assert tdf.validate(spark, run_folder).count() == 0 and tdf.validate(spark, out).count() == 0
    kept = tdf.read_points(spark, out)
    assert kept.where("frame_id = 1").count() == 8 and kept.where("frame_id = 2").count() == 9 and kept.where("frame_id >= 5").count() == 0
    assert open(f"{out}/analysis.tdf_bin", "rb").read(64) == b"h" * 64
    assert tdf.calibration_segments(out) == (1, 1) and tdf.read_acquired_mz(out) == (100.0, 1700.0)
    with pytest.raises(FileExistsError):
        cli.run(spark, cli.parse([run_folder, out]))
    cli.run(spark, cli.parse([run_folder, "--in-place"]))
    assert tdf.read_points(spark, run_folder).where("frame_id = 1").count() == 8
    dry = cli.run(spark, cli.parse([run_folder, "--dry-run", "--sample", "1.0"]))
    assert dry["stats"]["processed_frames"] == 6 and dry["output"] is None


def test_bad_arguments(run_folder):
    for argv in (["x"], ["x", "--dry-run", "--in-place"], ["x", "y", "--sample", "0.5"]):
        with pytest.raises(SystemExit):
            cli.parse(argv)
    with pytest.raises(ValueError):
        tdf._connect("/nowhere")


def test_stream(spark, tmp_path):
    schema = "frame_id long, num_scans int, ms_ms_type int, rt_seconds double, points array<struct<scan:int,tof:long,intensity:long>>"
    rows = [(i, 100, 0, float(i), [(s, 50, 10) for s in range(10, 18)] + [(60, 5, 1)]) for i in range(4)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    got = []
    q = denoise_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), Plan(Streak(iterations=1)), lambda df, n: got.extend(df.collect()), f"{tmp_path}/cp", num_scans=100)
    q.awaitTermination(120)
    assert len(got) == 32
    with pytest.raises(ValueError):
        denoise_stream(None, Plan(stages=Stages(frame_half_width=1)), print, "")


def test_crop_only_keeps_points(spark):
    points = spark.createDataFrame([(1, 1, 5, 5, 5), (1, 2, 6, 6, 50)], model.POINTS)
    frames = spark.createDataFrame([(1, 10, 2, 0, 6.0)], model.FRAMES)
    assert denoise(points, frames, Plan(crop_only=True)).count() == 2
    assert denoise(points, frames, Plan(crop=model.Crop(min_intensity=10), crop_only=True)).count() == 1


def points_of(df):
    return sorted(map(tuple, df.select("frame_id", "scan", "tof", "intensity").collect()))


def test_frames_pulled_one_by_one(spark, run_folder, tmp_path):
    """What a frame gives by itself is what the written run holds of it."""
    out = str(tmp_path / "out.d")
    cli.run(spark, cli.parse([run_folder, out]))
    pulled = RunContext(spark, run_folder)
    assert len(pulled) == 6 and [pulled.is_ms1(i) for i in range(6)] == [True, False] * 3
    assert sum((points_of(pulled.process(i)) for i in range(6)), []) == points_of(tdf.read_points(spark, out))
    summed = RunContext(spark, run_folder, Plan(stages=Stages(frame_half_width=1)))
    whole = points_of(denoise(tdf.read_points(spark, run_folder), tdf.read_frames(spark, run_folder), summed.plan))
    assert points_of(summed.process(4)) == [p for p in whole if p[0] == 5] != []
    assert summed.ms1_frames == 3 and not summed.is_empty() and summed.calibration is None
    with pytest.raises(ValueError):
        RunContext(spark, run_folder, Plan(crop=model.Crop(rt_max=1.0)))


def make_run(path, frames, extra=()):
    """A run folder of (id, MS/MS type, points); ``extra``: (table and columns, rows)."""
    path.mkdir()
    db = sqlite3.connect(path / "analysis.tdf")
    db.execute("CREATE TABLE Frames (Id, NumScans, NumPeaks, MsMsType, Time, TimsId, MaxIntensity, SummedIntensities)")
    db.execute("CREATE TABLE GlobalMetadata (Key, Value)")
    blob = b"h" * 16
    for i, kind, pts in frames:
        record = tdf.encode_record(64, *np.array(pts, np.int64).reshape(-1, 3).T)
        db.execute("INSERT INTO Frames VALUES (?, 64, ?, ?, ?, ?, 0, 0)", (i, len(pts), kind, i * 6.0, len(blob)))
        blob += record
    for table, rows in extra:
        db.execute(f"CREATE TABLE {table}")
        db.executemany(f"INSERT INTO {table.split()[0]} VALUES ({','.join('?' * len(rows[0]))})", rows)
    db.commit()
    db.close()
    (path / "analysis.tdf_bin").write_bytes(blob)
    return str(path)


def clumps(seed, n=140):
    r = np.random.default_rng(seed)
    return np.unique(np.stack([r.integers(0, 64, n), 50 + r.integers(0, 3, n) * 9 + r.integers(0, 2, n), r.integers(1, 50, n)], 1), axis=0).tolist()


@pytest.fixture
def dda_folder(tmp_path):
    """Eight frames, two of them MS1; precursors are spread over frames, some scans have none, some windows precursor 0."""
    windows = [(i, 4 * k, 4 * k + 9 + i % 3, [3, 7, 0, 9][k % 4]) for i in (2, 3, 4, 6, 7, 8) for k in (1, 4, 7, 10)]
    return make_run(tmp_path / "dda.d", [(i, 0 if i in (1, 5) else 8, clumps(i) if i != 8 else []) for i in range(1, 9)], [("PasefFrameMsMsInfo (Frame, ScanNumBegin, ScanNumEnd, Precursor)", windows)])


def test_pulled_frames_of_summed_precursors(spark, dda_folder, tmp_path, monkeypatch):
    """ddaPASEF: a pulled frame is what the writer keeps of it, and reads only its own records and its precursors' buckets."""
    monkeypatch.setattr(RunContext, "BUCKET", 100)
    out = str(tmp_path / "out.d")
    flags = ["--denoise-msms", "--msms-min-feature-length", "2", "--halo-mz-idx-half-width", "3", "--dda-window"]
    cli.run(spark, cli.parse([dda_folder, out, *flags]))
    plan = model.resolve({"denoise_msms": True, "msms_min_feature_length": 2, "halo_mz_idx_half_width": 3, "dda_window": True})
    with RunContext(spark, dda_folder, plan) as run:
        pulled = [points_of(run.process(i)) for i in range(len(run))]
        want = points_of(tdf.read_points(spark, out))
        assert sum(pulled, []) == want and 0 < sum(p[0] in (2, 3, 4) for p in want) < 400
        every = [(run.meta[i].frame_id, *p) for i, frame in run.frames() for p in frame.itertuples(index=False, name=None)]
        assert every == want
        cells = run.built.cells.where("precursor in (3)")._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(precursor), EqualTo(precursor,3)]" in cells
        assert [c.name for c in spark.catalog.listColumns(run.tables[0]) if c.isBucket] == ["precursor"]
        damage(dda_folder, 6)
        assert points_of(run.process(1)) == pulled[1]
        with pytest.raises(Exception, match="zstd"):
            run.process(5).collect()
        names = list(run.tables)
    assert names and not any(spark.catalog.tableExists(t) for t in names)


def damage(folder, frame):
    """Overwrites the payload of a frame's record."""
    db = sqlite3.connect(f"{folder}/analysis.tdf")
    at = db.execute("SELECT TimsId FROM Frames WHERE Id = ?", (frame,)).fetchone()[0]
    db.close()
    with open(f"{folder}/analysis.tdf_bin", "r+b") as f:
        f.seek(at + 8)
        f.write(b"\0" * 12)


def test_pulled_frames_under_gates(spark, tmp_path):
    """Box gate, polygon gate, window gate and per-window filter: pulled frames equal the written run."""
    c = model.Calibration(10.0, 0.2, 1.6, -0.01)
    dia = [("DiaFrameMsMsInfo (Frame, WindowGroup)", [(2, 1), (4, 2)]), ("DiaFrameMsMsWindows (WindowGroup, ScanNumBegin, ScanNumEnd, IsolationMz, IsolationWidth)", [(1, 0, 20, 430.0, 40.0), (1, 25, 50, 480.0, 40.0), (2, 10, 40, 500.0, 40.0)])]
    ring = [struct.pack("<4d", *x) for x in ((400.0, 600.0, 600.0, 400.0), (1.0, 1.0, 1.5, 1.5))]
    polygon = [("PropertyDefinitions (Id, PermanentName)", [(1, "IMS_PolygonFilter_Mass"), (2, "IMS_PolygonFilter_Mobility")]), ("GroupProperties (Property, Value)", [(1, ring[0]), (2, ring[1])])]
    for name, extra, flags in (("dia", dia, {"all_frames": True, "dia_ms1_im_pad": 0.0, "dia_ms1_mz_pad": 0.5}), ("poly", polygon, {"ms1_polygon_mz_pad": 0.0, "frame_half_width": 1})):
        folder = make_run(tmp_path / f"{name}.d", [(i, 0 if i in (1, 3, 5) else 9, clumps(i, 400)) for i in range(1, 6)], extra)
        plan = model.resolve(flags | {"min_feature_length": 3, "halo_mz_idx_half_width": 2})
        whole = denoise(tdf.read_points(spark, folder), tdf.read_frames(spark, folder), plan, tdf.geometry(spark, folder, c))
        with RunContext(spark, folder, plan, tdf.geometry(spark, folder, c)) as run:
            assert run.calibration == c
            pulled = sum((points_of(run.process(i)) for i in range(5)), [])
            assert pulled == points_of(whole) and 0 < len([p for p in pulled if p[0] % 2]) < tdf.read_points(spark, folder).where("frame_id % 2 = 1").count()


def test_only_named_frames_are_read(spark, run_folder):
    """Frames that are not asked for are neither listed nor read: a damaged one elsewhere does no harm."""
    assert tdf.frame_list([9, 3, 7, 8, 3]) == "3,7-9" and tdf.frame_list([]) == ""
    want = points_of(tdf.read_points(spark, run_folder))
    damage(run_folder, 4)
    for some in ([1, 2, 5], [1], [6, 5], []):
        assert points_of(tdf.read_points(spark, run_folder, some)) == [p for p in want if p[0] in some]
    one, two = (tdf.read_points(spark, run_folder, f) for f in ([1, 2], [5]))
    assert points_of(one.unionAll(two)) == points_of(one.unionAll(two.where("frame_id = 5"))) == [p for p in want if p[0] in (1, 2, 5)]
    # conditions on the table itself
    pruned = lambda: tdf.read_points(spark, run_folder, pruned=True)
    assert points_of(pruned().where("frame_id in (1, 2, 5)")) == [p for p in want if p[0] in (1, 2, 5)]
    assert points_of(pruned().where("frame_id = 5")) == [p for p in want if p[0] == 5]
    assert points_of(pruned().where("frame_id > 0 and frame_id <= 2 and intensity > 5")) == [p for p in want if p[0] <= 2 and p[3] > 5]
    assert pruned().where("frame_id is null").count() == 0 and pruned().where("frame_id in (77)").count() == 0
    for broken in (pruned().where("frame_id >= 3"), tdf.read_points(spark, run_folder, [4]), tdf.read_points(spark, run_folder).where("frame_id = 5")):
        with pytest.raises(Exception, match="zstd"):
            broken.collect()
    reader = tdf.PrunedReader({"path": run_folder, "bytes_per_partition": "1"})
    assert [[f for f, _ in p.frames] for p in reader.partitions()] == [[1], [2], [4], [5], [6]]
    assert len(tdf.TdfReader({"path": run_folder}).partitions()) == 1


def test_record_commit(run_folder, tmp_path):
    """Attempts that run again change nothing; a missing, doubled or misplaced record stops the commit and leaves no file."""
    rows = [(i, 64 + 20 * (i - 1), bytes([i]) * 20, 1, 2, 3) for i in range(1, 7)]

    def writer():
        (tmp_path / "w").mkdir(exist_ok=True)
        shutil.copy(f"{run_folder}/analysis.tdf", tmp_path / "w/analysis.tdf")
        (tmp_path / "w/analysis.tdf_bin.part").write_bytes(b"h" * 64 + bytes(120))
        return tdf.RecordWriter(str(tmp_path / "w"), 64, list(range(6)))

    def lost(some):
        yield from some
        raise OSError("the executor is lost")

    w = writer()
    with pytest.raises(OSError):
        w.write(lost(rows[:2]))
    messages = [w.write(iter(rows[:3])), None, w.write(iter(rows[3:]))]
    w.write(iter(rows[:3]))  # an attempt that is late
    w.commit(messages)
    assert (tmp_path / "w/analysis.tdf_bin").read_bytes() == b"h" * 64 + b"".join(r[2] for r in rows)
    assert sqlite3.connect(tmp_path / "w/analysis.tdf").execute("SELECT TimsId, NumPeaks, MaxIntensity, SummedIntensities FROM Frames WHERE Id = 2").fetchone() == (84, 1, 2, 3)
    os.remove(tmp_path / "w/analysis.tdf_bin")
    for bad in (rows[:5], rows + rows[:1], [*rows[:5], (6, 165, *rows[5][2:])], [*rows[:5], (6, 164, b"x" * 19, 1, 2, 3)]):
        w = writer()
        messages = [w.write(iter(bad))]
        with pytest.raises(tdf.RecordError):
            w.commit(messages)
        w.abort(messages)
        assert not [f for f in os.listdir(tmp_path / "w") if "bin" in f]


def test_validate_finds_what_is_off(spark, run_folder):
    """Counts that differ either way, and frames that hold points but are listed as empty."""
    db = sqlite3.connect(f"{run_folder}/analysis.tdf")
    with db:
        db.execute("UPDATE Frames SET NumPeaks = 7 WHERE Id = 1")
        db.execute("UPDATE Frames SET NumPeaks = 11 WHERE Id = 5")
    db.close()
    assert sorted(map(tuple, tdf.validate(spark, run_folder).collect())) == [(1, 7, 9), (5, 11, 9)]


def test_points_are_not_shuffled_for_the_frame_table(spark, run_folder):
    """The frame table is broadcast by its known size: one exchange of points, before the kernel."""
    kept = denoise(tdf.read_points(spark, run_folder), tdf.read_frames(spark, run_folder), Plan(stages=Stages(halo=model.Halo())))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and plan.count("Exchange hashpartitioning") == 1
    apart = denoise(tdf.read_points(spark, run_folder), tdf.read_frames(spark, run_folder), Plan(stages=Stages(halo=model.Halo())), levels=tdf.read_levels(spark, run_folder))
    plan = apart._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and points_of(apart) == points_of(kept)


def test_cross_check(spark, run_folder):
    assert tdf.cross_check(spark, run_folder).count() == 0
    db = sqlite3.connect(f"{run_folder}/analysis.tdf")
    with db:
        db.execute("UPDATE Frames SET NumPeaks = 5 WHERE Id = 2")
        db.execute("UPDATE Frames SET NumScans = 99 WHERE Id = 4")
    db.close()
    assert sorted(map(tuple, tdf.cross_check(spark, run_folder).collect())) == [(2, "point count"), (4, "scan count")]
    damage(run_folder, 5)
    assert [r.problem[:16] for r in tdf.cross_check(spark, run_folder).where("frame_id = 5").collect()] == ["CompressionError"]


def test_prints_tell_points_apart():
    """Fingerprints don't depend on the order, and any change of a point, or a swap between two, shows."""
    a = np.array(clumps(3)).T
    base = tdf._prints(*a).sum(1)
    assert (tdf._prints(*a[:, ::-1]).sum(1) == base).all() and (tdf._prints(*a) < 2**32).all()
    for row in range(3):
        for k in range(a.shape[1]):
            b = a.copy()
            b[row, k] += 1
            assert (tdf._prints(*b).sum(1) != base).any()
    b = a.copy()
    b[2, :2] = b[2, 1::-1]
    assert a[2, 0] == a[2, 1] or (tdf._prints(*b).sum(1) != base).any()


def test_writer_keeps_what_is_there(spark, run_folder, tmp_path):
    """Neither a bad source nor a failing job costs an existing output, and a run isn't written over itself."""
    out = tmp_path / "old.d"
    out.mkdir()
    (out / "mine").write_text("x")
    points, frames = tdf.read_points(spark, run_folder), tdf.read_frames(spark, run_folder)
    with pytest.raises(ValueError):
        tdf.write_run(points, frames, str(tmp_path / "none.d"), str(out), force=True)
    with pytest.raises(ValueError):
        tdf.write_run(points, frames, run_folder, run_folder + "/.", force=True)
    with pytest.raises(Exception):
        tdf.write_run(points.selectExpr("frame_id", "scan + 5000 AS scan", "tof", "intensity"), frames, run_folder, str(out), force=True)
    assert (out / "mine").read_text() == "x" and tdf.validate(spark, run_folder).count() == 0
    tdf.write_run(points, frames, run_folder, str(out), force=True)
    assert points_of(tdf.read_points(spark, str(out))) == points_of(points) and not (out / "mine").exists()
    assert sorted(os.listdir(tmp_path)) == ["old.d", "run.d"]


def test_progress_and_cancel(spark, run_folder, tmp_path):
    seen = []
    cli.run(spark, cli.parse([run_folder, str(tmp_path / "a.d")]), Control(spark, lambda done, total: seen.append((done, total)), 0.02))
    assert seen[-1] == (6, 6) and all(d <= t for d, t in seen) and [d for d, _ in seen] == sorted(d for d, _ in seen)
    control = Control(spark)
    threading.Timer(0.5, control.cancel).start()
    with pytest.raises(Cancelled), control:
        spark.range(8, numPartitions=8).rdd.map(lambda x: time.sleep(20)).count()
    stopped = Control(spark)
    stopped.cancel()
    with pytest.raises(Cancelled):
        cli.run(spark, cli.parse([run_folder, str(tmp_path / "b.d")]), stopped)
    assert not (tmp_path / "b.d").exists()


def test_metadata_readers(spark, run_folder, tmp_path):
    """Windows of both acquisitions, the polygon, calibration segments, and what the command makes of them."""
    assert tdf.read_pasef_windows(spark, run_folder).count() == 0 and tdf.read_polygon(run_folder) == []
    ring = [(200.0, 0.7), (1500.0, 1.0), (1500.0, 1.5), (200.0, 1.1)]
    db = sqlite3.connect(f"{run_folder}/analysis.tdf")
    with db:
        db.execute("CREATE TABLE PasefFrameMsMsInfo (Frame, ScanNumBegin, ScanNumEnd, Precursor)")
        db.executemany("INSERT INTO PasefFrameMsMsInfo VALUES (?, ?, ?, ?)", [(1, 5, 30, 7), (3, 40, 40, None)])
        db.execute("CREATE TABLE DiaFrameMsMsInfo (Frame, WindowGroup)")
        db.executemany("INSERT INTO DiaFrameMsMsInfo VALUES (?, ?)", [(1, 1), (3, 2), (1, 2)])
        db.execute("CREATE TABLE DiaFrameMsMsWindows (WindowGroup, ScanNumBegin, ScanNumEnd, IsolationMz, IsolationWidth)")
        db.executemany("INSERT INTO DiaFrameMsMsWindows VALUES (?, ?, ?, ?, ?)", [(1, 0, 20, 400.0, 25.0), (2, 10, 50, 700.0, 25.0)])
        db.execute("CREATE TABLE PropertyDefinitions (Id, PermanentName)")
        db.execute("CREATE TABLE GroupProperties (Property, Value)")
        for k, name in enumerate(("IMS_PolygonFilter_Mass", "IMS_PolygonFilter_Mobility")):
            db.execute("INSERT INTO PropertyDefinitions VALUES (?, ?)", (k, name))
            db.execute("INSERT INTO GroupProperties VALUES (?, ?)", (k, struct.pack("<4d", *(p[k] for p in ring))))
        db.execute("UPDATE Frames SET MzCalibration = 2 WHERE Id = 6")
    db.close()
    assert sorted(map(tuple, tdf.read_pasef_windows(spark, run_folder).collect())) == [(1, 5, 30, 7, 0), (3, 40, 40, 0, 1)]
    info, windows = tdf.read_dia(spark, run_folder)
    assert sorted(map(tuple, info.collect())) == [(1, 2), (3, 2)] and windows.count() == 2
    assert tdf.read_polygon(run_folder) == ring and tdf.calibration_segments(run_folder) == (2, 1)
    with pytest.warns(UserWarning, match="calibrations"):
        cli.run(spark, cli.parse([run_folder, "--dry-run", "--ms1-polygon", "--calibration", "10", "0.3", "1.6", "-0.01"]))
    with pytest.raises(ValueError, match="calibration"):
        cli.run(spark, cli.parse([run_folder, "--dry-run", "--mz-ppm", "10"]))


def test_csv(spark, tmp_path):
    points = spark.createDataFrame([(1, 1, 5, 100, 7)], model.POINTS)
    tdf.dump(points, model.Calibration(10.0, 0.1, 1.6, -0.01), str(tmp_path / "csv"))
    lines = {x for f in (tmp_path / "csv").glob("*.csv") for x in f.read_text().splitlines()}
    assert lines == {"mz,one_over_k0,intensity,scan,tof", "400.00000,1.55000,7,5,100"}


def test_whole_msms_frames(spark):
    """With all frames filtered and no windows known, an MS/MS frame is filtered as a whole."""
    points = spark.createDataFrame([(1, i, s, 50, 10) for i, s in enumerate(range(10, 18), 1)] + [(1, 99, 60, 5, 1)], model.POINTS)
    frames = spark.createDataFrame([(1, 100, 9, 9, 6.0)], model.FRAMES)
    assert denoise(points, frames, Plan()).count() == 9
    assert denoise(points, frames, Plan(stages=Stages(all_frames=True))).count() == 8
