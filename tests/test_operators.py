"""Literal cases of the point-cloud operators, and brute force on random frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionsift import model
from ionsift.functions.scalars import frame_sample
from ionsift.model import BoxCentroid, Calibration, Crop, Halo, Pads, Smooth, Streak, Watershed
from ionsift.operators import centroid, filters, gates, rewrite, stats

ONE = Streak(3, 5, 2, 0, 0, 1)
SAME = Calibration(0.0, 1.0, 0.0, 1.0)  # mz = tof ** 2


def frame(spark, points, frame_id=1):
    return spark.createDataFrame([(frame_id, i, s, t, v) for i, (s, t, v) in enumerate(points)], model.POINTS)


def cells(df):
    return sorted((r.scan, r.tof, r.intensity) for r in df.collect())


@pytest.mark.parametrize("scans,p,kept", [
    ([*range(10, 18)], Streak(iterations=1), 8),
    ([10, 12, 14], Streak(0, 5, 1, iterations=1), 0),
    ([10, 12, 14], Streak(0, 3, 1, iterations=1), 3),
    ([10, 11, 12, 14, 15, 16], Streak(0, 5, 1, iterations=1), 6),
    ([10, 11, 12, 16, 17, 18], Streak(0, 5, 1, iterations=1), 0),
    ([10], Streak(iterations=0), 1),
])
def test_streak(spark, scans, p, kept):
    assert filters.streak(frame(spark, [(s, 1000, 10) for s in scans]), p).count() == kept


def brute_streak(points, p):
    out = []
    for s, t, v in points:
        profile = {}
        for a, b, c in points:
            if abs(b - t) <= p.mz_half_width:
                profile[a] = profile.get(a, 0) + c
        occupied = sorted(x for x, y in profile.items() if y > 0 and y >= p.min_window_intensity)
        runs, run = [], []
        for x in occupied:
            if run and x - run[-1] > p.max_internal_gap + 1:
                runs.append(run)
                run = []
            run.append(x)
        runs += [run] if run else []
        if any(len(r) >= p.min_feature_length and sum(y for x, y in profile.items() if r[0] <= x <= r[-1]) >= p.min_feature_intensity and r[0] <= s <= r[-1] for r in runs):
            out.append((s, t, v))
    return sorted(out)


def random_points(seed, n=150, size=24):
    r = random.Random(seed)
    return [(r.randrange(size), r.randrange(size), r.randrange(0, 100)) for _ in range(n)]


@pytest.mark.parametrize("p", [Streak(1, 4, 1, 0, 0, 1), Streak(2, 5, 0, 60, 300, 1), Streak(0, 2, 3, 5, 0, 1)])
def test_streak_brute(spark, p):
    points = random_points(1)
    assert cells(filters.streak(frame(spark, points), p)) == brute_streak(points, p)


def test_halo(spark):
    near = lambda *more: cells(filters.halo(frame(spark, [(10, 1000, 10000), *more]), Halo(0.1, 100, 2)))
    assert near((11, 1050, 5)) == [(10, 1000, 10000)]
    for p in ((11, 1000, 5), (11, 1150, 5), (15, 1050, 5), (11, 1050, 8000)):
        assert len(near(p)) == 2
    points, h = random_points(2), Halo(0.5, 4, 2)
    want = [x for x in points if x[2] >= 0.5 * max([0, *(q[2] for q in points if q[1] != x[1] and abs(q[1] - x[1]) <= 4 and abs(q[0] - x[0]) <= 2)])]
    assert cells(filters.halo(frame(spark, points), h)) == sorted(want)


def test_precursors(spark):
    streak = [(s, 1000, 10) for s in range(100, 106)]
    df = frame(spark, [*streak, (110, 2000, 40), (300, 5, 1)], 1).unionAll(frame(spark, streak, 2))
    windows = spark.createDataFrame([(1, 100, 125, 7, 0), (2, 100, 125, 7, 1)], "frame_id long, scan_begin int, scan_end int, precursor long, event long")
    keys = filters.precursor_keys(df, windows, Streak(3, 3, 8, iterations=1))
    assert sorted((r.precursor, r.scan, r.tof) for r in keys.collect()) == [(7, s, 1000) for s in range(100, 106)]
    assert len(cells(filters.precursor_filter(df, windows, Streak(3, 3, 8, iterations=1)))) == 13
    assert filters.precursor_filter(df, windows.limit(0), Streak()).count() == 14


def test_running_average(spark):
    df = frame(spark, [(10, 1000, 90), (11, 1001, 90)], 1).unionAll(frame(spark, [(10, 1000, 90)], 2))
    two = spark.createDataFrame([(1,), (2,)], "frame_id long")
    assert cells(rewrite.running_average(df, two)) == [(10, 1000, 90), (11, 1001, 45)]
    assert cells(rewrite.running_average(frame(spark, [(1, 1, 1)]), spark.createDataFrame([(1,), (2,), (3,)], "frame_id long"))) == []


def test_smooth(spark):
    assert cells(rewrite.smooth(frame(spark, [(10, 100, 10), (10, 101, 20)]), Smooth(1, 0, 1))) == [(10, 100, 15), (10, 101, 15)]
    assert cells(rewrite.smooth(frame(spark, [(1, 1, 2), (1, 2, 100), (1, 3, 2)]), Smooth(1, 0, 1)))[1] == (1, 2, 35)
    assert cells(rewrite.smooth(frame(spark, [(1, 1, 7)]), Smooth(iterations=0))) == [(1, 1, 7)]


def test_windows(spark):
    iv = spark.createDataFrame([(1, 10, 20), (1, 30, 40)], "frame_id long, scan_begin int, scan_end int")
    df = frame(spark, [(s, 1, 1) for s in (5, 10, 15, 19, 20, 25, 30, 39, 40)])
    assert [c[0] for c in cells(gates.in_window(df, iv))] == [10, 15, 19, 30, 39]
    assert [c[0] for c in cells(gates.in_window(frame(spark, [(s, 1, 1) for s in (7, 8, 21, 22)]), iv.limit(1), 2))] == [8, 21]
    assert gates.in_window(frame(spark, [(1, 1, 1)], 9), iv).count() == 1
    dda = spark.createDataFrame([(10, 61, 90), (10, 36, 61), (10, 200, 225), (11, 5, 30), (11, 40, 40)], "frame_id long, scan_begin int, scan_end int")
    assert sorted(map(tuple, gates.dda_intervals(dda).collect())) == [(10, 36, 90), (10, 200, 225), (11, 5, 30)]


def test_per_window(spark):
    df = frame(spark, [(s, 1000, 10) for s in range(2, 8)])
    p = Streak(0, 4, 0, iterations=1)
    iv = spark.createDataFrame([(1, 0, 5), (1, 5, 10)], "frame_id long, scan_begin int, scan_end int")
    assert filters.per_window_filter(df, iv, p).count() == 0 and filters.per_window_filter(df, iv.limit(0), p).count() == 6


def test_polygon(spark):
    ident = Calibration(0.0, 1.0, 0.0, 1.0)
    square = [(a * a, b) for a, b in ((10.0, 10.0), (90.0, 10.0), (90.0, 90.0), (10.0, 90.0))]
    df = frame(spark, [(50, 50, 1), (10, 10, 1), (89, 89, 1), (50, 9, 1), (50, 91, 1), (5, 50, 1), (95, 50, 1)])
    assert cells(gates.polygon_gate(df, square, 100, ident, Pads(0.0, 0.0))) == [(10, 10, 1), (50, 50, 1), (89, 89, 1)]
    assert [c[0] for c in cells(gates.polygon_gate(frame(spark, [(8, 50, 1), (92, 50, 1), (5, 50, 1)]), square, 100, ident, Pads(0.0, 3.0)))] == [8, 92]
    assert gates.polygon_gate(df, square[:2], 100, ident).count() == 7


def test_boxes(spark):
    w = spark.createDataFrame([(1, 10, 20, 500.0, 50.0), (2, 10, 20, 500.0, 50.0), (1, 50, 50, 1.0, 1.0), (1, 1, 2, None, 1.0)], "window_group long, scan_begin int, scan_end int, isolation_mz double, isolation_width double")
    assert [tuple(r) for r in gates.dia_boxes(w).collect()] == [(10, 20, 475.0, 525.0)]


def test_crop():
    c = Calibration(0.0, 1.0, 1000.0, -1.0)
    assert gates.crop_bounds(Crop(im_min=100.0, im_max=300.0), 1000, c) == {"scan_lo": 700, "scan_hi": 900}
    assert gates.crop_bounds(Crop(mz_min=100.0, mz_max=200.0), 10, c) == {"tof_lo": 10, "tof_hi": 15}
    assert Crop().is_empty() and Crop(rt_min=1.0).has_rt()


def brute_watershed(points, p):
    order = sorted(range(len(points)), key=lambda i: (-points[i][2], points[i][0], points[i][1]))
    placed, groups = [], []
    cell = lambda s, t: (s // max(1, p.box_scan), t // max(1, p.box_mz_idx))
    for i in order:
        s, t, v = points[i]
        best = None
        for q, g in placed:
            a, b, _ = points[q]
            if abs(a - s) <= p.box_scan and abs(b - t) <= p.box_mz_idx and abs(groups[g][0][1] - t) <= p.max_tof_offset:
                k = (abs(a - s) + abs(b - t), -groups[g][0][2], cell(a, b))
                if best is None or k < best[0]:
                    best = (k, g)
        if best:
            groups[best[1]].append((s, t, v))
            placed.append((i, best[1]))
        elif v >= p.min_seed_intensity:
            groups.append([(s, t, v)])
            placed.append((i, len(groups) - 1))
    return group_cells(groups)


def brute_box(points, p):
    order = sorted(range(len(points)), key=lambda i: (-points[i][2], points[i][0], points[i][1]))
    groups, free = [], list(order)
    while free:
        s, t, _ = points[free[0]]
        take = [i for i in free if abs(points[i][0] - s) <= p.scan_half and abs(points[i][1] - t) <= p.mz_idx_half]
        groups.append([points[i] for i in take])
        free = [i for i in free if i not in set(take)]
    return group_cells(groups)


def group_cells(groups):
    """Rounded intensity-weighted means of groups; those on one cell are summed."""
    out = {}
    for g in groups:
        total = sum(v for *_, v in g)
        if total:
            at = tuple((2 * sum(x[k] * x[2] for x in g) + total) // (2 * total) for k in (0, 1))
            out[at] = out.get(at, 0) + total
    return sorted((*k, v) for k, v in out.items())


def test_watershed(spark):
    run = lambda pts, p=Watershed(5, 3, 0, 0, 10): cells(centroid.watershed(frame(spark, pts), p))
    assert run([(10, 100, 4), (11, 100, 8), (12, 100, 10), (13, 100, 8), (14, 100, 4)], Watershed(2, 1, 0, 0, 10)) == [(12, 100, 34)]
    assert run([(10, 100, 3)], Watershed(5, 3, 5, 0, 10)) == [] and run([(10, 100, 10), (10, 100, 20)]) == [(10, 100, 30)]
    stairs = [(10, t, 100 - t + 100) for t in range(100, 111, 2)]
    assert len(run(stairs, Watershed(1, 2, 0, 0, 100))) == 1 and len(run(stairs, Watershed(1, 2, 0, 0, 4))) > 1
    block = [(s, t, 100) for s in range(48, 53) for t in range(998, 1003)]
    assert run(block, Watershed()) == [(50, 1000, 2500)] and run([(0, 0, 0)]) == [(0, 0, 0)]
    points = [x for x in random_points(7) if x[2]]
    for p in (Watershed(2, 2, 0, 0, 3), Watershed(3, 1, 40, 0, 2)):
        assert sorted(run(points, p)) == brute_watershed(points, p)


def test_box(spark):
    run = lambda pts, p=BoxCentroid(): cells(centroid.box_centroid(frame(spark, pts), p))
    assert [c[2] for c in run([(10, 100, 10), (10, 100, 20), (11, 101, 5)])] == [35]
    streak = run([(s, 100, 10) for s in range(15)])
    assert 3 <= len(streak) < 15 and sum(c[2] for c in streak) == 150 and {c[1] for c in streak} == {100}
    assert run([(10, 10, 5), (50, 500, 100)], BoxCentroid(2, 2, 10)) == [(50, 500, 100)]
    points = [x for x in random_points(8) if x[2]]
    for p in (BoxCentroid(2, 2, 0), BoxCentroid(1, 3, 0)):
        assert sorted(run(points, p)) == brute_box(points, p)


def test_most_groups():
    """After the last group that a frame may have, its fainter points are dropped, as documented."""
    pts = np.array([(0, 10 * i, 50, 100 - i, i) for i in range(6)] + [(0, 1, 50, 5, 9), (1, 3, 50, 5, 1)])
    frame_, scan, tof, intensity, point_id = pts.T
    place = centroid.places(frame_, scan, tof, intensity, point_id)
    got = centroid.watershed_groups(frame_, scan, tof, intensity, place, Watershed(2, 1, 0, 0, 10), 3)
    assert got.tolist() == [0, 1, 2, -1, -1, -1, -1, 7]
    assert (centroid.watershed_groups(frame_, scan, tof, intensity, place, Watershed(2, 1, 0, 0, 10), 0) == -1).all()


def many_frames(spark, seed=1, n=1500):
    """Frames of clumps, ties and equal cells; two groups of ``by`` are null."""
    r = np.random.default_rng(seed)
    rows = [(int(f), i, int(abs(s)), int(abs(t)), int(v)) for i, (f, s, t, v) in enumerate(zip(r.integers(0, 7, n), r.normal(20, 9, n), r.normal(30, 12, n), r.choice([1, 2, 5, 5, 9, 40, 2**31], n)))]
    return spark.createDataFrame(rows, model.POINTS)


def rows_of(df):
    return sorted(map(tuple, df.select("frame_id", "point_id", "scan", "tof", "intensity").collect()))


def test_forms_agree(spark):
    """Kernels and SQL keep, and make, the same rows; kernels get whole groups however batches fall."""
    points = many_frames(spark)
    for p in (Streak(2, 3, 1, 0, 0, 1), Streak(0, 2, 0, 5, 20, 2), Streak(1, 4, 3, 3, 0, 3)):
        assert rows_of(filters.streak(points, p)) == rows_of(filters.streak(points, p, form="sql")) != rows_of(points)
        h = Halo(0.3, 3, 1)
        assert rows_of(filters.clean(points, p, h)) == rows_of(filters.clean(points, p, h, form="sql"))
    for h in (Halo(0.15, 2, 2), Halo(1.0, 1, 0), Halo(0.5, 0, 3)):
        assert rows_of(filters.halo(points, h)) == rows_of(filters.halo(points, h, form="sql"))
    for s in (Smooth(), Smooth(0, 0, 2), Smooth(1, 4, 3)):
        assert rows_of(rewrite.smooth(points, s)) == rows_of(rewrite.smooth(points, s, form="sql"))
    for h in (None, Halo(0.3, 3, 1)):
        keys = lambda form: sorted(map(tuple, filters.combine_and_filter(points, Streak(2, 3, 1, 0, 0, 2), h, ("frame_id",), form).collect()))  # noqa: B023, E731
        assert keys("arrow") == keys("sql") != []
    small = spark.newSession()
    small.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    narrow = small.createDataFrame(points.toPandas(), model.POINTS)
    assert rows_of(filters.clean(narrow, Streak(), Halo())) == rows_of(filters.clean(points, Streak(), Halo(), form="sql"))
    assert filters.clean(points.limit(0), Streak(), Halo()).count() == 0 and filters.streak(points, Streak(iterations=0)).count() == points.count()
    nulls = points.selectExpr("CASE WHEN frame_id > 1 THEN frame_id END AS frame_id", "point_id", "scan", "tof", "intensity")
    assert filters.halo(nulls, Halo(0.3, 3, 1)).where("frame_id is null").count() > 0


def test_groups_stay_whole_behind_a_join(spark):
    """Kernels get their points from an exchange of their own: a join's may be read undealt once Spark broadcasts the other side at run time."""
    wide = spark.newSession()
    wide.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    points = wide.createDataFrame(many_frames(spark).collect(), model.POINTS)
    iv = wide.createDataFrame([(f, b, b + 12) for f in range(0, 7, 2) for b in (0, 12)], "frame_id long, scan_begin int, scan_end int")
    p, h = Streak(2, 3, 1, 0, 0, 1), Halo(0.3, 3, 1)
    got = filters.per_window_filter(points, iv, p, h)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("REPARTITION_BY_COL") == 1
    placed = points.withColumn("w", F.expr("CASE WHEN frame_id % 2 = 1 THEN -1 WHEN scan < 24 THEN scan div 12 END")).where("w is not null")
    assert rows_of(got) == rows_of(filters.clean(placed, p, h, ("frame_id", "w"), form="sql")) != []


def test_msms_windows_in_a_run_stay_whole(spark):
    """The same through ``denoise``, whose points come from a join with the frames too."""
    from ionsift.model import Geometry, Plan, Stages
    from ionsift.plans.pipeline import denoise

    wide = spark.newSession()
    wide.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    points = wide.createDataFrame(many_frames(spark).collect(), model.POINTS)
    frames = wide.createDataFrame([(f, 64, 1, 9, 1.0) for f in range(7)], "frame_id long, num_scans int, num_peaks long, ms_ms_type int, rt_seconds double")
    iv = wide.createDataFrame([(f, b, b + 12) for f in range(0, 7, 2) for b in (0, 12)], "frame_id long, scan_begin int, scan_end int")
    p, h = Streak(2, 3, 1, 0, 0, 1), Halo(0.3, 3, 1)
    got = denoise(points, frames, Plan(p, Stages(halo=h, denoise_msms=p, dia_per_window=True)), Geometry(dia_windows=iv), 64)
    assert got._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 2  # MS1 and MS/MS
    want = filters.per_window_filter(points, iv, p, h).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_streak_shuffles_each_point_once(spark):
    """No explode in the plan: all passes and the halo take one exchange of the points."""
    plan = filters.clean(many_frames(spark), Streak(), Halo())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_centroids_of_many_frames(spark):
    points = many_frames(spark, 3).where("intensity < 100")
    each = lambda f: [(s, t, v) for _, _, s, t, v in rows_of(points.where(f"frame_id = {f}"))]
    w, b = Watershed(3, 2, 5, 0, 4), BoxCentroid(2, 1, 0)
    got_w, got_b = centroid.watershed(points, w).collect(), centroid.box_centroid(points, b).collect()
    for f in range(7):
        assert sorted((r.scan, r.tof, r.intensity) for r in got_w if r.frame_id == f) == brute_watershed(each(f), w)
        assert sorted((r.scan, r.tof, r.intensity) for r in got_b if r.frame_id == f) == brute_box(each(f), b)


def test_centroids_take_one_exchange_and_no_ids(spark):
    """Groups and cells are summed where their frame is, so no task holds a table of groups; equal points need no ids."""
    points = many_frames(spark, 3).where("intensity < 100")
    bare = points.drop("point_id")
    for make in (centroid.watershed, lambda x: centroid.box_centroid(x, BoxCentroid(1, 1, 0))):
        plan = make(bare)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan
        assert cells(make(bare)) == cells(make(points)) != []


def test_centroid_sums_are_exact(spark):
    """Weighted sums beyond 64 bits: the mean is rounded from whole numbers."""
    far, big = 2**40 + 1, 2**32 - 1
    points = [(3, far, big), (4, far + 2**30, big - 1)]
    total = 2 * big - 1
    mean = lambda a, b: (2 * (a * big + b * (big - 1)) + total) // (2 * total)
    assert cells(centroid.box_centroid(frame(spark, points), BoxCentroid(2**30, 2, 0))) == [(mean(3, 4), mean(far, far + 2**30), big)]


def test_numbered(spark):
    """Positions run through stretches without gaps; no task numbers the whole table."""
    from ionsift.functions.scalars import numbered

    ids = [0, 5, 65_535, 65_536, 65_540, 200_000, 200_001, 4_294_967_295]
    df = numbered(spark.createDataFrame([(i,) for i in ids[::-1]], "frame_id long"), "at")
    assert [tuple(r) for r in df.orderBy("frame_id").collect()] == list(zip(ids, range(8)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_gate_by_scan(spark):
    """One row for each scan, spans that touch or overlap merged, the same points as by comparing with every span."""
    spans = [(1, 5, 9), (1, 10, 12), (1, 20, 20), (1, 7, 8), (2, 0, 3), (4, 9, 2)] + [(7, 4 * k, 4 * k + 1) for k in range(37)]
    gate = spark.createDataFrame(spans, "scan int, tof_lo long, tof_hi long")
    merged = {r.scan: list(zip(r["__lo"], r["__end"])) for r in gates.by_scan(gate).collect()}
    assert merged[1] == [(5, 13), (20, 21)] and merged[2] == [(0, 4)] and 4 not in merged and len(merged[7]) == 37
    points = spark.createDataFrame([(1, 1, s, t, 1) for s in range(9) for t in range(160)], model.POINTS)
    got = {(r.scan, r.tof) for r in gates._within(points, gate, 9).collect()}
    assert got == {(s, t) for s, a, b in spans for t in range(a, b + 1)}
    assert gates._within(points, gate.limit(0), 9).count() == 0 and gates._within(points, gate.limit(0), 9, True).count() == points.count()


def test_sample(spark):
    df = spark.range(20_000).withColumnRenamed("id", "frame_id")
    assert frame_sample(df, 1.0, 42).count() == 20_000 and frame_sample(df.limit(1000), 0.0, 42).count() <= 1
    assert 0.22 < frame_sample(df, 0.25, 123).count() / 20_000 < 0.28


def test_stats(spark):
    frames = spark.createDataFrame([(1, 10, 2, 0, 60.0), (2, 10, 0, 9, 120.0)], model.FRAMES)
    got = sorted(map(tuple, stats.frame_stats(frame(spark, [(1, 1, 5), (2, 2, 7)]), frames).collect()))
    assert got == [(1, 2, 7, 12), (2, 0, 0, 0)] and stats.acquisition(frames).first()[0] == "DiaPasef"


def test_settings(tmp_path):
    text = model.dump_settings({"halo": False, "mz_ppm": 10.0, "iterations": 3, "rt_min": None})
    (tmp_path / "s.toml").write_text(text)
    assert model.load_settings(str(tmp_path / "s.toml")) == {"halo": False, "mz_ppm": 10.0, "iterations": 3}
    with pytest.raises(ValueError):
        model.check_settings({"nope": 1})
    plan = model.resolve({"iterations": 1}, {"iterations": 4, "halo": False, "denoise_msms": True, "msms_min_feature_length": 9})
    assert plan.streak.iterations == 1 and plan.stages.halo is None and plan.stages.denoise_msms.min_feature_length == 9
    assert plan.stages.dia_window == 0 and plan.stages.dia_per_window and plan.stages.ms1_polygon == Pads()
    with pytest.raises(ValueError):
        model.resolve({"crop_only": True})
    assert model.preset_gates("auto", "DiaPasef") == {"ms1_polygon": False, "dia_ms1_window": True, "dia_window": True}
    assert model.tof_half_width(10.0, Calibration(0.0, 0.001, 1.0, -0.1)) == max(1, round((800.008**0.5 - 800**0.5) / 0.001))
    assert SAME.mz(3) == 9 and F is not None
