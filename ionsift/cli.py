"""Command line: ``python -m ionsift.cli RUN.d [OUT.d] [--set key=value ...] [--no key ...]``."""

from __future__ import annotations

import argparse
import json
import shutil
import time
import warnings
from dataclasses import asdict

from pyspark.sql import SparkSession

from ionsift import model
from ionsift.model import Calibration, Plan
from ionsift.operators import stats
from ionsift.plans.context import Control
from ionsift.plans.pipeline import denoise, summary
from ionsift.sources import tdf


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="ionsift")
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--config", help="settings file (TOML)")
    for key, kind in model.KIND.items():
        flag = "--" + key.replace("_", "-")
        if kind is bool:
            p.add_argument(flag, dest=key, action="store_true", default=None)
            p.add_argument("--no-" + key.replace("_", "-"), dest=key, action="store_false")
        else:
            p.add_argument(flag, dest=key, type=kind, help="accepted for old settings; Spark's master decides" if key == "threads" else None)
    p.add_argument("--calibration", type=float, nargs=4, metavar=("A", "B", "C", "D"), help="mz = (A + B tof)^2, 1/K0 = C + D scan")
    p.add_argument("--preset", choices=["auto", *model.PRESETS])
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--sample", type=float)
    p.add_argument("--sample-seed", type=int, default=0)
    p.add_argument("--in-place", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--report", help="JSON report file")
    a = p.parse_args(argv)
    if a.dry_run and a.in_place:
        p.error("--dry-run writes nothing, so it excludes --in-place")
    if a.sample is not None and (not a.dry_run or not 0 < a.sample <= 1):
        p.error("--sample needs --dry-run and a fraction in (0, 1]")
    if not a.dry_run and not a.in_place and not a.output:
        p.error("an output folder is needed")
    return a


def report(a: argparse.Namespace, plan: Plan, acquisition: str, numbers: dict, seconds: float) -> dict:
    return {
        "input": a.input, "output": None if a.dry_run else a.input if a.in_place else a.output, "acquisition": acquisition, "dry_run": a.dry_run,
        "sample": None if a.sample is None else {"fraction": a.sample, "seed": a.sample_seed}, "config": asdict(plan), "stats": numbers, "elapsed_seconds": round(seconds, 3),
    }


def run(spark: SparkSession, a: argparse.Namespace, control: Control | None = None) -> dict:
    """The whole command. ``control`` reports progress and can cancel; a cancelled run leaves no output behind."""
    with control or Control(spark) as held:
        return _run(spark, a, held)


def _run(spark: SparkSession, a: argparse.Namespace, control: Control) -> dict:
    began = time.time()
    settings = model.load_settings(a.config) if a.config else {}
    flags = {k: getattr(a, k) for k in model.KIND}
    frames = tdf.read_frames(spark, a.input)
    kind = stats.acquisition(frames).first()["acquisition"]
    if a.preset:
        flags = {**model.preset_gates(a.preset, kind), **{k: v for k, v in flags.items() if v is not None}}
    calibration = Calibration(*a.calibration) if a.calibration else None
    ppm = flags.get("mz_ppm") or settings.get("mz_ppm")
    if ppm is not None and not calibration:
        raise ValueError("a tolerance in ppm needs --calibration")
    if ppm is not None:
        flags["mz_half_width"] = model.tof_half_width(ppm, calibration, flags.get("mz_ppm_ref") or settings.get("mz_ppm_ref"), tdf.read_acquired_mz(a.input))
    plan = model.resolve(flags, settings)
    if (plan.crop.mz_min, plan.crop.mz_max, plan.crop.im_min, plan.crop.im_max) != (None,) * 4 and not calibration:
        raise ValueError("m/z and mobility bounds need --calibration")
    segments = tdf.calibration_segments(a.input)
    if max(segments) > 1 and (plan.stages.dia_ms1 or plan.stages.ms1_polygon):
        warnings.warn(f"the run has {segments[0]} m/z and {segments[1]} mobility calibrations; gates use one for all frames and may be slightly off on others", stacklevel=2)
    sample = None if a.sample is None else (a.sample, a.sample_seed)
    points, control.total = tdf.read_points(spark, a.input), frames.count()
    kept = denoise(points, frames, plan, tdf.geometry(spark, a.input, calibration), sample=sample, levels=tdf.read_levels(spark, a.input))
    if a.dry_run:
        numbers = summary(points, kept, frames, plan, sample).first().asDict()
        control.frames.add(control.total)
    else:
        target = f"{a.input.rstrip('/')}.new" if a.in_place else a.output
        try:
            tdf.write_run(kept, frames, a.input, target, a.force or a.in_place, control.frames)
            # what was kept is read back, not computed again
            numbers = summary(points, tdf.read_points(spark, target), frames, plan).first().asDict()
            if a.in_place:
                tdf.replace_in_place(a.input.rstrip("/"), target)
        finally:
            if a.in_place:
                shutil.rmtree(target, ignore_errors=True)
    made = report(a, plan, kind, numbers, time.time() - began)
    if a.report:
        with open(a.report, "w") as f:
            json.dump(made, f, indent=1)
    return made


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("ionsift").config("spark.sql.requireAllClusterKeysForCoPartition", "false").getOrCreate()
    done = run(spark, parse(argv if argv is not None else __import__("sys").argv[1:]))
    s = done["stats"]
    print(f"kept {s['kept_points']} of {s['raw_points']} points ({s['kept_pct']} %) in {s['frames']} frames")


if __name__ == "__main__":
    main()
