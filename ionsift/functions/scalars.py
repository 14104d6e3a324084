"""Column forms of the calibration, and the frame sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionsift.model import Calibration


def tof_to_mz(tof: Column, c: Calibration) -> Column:
    return F.pow(F.lit(c.a) + F.lit(c.b) * tof, F.lit(2.0))


def mz_to_tof(mz: Column, c: Calibration) -> Column:
    return (F.sqrt(mz) - F.lit(c.a)) / F.lit(c.b)


def scan_to_im(scan: Column, c: Calibration) -> Column:
    return F.lit(c.c) + F.lit(c.d) * scan


def im_to_scan(im: Column, c: Calibration) -> Column:
    return (im - F.lit(c.c)) / F.lit(c.d)


_GAMMA, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2**64 on bigints, by 16-bit limbs so that nothing overflows."""
    return _let(x, lambda v: _product(v, k))


def _product(x: Column, k: int) -> Column:
    a = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    b = [(k >> 16 * i) & 0xFFFF for i in range(4)]
    parts, carry = [], F.lit(0)
    for i in range(4):
        s = carry
        for j in range(i + 1):
            s = s + a[j] * F.lit(b[i - j])
        parts.append(s.bitwiseAND(F.lit(0xFFFF)))
        carry = F.shiftright(s, 16)
    out = parts[0]
    for i in range(1, 4):
        out = out.bitwiseOR(F.shiftleft(parts[i], 16 * i))
    return out


def splitmix64(x: Column) -> Column:
    """The SplitMix64 finaliser on a bigint taken as unsigned."""
    x = _times(_let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30))), _M1)
    x = _times(_let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27))), _M2)
    return _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


#: Ids of a stretch, which one task numbers; ids are 32-bit, so there are as many stretches at most.
STRETCH = 1 << 16


def numbered(frames: DataFrame, name: str) -> DataFrame:
    """Adds each frame's position by ``frame_id``, from 0, in two passes.

    Ids are cut into stretches; the frames of each are counted, the counts summed up to each stretch, and frames numbered
    within theirs. No task sees more than 65,536 rows, whatever the run's size.
    """
    cut = frames.withColumn("__part", F.expr(f"frame_id div {STRETCH}"))
    counts = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(F.expr(f"__part div {STRETCH}")).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("frame_id"))
    return cut.withColumn("__row", inside).join(before, "__part").withColumn(name, F.col("__before") + F.col("__row") - 1).drop("__part", "__before", "__row")


def frame_sample(frames: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Frames whose hashed position (0-based, by frame_id) falls under the fraction."""
    limit = min(max(int(fraction * 2**64), 0), 2**64 - 1)
    out = frames.columns
    frames, place = numbered(frames, "__place"), F.col("__place")
    z = splitmix64(_times(place + F.lit(seed), _GAMMA))
    # unsigned comparison: flip the sign bit on both sides
    flip = F.lit(-(2**63))
    return frames.withColumn("__z", z).where(F.col("__z").bitwiseXOR(flip) <= F.lit(limit - 2**63)).select(*out)
