"""DuckDB statements for the point-cloud queries."""

from __future__ import annotations

PTS = """pts AS (SELECT CAST(l_suppkey AS BIGINT) AS frame_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS point_id,
  CAST(l_orderkey % 128 AS INTEGER) AS scan, CAST(l_partkey % 128 AS BIGINT) AS tof, CAST(floor(l_extendedprice) AS BIGINT) AS intensity FROM lineitem)"""
COLS = "frame_id, scan, tof, intensity"
IDS = "frame_id, point_id, scan, tof, intensity"


def frames(msms: int = 9, empty: bool = False) -> str:
    peaks = "coalesce(n, 0)" if not empty else "CASE WHEN s_suppkey % 10 = 7 THEN 0 ELSE coalesce(n, 0) END"
    return f"""frames AS (SELECT CAST(s_suppkey AS BIGINT) AS frame_id, 128 AS num_scans, {peaks} AS num_peaks, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE {msms} END AS ms_ms_type, s_suppkey * 6.0 AS rt_seconds
  FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""


def streak(out: str, src: str, w: int, gap: int, length: int, floor: int = 0, feature: int = 0, by: str = "frame_id") -> str:
    """CTEs that keep the rows of ``src`` which one streak pass keeps, as ``out``."""
    k, on = f"{out}_", " AND ".join(f"p.{b} = r.{b}" for b in by.split(", "))
    return f"""
 {k}c AS (SELECT DISTINCT {by}, tof AS c FROM {src}),
 {k}x AS (SELECT {by}, scan, intensity, tof + d AS c FROM (SELECT *, unnest(range({-w}, {w + 1})) AS d FROM {src})),
 {k}v AS (SELECT {by}, c, scan, sum(intensity) AS v FROM {k}x SEMI JOIN {k}c USING ({by}, c) GROUP BY {by}, c, scan HAVING sum(intensity) > 0),
 {k}s AS (SELECT *, sum(v) OVER (PARTITION BY {by}, c ORDER BY scan) AS cs FROM {k}v),
 {k}o AS (SELECT *, CASE WHEN scan - lag(scan) OVER (PARTITION BY {by}, c ORDER BY scan) > {gap + 1} THEN 1 ELSE 0 END AS brk FROM {k}s WHERE v >= {floor}),
 {k}n AS (SELECT *, sum(brk) OVER (PARTITION BY {by}, c ORDER BY scan) AS run FROM {k}o),
 {k}r AS (SELECT {by}, c, run, min(scan) AS s0, max(scan) AS s1 FROM {k}n GROUP BY {by}, c, run HAVING count(*) >= {length} AND max(cs) - min(cs - v) >= {feature}),
 {out} AS (SELECT p.* FROM {src} p SEMI JOIN {k}r r ON {on} AND p.tof = r.c AND p.scan BETWEEN r.s0 AND r.s1)"""


def halo(out: str, src: str, f: float, s: int, m: int, by: str = "frame_id") -> str:
    return f"""
 {out}_e AS (SELECT *, scan + d AS vs FROM (SELECT *, unnest(range({-s}, {s + 1})) AS d FROM {src})),
 {out}_m AS (SELECT *, max(intensity) OVER (PARTITION BY {by}, vs ORDER BY tof RANGE BETWEEN {m} PRECEDING AND 1 PRECEDING) AS l, max(intensity) OVER (PARTITION BY {by}, vs ORDER BY tof RANGE BETWEEN 1 FOLLOWING AND {m} FOLLOWING) AS r FROM {out}_e),
 {out} AS (SELECT * EXCLUDE (d, vs, l, r) FROM {out}_m WHERE d = 0 AND CAST(intensity AS DOUBLE) >= CAST({f} AS DOUBLE) * CAST(greatest(coalesce(l, 0), coalesce(r, 0)) AS DOUBLE))"""


def smooth(out: str, src: str, s: int = 3, m: int = 2) -> str:
    return f"""
 {out}_e AS (SELECT *, scan + d AS vs FROM (SELECT *, unnest(range({-s}, {s + 1})) AS d FROM {src})),
 {out}_m AS (SELECT *, sum(intensity) OVER w AS s, count(*) OVER w AS n FROM {out}_e WINDOW w AS (PARTITION BY frame_id, vs ORDER BY tof RANGE BETWEEN {m} PRECEDING AND {m} FOLLOWING)),
 {out} AS (SELECT frame_id, point_id, scan, tof, CAST((s + n // 2) // n AS BIGINT) AS intensity FROM {out}_m WHERE d = 0)"""


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def merged(out: str, src: str, by: str) -> str:
    return f"""
 {out}_f AS (SELECT *, CASE WHEN scan_begin <= max(scan_end) OVER (PARTITION BY {by} ORDER BY scan_begin, scan_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {src} WHERE scan_end > scan_begin),
 {out}_k AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY scan_begin, scan_end ROWS UNBOUNDED PRECEDING) AS k FROM {out}_f),
 {out} AS (SELECT {by}, min(scan_begin) AS scan_begin, max(scan_end) AS scan_end FROM {out}_k GROUP BY {by}, k)"""


DIA = "windows(window_group, scan_begin, scan_end, mz, width) AS (VALUES (1, 0, 40, 400.0, 300.0), (1, 40, 80, 800.0, 300.0), (2, 10, 50, 400.0, 300.0), (2, 60, 100, 1200.0, 300.0), (3, 5, 30, 400.0, 300.0), (3, 20, 70, 800.0, 300.0), (3, 90, 90, 1200.0, 300.0))"
DIA_FRAMES = merged("groups", "windows", "window_group") + ",\n iv AS (SELECT frame_id, scan_begin, scan_end FROM frames JOIN groups ON window_group = frame_id % 4 WHERE ms_ms_type <> 0 AND frame_id % 16 <> 13)"
LISTED = """listed AS (SELECT CAST(l_suppkey AS BIGINT) AS frame_id, CAST(l_orderkey % 128 AS INTEGER) AS scan_begin, CAST(l_orderkey % 128 + l_linenumber - 1 AS INTEGER) AS scan_end,
  CAST(CASE WHEN l_partkey % 7 <> 0 THEN 300 + 25 * (l_partkey % 16) END AS DOUBLE) AS isolation_mz, CAST(25 AS DOUBLE) AS isolation_width FROM lineitem)"""
PASEF = "pasef AS (SELECT frame_id, CAST((16 * (frame_id // 8)) % 96 + frame_id % 3 AS INTEGER) AS scan_begin, CAST((16 * (frame_id // 8)) % 96 + frame_id % 3 + 25 AS INTEGER) AS scan_end, 1 + frame_id // 8 AS precursor FROM frames WHERE ms_ms_type <> 0)"
MS1 = "ms1 AS (SELECT pts.* FROM pts SEMI JOIN (FROM frames WHERE ms_ms_type = 0) f USING (frame_id))"
MS2 = "ms2 AS (SELECT pts.* FROM pts SEMI JOIN (FROM frames WHERE ms_ms_type <> 0) f USING (frame_id))"
B = "((sqrt(1700.0::DOUBLE) - 10) / 127)"
TOF, MZ, IM = f"((sqrt(%s) - 10) / {B})", f"pow(10 + {B} * %s, 2)", "(1.6::DOUBLE + (-1.0::DOUBLE / 127) * %s)"


def gated(pad: int, src: str = "ms2") -> str:
    return f"(SELECT * FROM {src} p WHERE NOT EXISTS (FROM iv WHERE iv.frame_id = p.frame_id) OR EXISTS (FROM iv WHERE iv.frame_id = p.frame_id AND p.scan >= iv.scan_begin - {pad} AND p.scan < iv.scan_end + {pad}))"


def cropped(src: str) -> str:
    tof = f"tof BETWEEN floor({TOF % '300.0::DOUBLE'}) AND ceil({TOF % '1200.0::DOUBLE'})"
    scan = "scan BETWEEN floor((1.4::DOUBLE - 1.6) / (-1.0::DOUBLE / 127)) AND least(ceil((0.8::DOUBLE - 1.6) / (-1.0::DOUBLE / 127)), 127)"
    return f"(SELECT * FROM {src} WHERE {tof} AND {scan} AND intensity BETWEEN 5000 AND 90000)"


def box_gate(mz_pad: float = 5.0, im_pad: float = 0.05) -> str:
    """``bg(s0, s1, t0, t1)``: boxes as index ranges."""
    lo, hi = TOF % f"greatest(mz - width / 2 - {mz_pad}::DOUBLE, 0)", TOF % f"greatest(mz + width / 2 + {mz_pad}::DOUBLE, 0)"
    top, low = f"{IM % 'scan_begin'} + {im_pad}::DOUBLE", f"{IM % 'scan_end'} - {im_pad}::DOUBLE"
    inv = "(%s - 1.6::DOUBLE) / (-1.0::DOUBLE / 127)"
    return f"bg AS (SELECT least(greatest(floor({inv % f'({top})'}), 0), 127) AS s0, least(greatest(ceil({inv % f'({low})'}), 0), 127) AS s1, greatest(floor({lo}), 0) AS t0, greatest(ceil({hi}), 0) AS t1 FROM (SELECT DISTINCT scan_begin, scan_end, CAST(mz AS DOUBLE) AS mz, CAST(width AS DOUBLE) AS width FROM windows WHERE scan_end > scan_begin))"


def polygon(mz_pad: float, im_pad: float) -> str:
    """``pg(scan, t0, t1)``: index spans inside the ring."""
    cuts = "0.0" if im_pad == 0 else f"{-im_pad}, 0.0, {im_pad}"
    return f"""
 edges(x0, y0, x1, y1) AS (VALUES (200.0::DOUBLE, 0.7::DOUBLE, 1500.0::DOUBLE, 1.0::DOUBLE), (1500.0, 1.0, 1500.0, 1.5), (1500.0, 1.5, 200.0, 1.1), (200.0, 1.1, 200.0, 0.7)),
 cut AS (SELECT scan, d, {IM % 'scan'} + d AS y FROM (SELECT unnest(range(128)) AS scan), (SELECT unnest([{cuts}]::DOUBLE[]) AS d)),
 hit AS (SELECT scan, d, x0 + (y - y0) / (y1 - y0) * (x1 - x0) AS x FROM cut, edges WHERE (y0 > y) <> (y1 > y)),
 num AS (SELECT *, row_number() OVER (PARTITION BY scan, d ORDER BY x) AS k FROM hit),
 pg AS (SELECT DISTINCT a.scan, floor({TOF % f'greatest(a.x - {mz_pad}::DOUBLE, 0)'}) AS t0, ceil({TOF % f'greatest(b.x + {mz_pad}::DOUBLE, 0)'}) AS t1 FROM num a JOIN num b ON a.scan = b.scan AND a.d = b.d AND a.k % 2 = 1 AND b.k = a.k + 1)"""


BOXED = "(SELECT * FROM %s p WHERE EXISTS (FROM bg WHERE p.scan BETWEEN s0 AND s1 AND p.tof BETWEEN t0 AND t1))"
INSIDE = "(SELECT * FROM %s p WHERE EXISTS (FROM pg WHERE p.scan = pg.scan AND p.tof BETWEEN t0 AND t1))"
OWNED = "owned AS (SELECT p.*, (SELECT first(precursor ORDER BY scan_begin) FROM pasef w WHERE w.frame_id = p.frame_id AND p.scan >= w.scan_begin AND p.scan < w.scan_end) AS precursor FROM ms2 p)"
SUMMED = "summed AS (SELECT precursor, scan, tof, least(sum(intensity), 4294967295) AS intensity FROM owned WHERE precursor IS NOT NULL AND precursor <> 0 GROUP BY precursor, scan, tof)"
MAPPED = "mapped AS (SELECT o.* EXCLUDE (precursor) FROM owned o WHERE precursor IS NULL OR EXISTS (FROM keys k WHERE k.precursor = o.precursor AND k.scan = o.scan AND k.tof = o.tof))"
PLACES = "plc AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) AS k FROM frames WHERE ms_ms_type = 0), near AS (SELECT a.frame_id AS centre, b.frame_id FROM plc a JOIN plc b ON abs(a.k - b.k) <= 1)"
CENTRED = "centred AS (SELECT centre, scan, tof, least(sum(intensity), 4294967295) AS intensity FROM pts JOIN near USING (frame_id) GROUP BY centre, scan, tof)"


def per_window(out: str, w: int, gap: int, length: int) -> str:
    placed = "placed AS (SELECT p.*, coalesce(iv.scan_begin, -1) AS win FROM ms2 p LEFT JOIN iv ON iv.frame_id = p.frame_id AND p.scan >= iv.scan_begin AND p.scan < iv.scan_end WHERE iv.scan_begin IS NOT NULL OR NOT EXISTS (FROM iv j WHERE j.frame_id = p.frame_id))"
    return placed + "," + streak(out, "placed", w, gap, length, by="frame_id, win")


RANKED = "ranked AS (SELECT frame_id, scan, tof, intensity, row_number() OVER (PARTITION BY frame_id ORDER BY intensity DESC, scan, tof, point_id) AS k FROM pts)"


def centroids(least: int) -> str:
    """The cells of ``grouped(frame_id, g, scan, tof, intensity)``: rounded weighted means of groups, colliding ones summed."""
    return f"""sums AS (SELECT frame_id, sum(intensity) AS total, sum(scan::HUGEINT * intensity) AS ws, sum(tof::HUGEINT * intensity) AS wt FROM grouped GROUP BY frame_id, g HAVING sum(intensity) >= {least}),
 means AS (SELECT frame_id, CAST((2 * ws + total) // (2 * total) AS INTEGER) AS scan, CAST((2 * wt + total) // (2 * total) AS BIGINT) AS tof, total FROM sums)
SELECT frame_id, scan, tof, CAST(least(sum(total), 4294967295) AS BIGINT) AS intensity FROM means GROUP BY frame_id, scan, tof"""


def box_centroid(scan: int, tof: int) -> str:
    """Rounds: a free point with no brighter free one within twice its box takes the free points of its box."""
    near = "b.frame_id = a.frame_id AND abs(b.scan - a.scan) <= {} AND abs(b.tof - a.tof) <= {}"
    return f"""WITH RECURSIVE {PTS},
 {RANKED},
 r AS (SELECT *, NULL::BIGINT AS g FROM ranked UNION ALL (
   WITH free AS (FROM r WHERE g IS NULL), seeds AS (SELECT * FROM free a WHERE NOT EXISTS (FROM free b WHERE {near.format(2 * scan, 2 * tof)} AND b.k < a.k))
   SELECT a.* REPLACE (b.k AS g) FROM free a LEFT JOIN seeds b ON {near.format(scan, tof)})),
 grouped AS (FROM r WHERE g IS NOT NULL),
 {centroids(1)}"""


def watershed(scan: int, tof: int, offset: int) -> str:
    """Rounds: a point whose brighter neighbours are all decided joins the nearest group that it may join, or seeds one."""
    near = f"b.frame_id = a.frame_id AND abs(b.scan - a.scan) <= {scan} AND abs(b.tof - a.tof) <= {tof} AND b.k < a.k"
    return f"""WITH RECURSIVE {PTS},
 {RANKED},
 r AS (SELECT *, 0 AS step, false AS done, NULL::BIGINT AS g, NULL::BIGINT AS gi, NULL::BIGINT AS gt FROM ranked UNION ALL (
   WITH seen AS (SELECT a.frame_id, a.k, bool_or(NOT b.done) AS waits,
        min({{d: abs(b.scan - a.scan) + abs(b.tof - a.tof), i: -b.gi, s: b.scan // {scan}, t: b.tof // {tof}, k: b.k, g: b.g, gi: b.gi, gt: b.gt}}) FILTER (b.g IS NOT NULL AND abs(a.tof - b.gt) <= {offset}) AS best
      FROM r a JOIN r b ON {near} WHERE NOT a.done GROUP BY a.frame_id, a.k),
   now AS (SELECT a.*, best, NOT a.done AND NOT coalesce(waits, false) AS ready FROM r a LEFT JOIN seen USING (frame_id, k))
   SELECT frame_id, scan, tof, intensity, k, step + 1, done OR ready, CASE WHEN ready THEN coalesce(best.g, k) ELSE g END, CASE WHEN ready THEN coalesce(best.gi, intensity) ELSE gi END, CASE WHEN ready THEN coalesce(best.gt, tof) ELSE gt END
   FROM now WHERE EXISTS (FROM r WHERE NOT done))),
 grouped AS (SELECT frame_id, g, scan, tof, intensity FROM r WHERE step = (SELECT max(step) FROM r)),
 {centroids(0)}"""
