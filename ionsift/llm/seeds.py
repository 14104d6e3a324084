"""Winnowed anchors and the windows around them: what exact-repeat operators share.

A window of ``size`` units (bytes or words) picks the smallest hash among its ``gram``-unit grams, leftmost on
ties; so two equal windows pick the same anchor at the same place. A *segment* is a run of neighbouring windows with
one anchor. Equal windows of two documents therefore stand in segments with equal anchor hashes, and equal segments
settle all their windows at once. Only segments that differ under one anchor need a closer look ("contested").
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionsift.llm.common import materialize

U = np.uint64
BASE1, BASE2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: A window's place stands in the low bits beside its gram hash.
PLACE = U((1 << 32) - 1)
CHUNK = 1 << 20
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 512
#: Bytes that end a word: ``\x20\x09-\x0D``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order. Not a polynomial, so no family of strings collides as Thue-Morse words do modulo 2**64."""
    return mix(mix(x ^ U(BASE1)) + y)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, eight bytes at a time; long ones by a cryptographic hash."""
    size = end - begin
    out = mix(size.astype(U) * U(BASE2) + U(1))
    view = _eights(data)
    live = np.flatnonzero(size <= LONG_WORD)
    step = 0
    while len(live := live[size[live] > step]):
        left = size[live] - step
        eight = view[begin[live] + step]
        part = left < 8
        eight[part] &= (U(1) << (left[part] * 8).astype(U)) - U(1)
        out[live] = fold(out[live], eight)
        step += 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_grams(units: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k neighbouring units, by overlapping halves."""
    h, have = units, 1
    while have < k and len(h):
        step = min(have, k - have)
        h = fold(h[:-step], h[step:])
        have += step
    return h


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k neighbouring bytes."""
    n = max(0, len(data) - k + 1)
    view = _eights(data)
    if k < 8:
        return mix((view[:n] & U((1 << 8 * k) - 1)) + U(BASE2))
    h = mix(view[:n] + U(BASE2))
    for i in [*range(8, k - 8, 8), k - 8] if k > 8 else []:
        h = fold(h, view[i : i + n])
    return h


#: The modulus of the prefix polynomial hashes.
PRIME = U((1 << 61) - 1)
HALF = U((1 << 31) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1; a may be up to twice that."""
    a1, a0, b1, b0 = a >> U(31), a & HALF, b >> U(31), b & HALF
    mid = a1 * b0 + a0 * b1
    x = ((a1 * b1) << U(1)) + (mid >> U(30)) + ((mid & U((1 << 30) - 1)) << U(31)) + a0 * b0
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**61 - 1 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        made = []
        for b in (base, pow(base, -1, int(PRIME))):
            x = np.ones(1, U)
            while len(x) < n:
                x = np.concatenate([x, times(x, np.full(len(x), pow(b, len(x), int(PRIME)), U))])
            made.append(x)
        have = _powers[base] = (made[0], made[1])
    return have


class Prefix:
    """Prefix polynomial hashes of bytes modulo 2**61 - 1: the hash of any stretch in constant time."""

    def __init__(self, data: np.ndarray, base: int = BASE1 % int(PRIME)):
        self.power, self.inverse = _power_table(base, len(data) + 1)
        terms = times(data.astype(U) + U(1), self.power[: len(data)])
        # high and low halves are summed apart, so no sum leaves 64 bits
        high, low = np.cumsum(terms >> U(31), dtype=U), np.cumsum(terms & HALF, dtype=U)
        x = times(high % PRIME, np.full(len(high), 1 << 31, U)) + low % PRIME
        self.sums = np.concatenate([np.zeros(1, U), np.where(x >= PRIME, x - PRIME, x)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = self.sums[end], self.sums[begin]
        return times(a + (PRIME - b), self.inverse[begin])

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Whether the n bytes from a and from b have one hash: the earlier stretch is moved to the later one's powers."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        left = times(self.sums[low + n] + (PRIME - self.sums[low]), self.power[high - low])
        right = self.sums[high + n] + (PRIME - self.sums[high])
        return left == np.where(right >= PRIME, right - PRIME, right)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document bounds of a column of strings; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_binary()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column.buffers()[2]) else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of all words, and each document's bounds in words."""
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = bounds[1:] - 1
    edges = edges[edges >= 0]
    last[edges] = inside[edges]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, bounds)


def word_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and document bounds in words."""
    begin, end, docs = word_bounds(data, bounds)
    return span_hashes(data, begin, end), docs


def byte_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, bounds


UNITS = {"word": word_units, "byte": byte_units}
GRAMS: dict[str, Callable] = {"word": word_grams, "byte": byte_grams}


def chunks(bounds: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Neighbouring documents with about ``limit`` bytes together."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, j
        i = j


def anchors(unit: str, units: np.ndarray, gram: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for each window the place of its anchor."""
    grams = GRAMS[unit](units, gram)
    return grams, (sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=U), size - gram + 1) & PLACE).astype(np.int64)


def window_hash(grams: np.ndarray, gram: int, size: int, at: np.ndarray) -> np.ndarray:
    """The hash of the windows that start at ``at``, from the grams that cover them."""
    h = grams[at]
    for i in [*range(gram, size - gram, gram), size - gram]:
        h = fold(h, grams[at + i])
    return h


def segments(unit: str, units: np.ndarray, docs: np.ndarray, gram: int, size: int) -> tuple[np.ndarray, ...]:
    """(document index, first window, number of windows, anchor hash, segment hash) of all segments; windows count within all units.

    A segment has at most ``size - gram + 1`` windows, so its first and its last one cover it.
    """
    none = np.zeros(0, np.int64)
    if len(units) < size:
        return none, none, none, none.astype(U), none.astype(U)
    grams, at = anchors(unit, units, gram, size)
    n = len(at)
    valid = np.ones(n + 1, bool)
    valid[n] = False
    for b, e in zip(docs[:-1].tolist(), docs[1:].tolist()):
        valid[max(b, e - size + 1) : e] = False
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(at[1:], at[:-1], out=change[1:n])
    first = np.flatnonzero(valid[:n] & (change[:n] | ~np.r_[False, valid[: n - 1]]))
    last = np.flatnonzero(valid[:n] & (change[1:] | ~valid[1:]))
    both = window_hash(grams, gram, size, np.concatenate([first, last]))
    whole = mix(fold(both[: len(first)], both[len(first) :]) + (last - first).astype(U))
    return np.searchsorted(docs, first, "right") - 1, first, last - first + 1, grams[at[first]], whole


def sorted_groups(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns begins a new group."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


#: ``at`` packs first window (from bit 32), number of windows (from bit 1) and whether the row is settled (bit 0).
SEED = "key long, seg long, doc long, at long"
FOUND = "doc long, start int, n int, contested boolean"


def seed_rows(unit: str, gram: int, size: int):
    """mapInArrow: documents -> segments. Copies within a batch are settled here, so a key sends few rows of a batch on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = []
            for i, j in chunks(bounds):
                units, docs = UNITS[unit](data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                d, first, n, key, whole = segments(unit, units, docs, gram, size)
                parts.append((ids[d + i], first - docs[d], n, key, whole))
            if not parts or not sum(len(p[0]) for p in parts):
                continue
            doc, first, n, key, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key ^ (whole * U(BASE2)), kind="stable")
            k, w, d = key[order], whole[order], doc[order]
            new = sorted_groups(k, w)
            begin = np.flatnonzero(new)
            low = np.minimum.reduceat(d, begin)[np.cumsum(new) - 1]
            settled = np.empty(len(doc), bool)
            settled[order] = d > low
            # neighbouring settled segments of a document become one row, dealt out by its place
            joins = np.zeros(len(doc), bool)
            joins[1:] = settled[1:] & settled[:-1] & (doc[1:] == doc[:-1]) & (first[1:] == first[:-1] + n[:-1])
            begin = np.flatnonzero(~joins)
            total = np.add.reduceat(n, begin)
            doc, first, key, whole, settled = (x[begin] for x in (doc, first, key, whole, settled))
            key = np.where(settled, mix(doc.astype(U) * U(BASE1) + first.astype(U)), key)
            whole = np.where(settled, U(0), whole)
            at = (first << 32) | (total << 1) | settled
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc), pa.array(at)], names=["key", "seg", "doc", "at"])

    return run


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by key, seg, doc: settles copies of a segment, and finds the contested firsts.

    What it carries from batch to batch is the last key's state and the first segment's rows of its first document.
    """
    last_key = last_seg = low = None
    several, held = False, []

    def out(doc, start, n, contested):
        return pa.record_batch([pa.array(doc), pa.array(start), pa.array(n), pa.array(contested)], names=["doc", "start", "n", "contested"])

    for batch in batches:
        key, seg, doc, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "seg", "doc", "at"))
        done, start, n = (at & 1).astype(bool), (at >> 32).astype(np.int32), ((at >> 1) & 0x7FFFFFFF).astype(np.int32)
        if done.any():
            yield out(doc[done], start[done], n[done], np.zeros(int(done.sum()), bool))
            key, seg, doc, start, n = (x[~done] for x in (key, seg, doc, start, n))
        if not len(key):
            continue
        new_key = sorted_groups(key)
        new_seg = sorted_groups(key, seg)
        same_key = last_key is not None and key[0] == last_key
        same_seg = same_key and seg[0] == last_seg
        seg_of, key_of = np.cumsum(new_seg) - 1, np.cumsum(new_key) - 1
        lows = doc[new_seg]
        if same_seg:
            lows[0] = low
        firsts = doc == lows[seg_of]
        segs_in = np.bincount(key_of[new_seg])
        if same_key:
            segs_in[0] += several + (0 if same_seg else 1)
        many = segs_in > 1
        if held and (not same_key or many[0]):
            if same_key:
                yield out(*(np.concatenate(x) for x in zip(*held, strict=True)), np.ones(sum(len(h[0]) for h in held), bool))
            held = []
        contested = firsts & many[key_of]
        keep = ~firsts | contested
        if keep.any():
            yield out(doc[keep], start[keep], n[keep], contested[keep])
        if not many[-1]:
            tail = firsts & (key_of == key_of[-1])
            held.append(tuple(x[tail] for x in (doc, start, n)))
        last_key, last_seg, low, several = key[-1], seg[-1], lows[-1], bool(many[-1])


def seek(docs: DataFrame, unit: str, gram: int, size: int) -> DataFrame:
    """``FOUND`` rows: settled stretches of windows, and contested segments. One shuffle, written as a table."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(seed_rows(unit, gram, size), SEED)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key").sortWithinPartitions("key", "seg", "doc")
    return materialize(dealt.mapInArrow(shared_rows, FOUND), "repeats")


def with_stretches(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents beside the array ``at`` of their rows' (start, n); bounded by a document's own length."""
    grouped = rows.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("at"))
    return docs.join(grouped, F.col("doc_id") == F.col("doc"), how)


def lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Bounds and values of a column of lists; null counts as empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), column.flatten()


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged bounds of stretches, clipped to n."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    b, e = start[order], np.maximum.accumulate(np.minimum(stop[order], n))
    new = np.ones(len(b), bool)
    new[1:] = b[1:] > e[:-1]
    at = np.flatnonzero(new)
    return b[at], np.r_[e[at[1:] - 1], e[-1]]


def _contested_rows(unit: str, gram: int, size: int):
    """mapInArrow: documents beside their contested segments -> the bytes of the segments' windows, dealt out more finely.

    A window reaches at least half of ``size - gram`` units beyond its anchor on one side. So each segment gives up
    to two rows, keyed by the anchor with that many units before it or after it, with the windows that hold them.
    """
    half = (size - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            cut, rows = lists(batch.column("at"))
            start, n = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
            for i, j in chunks(bounds):
                s, k = start[cut[i] : cut[j]], n[cut[i] : cut[j]]
                if not len(s):
                    continue
                part, edges = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                units, docs = UNITS[unit](part, edges)
                own = np.repeat(np.arange(j - i), np.diff(cut[i : j + 1]))
                first = s + docs[own]
                grams, place = anchors(unit, units, gram, size)
                anchor = place[first]
                raw = part.tobytes()
                begin_of, end_of = word_bounds(part, edges)[:2] if unit == "word" else (np.arange(len(part)), np.arange(1, len(part) + 1))
                # windows that start at anchor - half or before reach that far back; the others reach far ahead
                back = np.clip(anchor - half - first + 1, 0, k)
                for side, b, count in ((0, first, back), (1, first + back, k - back)):
                    has = np.flatnonzero(count > 0)
                    if not len(has):
                        continue
                    at = anchor[has] - half if side == 0 else anchor[has]
                    key = mix(window_hash(grams, gram, gram + half, at) + U(side)).view(np.int64)
                    begin, stop = b[has], b[has] + count[has] + size - 1
                    values = [raw[x:y] for x, y in zip(begin_of[begin].tolist(), end_of[stop - 1].tolist())]
                    if unit == "word":
                        values = [b" ".join(v.split()) for v in values]
                    yield pa.record_batch(
                        [pa.array(key), pa.array(ids[own[has] + i]), pa.array((begin - docs[own[has]]).astype(np.int32)), pa.array(values, pa.binary())],
                        names=["key", "doc", "start", "bytes"],
                    )

    return run


def merged(doc: np.ndarray, own: np.ndarray, at: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """``doc, start, n, window`` of runs of neighbouring windows ``at``, counted from ``start`` of their row ``own``."""
    joins = np.zeros(len(at), bool)
    joins[1:] = (own[1:] == own[:-1]) & (at[1:] == at[:-1] + 1)
    begin = np.flatnonzero(~joins)
    n = np.diff(np.r_[begin, len(at)]).astype(np.int32)
    row = own[begin]
    return pa.record_batch([pa.array(doc[row]), pa.array((start[row] + at[begin]).astype(np.int32)), pa.array(n), pa.nulls(len(begin), pa.binary())], names=["doc", "start", "n", "window"])


def _settled_rows(settle: Callable, windows: Callable, most: int):
    """mapInArrow over stretches sorted by key: whole keys go to ``settle`` about ``most`` rows at a time.

    A key with over twice as many rows isn't held in memory: its ``windows`` themselves go on (n = 0), to be grouped by Spark.
    """

    def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column("key").to_numpy()
        new = sorted_groups(key)
        many = np.flatnonzero(~(new & np.r_[new[1:], True]))  # a key of one row shares nothing
        if len(many):
            table = table.take(pa.array(many)).combine_chunks()
            made = settle(table.column("doc").to_numpy(), table.column("start").to_numpy(), table.column("bytes").combine_chunks())
            if made.num_rows:
                yield made

    def apart(batch: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
        for part in batch.to_batches(4096) if isinstance(batch, pa.Table) else [batch]:
            doc, start = (part.column(c).to_numpy() for c in ("doc", "start"))
            own, at, values = windows(part.column("bytes"))
            yield pa.record_batch([pa.array(doc[own]), pa.array((start[own] + at).astype(np.int32)), pa.array(np.zeros(len(own), np.int32)), pa.array(values, pa.binary())], names=["doc", "start", "n", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, spilling = 0, None
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                key = batch.column("key").to_numpy()
                if spilling is not None:
                    other = np.flatnonzero(key != spilling)
                    more = int(other[0]) if len(other) else len(key)
                    if more:
                        yield from apart(batch.slice(0, more))
                        batch, key = batch.slice(more), key[more:]
                    if not len(key):
                        continue
                    spilling = None
                held.append(batch)
                rows += len(key)
                if rows < most:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").to_numpy()
                last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if last:
                    yield from close(table.slice(0, last))
                    table = table.slice(last)
                if table.num_rows >= 2 * most:
                    yield from apart(table)
                    spilling, table = key[-1], table.slice(table.num_rows)
                held, rows = table.to_batches(), table.num_rows
        if rows:
            yield from close(pa.Table.from_batches(held))

    return run


def contested(docs: DataFrame, found: DataFrame, unit: str, gram: int, size: int, most: int, settle: Callable, windows: Callable) -> DataFrame:
    """``doc, start, n``: the contested segments' windows that also start in a smaller document.

    ``settle(doc, start, bytes)`` decides about whole keys in memory; what is too much for that Spark groups by the
    windows' own bytes.
    """
    near = with_stretches(docs.select("doc_id", "text"), found.where("contested"), "inner").select("doc_id", "text", "at")
    stretches = near.mapInArrow(_contested_rows(unit, gram, size), "key long, doc long, start int, bytes binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stretches.repartition(n, "key").sortWithinPartitions("key")
    done = materialize(dealt.mapInArrow(_settled_rows(settle, windows, most), "doc long, start int, n int, window binary"), "settled")
    rest = done.where("n = 0")
    low = rest.groupBy("window").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    apart = rest.join(low, "window").where("doc > low").select("doc", "start", F.lit(1).alias("n"))
    return done.where("n > 0").select("doc", "start", "n").unionAll(apart)
