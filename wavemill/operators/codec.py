"""Lossless coding of chunks: a payload is a section of value maps, a config byte and frames. A chunk is coded by one task from its own samples alone."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import Reader, Writer, rice_decode, rice_encode, rice_plan, unzigzag, zigzag
from . import predict, stages

# Fixed values of the format: subframe types, stereo modes, frame lengths, limits.
CONSTANT, VERBATIM, FIXED, LPC, PALETTE, PALETTE_RLE, CROSS = range(7)
LEFT_RIGHT, MID_SIDE, LEFT_SIDE, SIDE_RIGHT = range(4)
SHORTEST, HISTORY, MOST_PALETTE, LARGEST, MOST_FRAMES = 256, 32, 16, 1 << 48, 1 << 22
MOST_RUNS, WIDEST_RUN = 1 << 20, 31


@dataclass(frozen=True)
class Level:
    """What the encoder tries; a decoder reads whatever it wrote."""

    orders: tuple[int, ...] = ()
    lengths: tuple[int, ...] = (4096,)
    long_term: bool = False
    cross: bool = False
    widths: tuple[int, ...] = (predict.WIDTH,)
    stage2: tuple[tuple[int, int], ...] = ()
    carried: tuple[int, ...] = ()


LEVELS = {
    "fast": Level(orders=(8,)),
    "normal": Level(predict.ORDERS, (4096,), True, True),
    "max": Level(predict.ORDERS, (16384, 8192, 4096, 2048, 1024), True, True, predict.WIDTHS),
    "insane": Level(predict.ORDERS, (16384, 8192, 4096, 2048, 1024), True, True, predict.WIDTHS, ((16, 4), (32, 5), (256, 7)), (1,)),
}
DEFAULT = "normal"


@dataclass
class Coded:
    """A subframe: its fields, its predictor's residual over the frame (0 where it has none), and the residuals that a carried filter sees."""

    out: Writer
    residual: np.ndarray
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    slot: stages.Carried | None = None


def _raw(out: Writer, values, width: int) -> None:
    out.put(np.asarray(values, np.int64) & ((1 << width) - 1), width)


def _put_residual(w: Writer, r: np.ndarray, level: Level, slot: stages.Carried | None) -> stages.Carried | None:
    """The adaptive stages' header and the Rice codes of residual r, the cheapest way that the level tries; the slot's filter after it."""
    plain = rice_plan(r)
    tried = [(plain[0], "", None, r, plain, None)]
    if len(r) and np.abs(r).max() <= stages.LARGEST:
        s = stages.shift_for(r)
        for taps, k in level.stage2:
            e = stages.adapt(r, taps, k, s, False)
            plan = rice_plan(e)
            tried.append((plan[0] + 12, "stage2", (taps, k, s), e, plan, None))
        if slot is not None:
            used = slot.copy()
            e = used.run(r, s, False)
            plan = rice_plan(e)
            tried.append((plan[0] + 6, "carried", s, e, plan, used))
    bits, kind, how, e, plan, used = min(tried, key=lambda t: t[0])
    lag = None
    if level.long_term and len(e) > 256:
        rough = np.abs(e).sum()
        found = sorted(((np.abs(c := stages.long_encode(e, *x)).sum(), x, c) for x in stages.long_search(e)), key=lambda t: t[0])
        if found and found[0][0] < 0.97 * rough:
            other = rice_plan(found[0][2])
            if other[0] + 13 + 7 * len(found[0][1][1]) + 0.05 * len(e) < plan[0]:
                lag, e, plan = found[0][1], found[0][2], other
    if slot is not None:
        w.put(kind == "carried", 1)
    if kind == "carried":
        w.put(how + 16, 6)
    elif kind == "stage2":
        w.put([1, stages.TAPS.index(how[0]), how[1], how[2] + 16], [1, 2, 4, 6])
    else:
        w.put(0, 1)
    w.put(lag is not None, 1)
    if lag is not None:
        w.put([lag[0], stages.LONG_TAPS.index(len(lag[1]))], [11, 2])
        _raw(w, lag[1], 7)
    w.extend(rice_encode(e, plan))
    if slot is not None and used is None:
        used = slot.copy()
        used.skip(r)
    return used


def _coefficients(w: Writer, q: np.ndarray) -> None:
    for group in (q[:2], q[2:]):
        if len(group):
            z = zigzag(group)
            k = min(range(15), key=lambda k: int(((z >> k) + 1 + k).sum()))
            w.put(k, 4)
            w.put((1 << k) | (z & ((1 << k) - 1)), (z >> k) + 1 + k)


def _palette(x: np.ndarray, width: int, begin) -> list[Writer]:
    """Both forms of a palette of up to 16 values: an index a sample, and runs of them."""
    values = np.unique(x)
    if not 2 <= len(values) <= MOST_PALETTE:
        return []
    at, bits = np.searchsorted(values, x), (len(values) - 1).bit_length()
    out = []
    for kind in (PALETTE, PALETTE_RLE):
        w = begin(kind)
        w.put(len(values) - 2, 4)
        _raw(w, values, width)
        out.append(w)
    out[0].put(at, bits)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    runs = np.diff(np.append(first, len(at)))
    run_bits = max(1, int(runs.max() - 1).bit_length())
    out[1].put([run_bits, len(runs) - 1], [5, 20])
    out[1].put(np.stack([at[first], runs - 1], axis=1).ravel(), np.tile([bits, run_bits], len(runs)))
    return out


def _subframe(x: np.ndarray, bits: int, history: np.ndarray, level: Level, refs: list[tuple[int, np.ndarray, np.ndarray]], slot: stages.Carried | None) -> Coded:
    """The cheapest subframe of x; history is that channel's last samples of the chunk, refs (number, samples, residual) of the frame's earlier subframes."""
    low = int(np.bitwise_or.reduce(x))
    wasted = min((low & -low).bit_length() - 1, bits - 1, 30) if low else 0
    x, past, width, none = x >> wasted, history >> wasted, bits - wasted, np.zeros(len(x), np.int64)

    def begin(kind: int) -> Writer:
        w = Writer()
        w.put([wasted, kind], [5, 3])
        return w

    if x.min() == x.max():
        w = begin(CONSTANT)
        _raw(w, x[:1], width)
        return Coded(w, none, slot=slot)
    plain = begin(VERBATIM)
    _raw(plain, x, width)
    tried = [plain, *_palette(x, width, begin)]
    own = []  # (bits, header fields after the type, inner type, order, residual)

    def prepare(kind: int, order: int, head: Writer, of) -> None:
        known = len(past) >= order
        if not known and order > len(x):
            return
        y = np.concatenate([past[len(past) - order :], x]) if known and order else x
        r = of(y)
        if not known:
            _raw(head, x[:order], width)
        own.append((head.bits + rice_plan(r)[0], head, kind, order, r))

    costs = [float(np.abs(np.diff(x, o)).sum()) / max(1, len(x) - o) if len(x) > o else np.inf for o in range(5)]
    order = min(range(5), key=lambda o: (costs[o], o))
    head = Writer()
    head.put(order, 3)
    prepare(FIXED, order, head, lambda y: np.diff(y, order))
    for _, m, a in predict.shortlist(x, orders=level.orders) if level.orders else ():
        for precision in level.widths:
            if (fit := predict.quantise(a, precision)) is None:
                continue
            q, shift = fit
            head = Writer()
            head.put([m - 1, shift, precision - 1], [5, 5, 4])
            _coefficients(head, q)
            prepare(LPC, m, head, lambda y, q=q, shift=shift: predict.residual(y, q, shift))
    bits_, head, kind, order, r = min(own, key=lambda c: c[0])
    first = len(x) - len(r)
    crossed = None
    if level.cross and refs and len(x) >= 64:
        for number, _, src in refs:
            if not src.any() or np.abs(src).max() > 1 << 30 or (fit := stages.cross_fit(r, src, first)) is None:
                continue
            term = stages.cross_term(src, -2, *fit)
            net = r - term[first:]
            cost = bits_ - rice_plan(r)[0] + rice_plan(net)[0] + 28 + 12 * len(fit[0]) + 3
            if cost < 0.99 * bits_ and (crossed is None or cost < crossed[0]):
                crossed = (cost, number, fit, net)
    w = begin(CROSS if crossed else kind)
    if crossed:
        w.put(kind, 3)
    w.extend(head)
    coded_r = r
    if crossed:
        _, number, (coeffs, shift), coded_r = crossed
        w.put([number, 1, -2 + 32, len(coeffs) - 1, 12 - 1, shift], [8, 1, 6, 4, 4, 5])
        _raw(w, coeffs, 12)
    after = _put_residual(w, coded_r, level, slot)
    full = none.copy()
    full[first:] = r
    best = min([*tried, w], key=lambda t: t.bits)
    return Coded(w, full, coded_r, after) if best is w else Coded(best, none, slot=slot)


def _views(mode: int, c: list[np.ndarray]) -> list[np.ndarray]:
    """The two coded representations of a stereo pair."""
    left, right = c
    return {LEFT_RIGHT: [left, right], MID_SIDE: [(left + right) >> 1, left - right], LEFT_SIDE: [left, left - right], SIDE_RIGHT: [left - right, right]}[mode]


def _widths(mode: int, bits: int) -> list[int]:
    return [bits + (mode == SIDE_RIGHT), bits + (mode in (MID_SIDE, LEFT_SIDE))]


def _cover(channels: list[np.ndarray], lengths: tuple[int, ...]) -> list[int]:
    """Frame lengths of a chunk: of each longest frame, the halves (down to the shortest) where their expected bits are fewer."""
    n, whole = len(channels[0]), lengths[0]

    def cost(a: int, b: int) -> float:
        return sum(80 + min(predict.bits_of(float((np.diff(c[a:b], o).astype(np.float64) ** 2).sum()), b - a) for o in (1, 2, 3)) for c in channels)

    def split(a: int, b: int, depth: int) -> tuple[float, list[int]]:
        own = cost(a, b) if b - a > 4 else 1e9
        if depth + 1 == len(lengths) or b - a < lengths[depth]:
            return own, [b - a]
        half = a + lengths[depth + 1]
        x, y = split(a, half, depth + 1), split(half, b, depth + 1)
        return (x[0] + y[0], x[1] + y[1]) if x[0] + y[0] < own else (own, [b - a])

    return [m for a in range(0, n, whole) for m in (split(a, min(n, a + whole), 0)[1] if len(lengths) > 1 else [min(whole, n - a)])]


def _frames(channels: list[np.ndarray], bits: int, level: Level, config: int) -> bytes:
    out, at = [bytes([config])], 0
    slots = [stages.Carried(*stages.CARRIED[config]) if config else None for _ in channels]
    for size in _cover(channels, level.lengths):
        part = [c[at : at + size] for c in channels]
        past = [c[max(0, at - HISTORY) : at] for c in channels]
        w = Writer()
        code = (size // SHORTEST).bit_length() - 1
        if size >= SHORTEST and SHORTEST << code == size and code <= 6:
            w.put(code, 3)
        else:
            w.put([7, size - 1], [3, 20])
        if len(channels) == 2:
            rough = [sum(int(np.abs(np.diff(v)).sum()) for v in _views(m, part)) for m in range(4)]
            mode = min(range(4), key=lambda m: (rough[m], m))
            w.put(mode, 2)
            views = list(zip(_views(mode, part), _widths(mode, bits), _views(mode, past), strict=True))
        else:
            views = list(zip(part, [bits] * len(part), past, strict=True))
        refs = []
        for c, (x, width, before) in enumerate(views):
            got = _subframe(x, width, before, level, refs, slots[c])
            slots[c] = got.slot
            refs.append((c, x, got.residual))
            w.extend(got.out)
        out.append(w.to_bytes())
        at += size
    return b"".join(out)


def encode_chunk(channels: list[np.ndarray], bits: int, level: str = DEFAULT) -> bytes:
    """Payload of a chunk of equally long channels; of the level's carried filters, and none, the one that makes it smallest."""
    effort = LEVELS[level]
    maps = [stages.detect(c, bits) if level != "fast" else None for c in channels]
    coded = [c if m is None else m.inverse(c, bits) for c, m in zip(channels, maps, strict=True)]
    bodies = [_frames(coded, bits, effort, config) for config in (0, *effort.carried)]
    return stages.write_maps(maps) + min(bodies, key=len)


def _read_coefficients(r: Reader, order: int, precision: int) -> list[int]:
    q: list[int] = []
    for count in (min(2, order), order - min(2, order)):
        k = r.get(4) if count else 0
        q += [(r.unary(1 << 17) << k) + r.get(k) for _ in range(count)]
    q = unzigzag(np.array(q, np.int64)).tolist()
    if any(not -(1 << precision - 1) <= v < 1 << precision - 1 for v in q):
        raise ValueError("coefficient too large")
    return q


def _read_residual(r: Reader, n: int, slot: stages.Carried | None) -> np.ndarray:
    """Rice codes, then the adaptive stages undone in reverse order."""
    carried = slot is not None and r.get(1)
    s2, s = None, 0
    if carried:
        s = r.get(6) - 16
    elif r.get(1):
        s2 = (stages.TAPS[r.get(2)], r.get(4))
        s = r.get(6) - 16
        if not s2[1]:
            raise ValueError("invalid step of the adaptive stage")
    if s > 31:
        raise ValueError("invalid shift of an adaptive stage")
    lag = None
    if r.get(1):
        lag, taps = r.get(11), stages.LONG_TAPS[r.get(2)]
        if lag < stages.LAGS[0]:
            raise ValueError("invalid lag")
        lag = (lag, [r.signed(7) for _ in range(taps)])
    e = rice_decode(r, n)
    if lag:
        e = stages.long_decode(e, *lag)
    if carried:
        return slot.run(e, s, True)
    if s2:
        e = stages.adapt(e, *s2, s, True)
    if slot is not None:
        slot.skip(e)
    return e


def _read_subframe(r: Reader, n: int, bits: int, history: np.ndarray, refs: list[tuple[np.ndarray, np.ndarray]], slot: stages.Carried | None) -> tuple[np.ndarray, np.ndarray]:
    """Samples of a subframe, and its predictor's residual over the frame."""
    wasted, kind = r.get(5), r.get(3)
    if wasted >= bits:
        raise ValueError("too many wasted bits")
    width, past, none = bits - wasted, history >> wasted, np.zeros(n, np.int64)
    if kind == CONSTANT:
        return np.full(n, r.signed(width), np.int64) << wasted, none
    if kind == VERBATIM:
        return r.signed_fields(n, width) << wasted, none
    if kind in (PALETTE, PALETTE_RLE):
        count = r.get(4) + 2
        if count > MOST_PALETTE:
            raise ValueError("palette too large")
        table, index_bits = r.signed_fields(count, width), (count - 1).bit_length()
        if kind == PALETTE:
            at = r.fields(n, index_bits)
        else:
            run_bits, runs = r.get(5), r.get(20) + 1
            if not run_bits or runs > n:
                raise ValueError("invalid runs")
            pairs = r.fields(runs, index_bits + run_bits)
            at, length = pairs >> run_bits, (pairs & ((1 << run_bits) - 1)) + 1
            if length.sum() != n:
                raise ValueError("runs don't fill the frame")
            at = np.repeat(at, length)
        if at.max() >= count:
            raise ValueError("index beyond the palette")
        return table[at] << wasted, none
    inner = r.get(3) if kind == CROSS else kind
    if inner not in (FIXED, LPC):
        raise ValueError("invalid subframe type")
    q, shift = [], 0
    if inner == FIXED:
        order = r.get(3)
        if order > 4:
            raise ValueError("invalid order")
    else:
        order, shift, precision = r.get(5) + 1, r.get(5), r.get(4) + 1
        if precision < 3:
            raise ValueError("invalid coefficient width")
        q = _read_coefficients(r, order, precision)
    known = order > 0 and len(past) >= order
    if not known and order > n:
        raise ValueError("frame shorter than its order")
    warm = past[len(past) - order :] if known else r.signed_fields(order, width)
    first, term = 0 if known else order, None
    if kind == CROSS:
        number, source, lag0, taps, precision, xshift = (r.get(b) for b in (8, 1, 6, 4, 4, 5))
        if number >= len(refs) or precision + 1 < 3:
            raise ValueError("invalid reference")
        term = stages.cross_term(refs[number][source], lag0 - 32, r.signed_fields(taps + 1, precision + 1).tolist(), xshift)
    x = _read_residual(r, n - first, slot)
    if term is not None:
        x = x + term[first:]
    residual = none.copy()
    residual[first:] = x
    if inner == FIXED:
        for j in reversed(range(order)):
            x = np.cumsum(x) + np.diff(warm, j)[-1]
    else:
        line, back = warm.tolist(), q[::-1]
        for i, e in enumerate(x.tolist()):
            v = e + (sum(map(mul, back, line[i : i + order])) >> shift)
            if not -LARGEST <= v <= LARGEST:
                raise ValueError("prediction runs away")
            line.append(v)
        x = np.array(line[order:], np.int64)
    if len(x) and (x.max() > LARGEST or x.min() < -LARGEST):
        raise ValueError("prediction runs away")
    return (x if first == 0 else np.concatenate([warm, x])) << wasted, residual


def decode_chunk(payload: bytes, frames: int, channels: int, bits: int) -> np.ndarray:
    """Samples (channels, frames) of a payload; ValueError for one that is damaged or of the least-squares kind, which isn't read."""
    maps, at = stages.read_maps(payload, channels, frames)
    config = payload[at] if at < len(payload) else 255
    if config == 3:
        raise ValueError("least-squares chunks aren't supported")
    if config > 3:
        raise ValueError("unknown chunk config")
    r, out, at = Reader(payload[at + 1 :]), np.zeros((channels, frames), np.int64), 0
    slots = [stages.Carried(*stages.CARRIED[config]) if config else None for _ in range(max(2, channels))]
    while at < frames:
        code = r.get(3)
        n = SHORTEST << code if code < 7 else r.get(20) + 1
        if at + n > frames:
            raise ValueError("frames beyond the chunk's")
        past = [c[max(0, at - HISTORY) : at] for c in out]
        mode = r.get(2) if channels == 2 else None
        views = list(zip(_widths(mode, bits), _views(mode, past), strict=True)) if channels == 2 else [(bits, p) for p in past]
        refs: list[tuple[np.ndarray, np.ndarray]] = []
        for c, (width, before) in enumerate(views):
            refs.append(_read_subframe(r, n, width, before, refs, slots[c]))
        got = [x for x, _ in refs]
        if mode is not None:
            a, b = got
            if mode == MID_SIDE:
                a = (2 * a + (b & 1) + b) >> 1
                a, b = a, a - b
            elif mode == LEFT_SIDE:
                b = a - b
            elif mode == SIDE_RIGHT:
                a = a + b
            got = [a, b]
        for c, x in enumerate(got):
            out[c, at : at + n] = x
        r.align()
        at += n
    if r.at != len(r.text):
        raise ValueError("bytes after the last frame")
    for c, m in enumerate(maps):
        if m is not None:
            out[c] = m.apply(out[c], bits)
    if frames and (out.min() < -(1 << bits - 1) or out.max() >= 1 << bits - 1):
        raise ValueError("sample out of range")
    return out


def blocks(samples: DataFrame, chunk_frames: int) -> DataFrame:
    """(stream_id, chunk, channel, t0, xs): a row a chunk and channel, of samples (stream_id, channel, t, x). Only this gathers rows; coding then works on arrays."""
    rows = samples.select("stream_id", F.floor(F.col("t") / chunk_frames).cast("long").alias("chunk"), "channel", F.struct("t", "x").alias("_s"))
    rows = rows.groupBy("stream_id", "chunk", "channel").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    return rows.select("stream_id", "chunk", "channel", F.col("_s")[0]["t"].alias("t0"), F.col("_s")[F.size("_s") - 1]["t"].alias("t1"), F.col("_s.x").alias("xs"))


def encode(samples: DataFrame, bits: int = 16, chunk_frames: int = 45056, level: str = DEFAULT) -> DataFrame:
    """(stream_id, chunk, start_frame, frames, channels, crc, payload) of samples (stream_id, channel, t, x), t dense from 0 and channels from 0. Gaps, repeated or null samples and values beyond `bits` raise."""
    rows = blocks(samples, chunk_frames).groupBy("stream_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("channel", "t0", "t1", "xs"))).alias("c"))
    return encode_blocks(rows, bits, chunk_frames, level)


def encode_blocks(rows: DataFrame, bits: int, chunk_frames: int, level: str = DEFAULT) -> DataFrame:
    """encode's result for rows (stream_id, chunk, c array<struct<channel, t0, t1, xs>>), one a chunk; the samples cross to Python as whole arrays."""
    kind = rows.schema["stream_id"].dataType.simpleString()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            c = b.column(2)
            for i in range(b.num_rows):
                part = c[i].values
                channels, first, last = (part.field(n).to_pylist() for n in ("channel", "t0", "t1"))
                xs = part.field("xs")
                flat = [xs[j].values for j in range(len(xs))]
                chunk = b.column(1)[i].as_py()
                n = len(flat[0])
                if channels != list(range(len(flat))) or any(len(f) != n or f.null_count for f in flat) or any(f != chunk * chunk_frames or f + n - 1 != t for f, t in zip(first, last, strict=True)):
                    raise ValueError(f"chunk {chunk}: samples aren't dense")
                x = [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in flat]
                if min(int(v.min()) for v in x) < -(1 << bits - 1) or max(int(v.max()) for v in x) >= 1 << bits - 1:
                    raise ValueError(f"samples don't fit {bits} bits")
                payload = encode_chunk(x, bits, level)
                out.append((chunk, chunk * chunk_frames, n, len(x), zlib.crc32(payload), payload))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], names=["stream_id", "chunk", "start_frame", "frames", "channels", "crc", "payload"])

    return rows.select("stream_id", "chunk", "c").mapInArrow(task, f"stream_id {kind}, chunk bigint, start_frame bigint, frames bigint, channels int, crc bigint, payload binary")


def decode_blocks(chunks: DataFrame, bits: int = 16) -> DataFrame:
    """(stream_id, start_frame, channel, xs): a row a chunk and channel of encode's rows. A payload that fails its CRC raises."""
    kind = chunks.schema["stream_id"].dataType.simpleString()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (chunk, start, frames, channels, crc, payload) in enumerate(zip(*(b.column(j).to_pylist() for j in range(1, 7)), strict=True)):
                if zlib.crc32(payload) != crc:
                    raise ValueError(f"chunk {chunk}: damaged payload")
                x = decode_chunk(payload, frames, channels, bits)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * channels)), pa.array([start] * channels, pa.int64()), pa.array(range(channels), pa.int32()), pa.array(list(x), pa.list_(pa.int64()))], names=["stream_id", "start_frame", "channel", "xs"])

    rows = chunks.select("stream_id", "chunk", "start_frame", F.col("frames").cast("long"), "channels", "crc", "payload")
    return rows.mapInArrow(task, f"stream_id {kind}, start_frame bigint, channel int, xs array<bigint>")


def decode(chunks: DataFrame, bits: int = 16) -> DataFrame:
    """(stream_id, channel, t, x) of encode's rows."""
    rows = decode_blocks(chunks, bits).select("stream_id", "start_frame", "channel", F.posexplode("xs").alias("_i", "x"))
    return rows.select("stream_id", "channel", (F.col("start_frame") + F.col("_i")).alias("t"), "x")
