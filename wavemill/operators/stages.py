"""Stages between a subframe's predictor and its Rice codes, each with its inverse: adaptive filters, long-term prediction, cross-channel terms; and value maps of whole chunks."""

from __future__ import annotations

import struct

import numpy as np

from ..functions.bits import Reader, Writer, unzigzag, zigzag

# Fixed values of the format.
TAPS, CARRIED = (16, 32, 128, 256), {1: (512, 8), 2: (1024, 9)}
UNIT, LARGEST, LONG_LARGEST = 14, 1 << 40, 1 << 20
LAGS, LONG_TAPS, LONG_SHIFT = (32, 2047), (1, 3, 5, 9), 5
FINE, WIDEST_K, LARGEST_FIX = 32, 1 << 25, 1 << 26


def _scaled(r: int, s: int) -> int:
    """The 16-bit input of a filter for residual r at shift s."""
    r = max(-LARGEST, min(LARGEST, r))
    return max(-32768, min(32767, r >> s if s >= 0 else r << -s))


def _prediction(dot: int, s: int) -> int:
    dot = ((dot + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)
    return (dot << s) >> UNIT if s >= 0 else dot >> UNIT - s


def shift_for(r: np.ndarray) -> int:
    """The shift that brings the mean magnitude of r to about 9 bits."""
    mean = int(np.minimum(np.abs(r), LARGEST).sum()) // len(r)
    return max(-16, min(31, mean.bit_length() - 9))


def adapt(values: np.ndarray, taps: int, k: int, s: int, inverse: bool) -> np.ndarray:
    """Sign-driven filter over one subframe: its output for residuals, or with inverse the residuals for its output."""
    w, line, out = np.zeros(taps, np.int64), np.zeros(taps + len(values), np.int64), np.empty(len(values), np.int64)
    for t, v in enumerate(values.tolist()):
        x = line[t : t + taps]
        p = _prediction(int(w @ x), s)
        e, r = (v, v + p) if inverse else (v - p, v)
        if abs(r) > LARGEST:
            raise ValueError("residual out of range")
        if e:
            w = np.clip(w + (x >> k if e > 0 else -(x >> k)), -32768, 32767)
        line[taps + t] = _scaled(r, s)
        out[t] = r if inverse else e
    return out


class Carried:
    """A long sign-driven filter of one channel slot; its weights, last residuals and running average live through a chunk."""

    def __init__(self, taps: int, k: int):
        self.taps, self.k, self.avg = taps, k, 0
        self.w, self.past = np.zeros(taps, np.int64), [0] * taps

    def _push(self, x: int) -> int:
        m = abs(x)
        step = 0 if not m else 4 if 48 * m > 4 * self.avg else 2 if 48 * m > self.avg else 1
        self.avg += m - self.avg // 16
        return (-step if x < 0 else step) * 256 >> self.k

    def run(self, values: np.ndarray, s: int, inverse: bool) -> np.ndarray:
        n, taps = len(values), self.taps
        line, step, out = np.zeros(taps + n, np.int64), np.zeros(taps + n, np.int64), np.empty(n, np.int64)
        for i, r in enumerate(self.past):
            line[i] = _scaled(r, s)
            step[i] = self._push(int(line[i]))
        w, past = self.w, list(self.past)
        for t, v in enumerate(values.tolist()):
            p = _prediction(int(w @ line[t : t + taps]), s)
            e, r = (v, v + p) if inverse else (v - p, v)
            if abs(r) > LARGEST:
                raise ValueError("residual out of range")
            if e:
                d = step[t : t + taps]
                w = np.clip(w + (d if e > 0 else -d), -32767, 32767)
            line[taps + t] = x = _scaled(r, s)
            step[taps + t] = self._push(x)
            past.append(r)
            out[t] = r if inverse else e
        self.w, self.past = w, past[-taps:]
        return out

    def skip(self, r: np.ndarray) -> None:
        """Learns from the residuals of a subframe that doesn't use the filter."""
        if len(r) and np.abs(r).max() <= LARGEST:
            self.run(r, shift_for(r), False)

    def copy(self) -> Carried:
        new = Carried(self.taps, self.k)
        new.w, new.past, new.avg = self.w.copy(), list(self.past), self.avg
        return new


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """Sums of x[t] * x[t - lag] for lags 0 to `lags`, by Fourier transform."""
    size = 1 << (len(x) + lags).bit_length()
    f = np.fft.rfft(x.astype(np.float64), size)
    return np.fft.irfft(f * np.conj(f), size)[: lags + 1]


def long_search(e: np.ndarray, most: int = 6) -> list[tuple[int, list[int]]]:
    """Up to `most` long-term predictors (lag, taps in units of 1/32) that the autocorrelation suggests, best lag first, with one and three taps each."""
    top = min(LAGS[1], len(e) - 2)
    if top < LAGS[0] or not e.any() or np.abs(e).max() > LONG_LARGEST:
        return []
    r = autocorrelation(e, top + 1)
    lags = np.arange(LAGS[0], top + 1)
    gain = np.where(r[lags] > 0, r[lags] ** 2 / r[0], 0)
    out = []
    for lag in lags[np.argsort(-gain, kind="stable")[:most]].tolist():
        if gain[lag - LAGS[0]] <= 0:
            break
        for taps in (1, 3):
            h = taps // 2
            a = np.array([[r[abs(i - j)] for j in range(taps)] for i in range(taps)]) + np.eye(taps) * r[0] * 1e-6
            g = np.linalg.solve(a, [r[lag + h - j] for j in range(taps)])
            out.append((lag, np.clip(np.rint(g * (1 << LONG_SHIFT)), -64, 63).astype(np.int64).tolist()))
    return [(lag, g) for lag, g in out if any(g)]


def long_encode(e: np.ndarray, lag: int, g: list[int]) -> np.ndarray:
    h = len(g) // 2
    out, first = e.copy(), lag + h
    if first < len(e):
        total = sum(c * e[j : len(e) - first + j] for j, c in enumerate(g))
        out[first:] -= total + 16 >> LONG_SHIFT
    return out


def long_decode(c: np.ndarray, lag: int, g: list[int]) -> np.ndarray:
    """A run of lag - h values reads only values before it, so runs are computed at once."""
    h = len(g) // 2
    e, first, run = c.copy(), lag + h, lag - h
    if np.abs(e[:first]).max(initial=0) > LONG_LARGEST:
        raise ValueError("value out of range")
    for a in range(first, len(c), run):
        b = min(len(c), a + run)
        e[a:b] += sum(v * e[a - first + j : b - first + j] for j, v in enumerate(g)) + 16 >> LONG_SHIFT
        if np.abs(e[a:b]).max() > LONG_LARGEST:
            raise ValueError("value out of range")
    return e


def cross_term(src: np.ndarray, lag0: int, coeffs: list[int], shift: int) -> np.ndarray:
    """What a reference signal predicts of another subframe of the frame; lags past its ends read its first or last value."""
    if len(src) and np.abs(src).max() > LARGEST:
        raise ValueError("reference out of range")
    at, n = np.arange(len(src)), len(src)
    return sum(c * src[np.clip(at + lag0 + k, 0, n - 1)] for k, c in enumerate(coeffs)) >> shift


def cross_fit(residual: np.ndarray, src: np.ndarray, first: int, lag0: int = -2, taps: int = 5, width: int = 12) -> tuple[list[int], int] | None:
    """Quantised taps and their shift that fit a residual (from place `first` on) to a reference by least squares; None if there are none."""
    at, n = np.arange(first, len(src)), len(src)
    a = np.stack([src[np.clip(at + lag0 + k, 0, n - 1)] for k in range(taps)], axis=1).astype(np.float64)
    m = a.T @ a
    m += np.eye(taps) * (np.trace(m) * 1e-9 + 1e-9)
    x = np.linalg.solve(m, a.T @ residual.astype(np.float64))
    peak = float(np.abs(x).max())
    if not np.isfinite(peak) or peak < 1e-6:
        return None
    shift = min(31, width - 2 - int(np.floor(np.log2(peak))))
    limit = (1 << width - 1) - 1
    return (np.clip(np.rint(x * 2.0**shift), -limit, limit).astype(int).tolist(), shift) if shift >= 0 else None


class ValueMap:
    """x = clamp(floor((k * p + c) / 2**32) + fix, range of the depth): samples on a lattice that shifts can't reach. fixes: {position: correction}."""

    def __init__(self, p: int, c: int, fixes: dict[int, int] | None = None):
        if p <= 1 << FINE or not 0 <= c < p:
            raise ValueError("not a value map")
        self.p, self.c, self.fixes = p, c, fixes or {}

    def apply(self, k: np.ndarray, bits: int) -> np.ndarray:
        k = np.clip(k, -WIDEST_K, WIDEST_K)
        (q, f), (cq, cf) = divmod(self.p, 1 << FINE), divmod(self.c, 1 << FINE)
        x = q * k + cq + (k * f + cf >> FINE)
        for at, fix in self.fixes.items():
            x[at] += fix
        return np.clip(x, -(1 << bits - 1), (1 << bits - 1) - 1)

    def inverse(self, x: np.ndarray, bits: int) -> np.ndarray:
        """The least k whose value is x or more; one less where only a clamped value can be x."""
        values, at = np.unique(x, return_inverse=True)
        k = np.array([-((self.c - (v << FINE)) // self.p) for v in values.tolist()], dtype=np.int64)
        plain = ValueMap(self.p, self.c)
        return np.where(plain.apply(k, bits) == values, k, k - 1)[at]


def plausible(x: np.ndarray, most: float = 0.5) -> bool:
    """Whether the values leave enough gaps for a map: the densest window of 64 neighbouring values holds at most a share `most` of them."""
    values = np.unique(x)
    if len(values) < 3:
        return False
    reach = np.searchsorted(values, values + 64, "left") - np.arange(len(values))
    return int(reach.max()) <= most * 64 + 1


def detect(x: np.ndarray, bits: int) -> ValueMap | None:
    """The coarsest integer step and offset that hold all but the clipped samples of a channel; None if it is 1, or a power of two without an offset, which wasted bits cover."""
    low, high = -(1 << bits - 1), (1 << bits - 1) - 1
    if bits > 24 or not len(x) or not plausible(x):
        return None
    inner = x[(x > low) & (x < high)]
    if len(inner) < 2:
        return None
    step = int(np.gcd.reduce(np.diff(np.unique(inner)))) if len(np.unique(inner)) > 1 else 0
    offset = int(inner[0]) % step if step else 0
    if step < 2 or offset == 0 and step & step - 1 == 0:
        return None
    out = ValueMap(step << FINE, offset << FINE)
    return out if (out.apply(out.inverse(x, bits), bits) == x).all() else None


def write_maps(maps: list[ValueMap | None]) -> bytes:
    if not any(maps):
        return b"\0"
    out = [b"\1"]
    for m in maps:
        if m is None:
            out.append(b"\0")
            continue
        out.append(struct.pack("<BQQ", 2 if m.fixes else 1, m.p, m.c))
        if m.fixes:
            at = np.array(sorted(m.fixes), dtype=np.int64)
            gaps, values = np.diff(at, prepend=-1) - 1, zigzag(np.array([m.fixes[i] for i in at.tolist()], dtype=np.int64)) - 1
            kg, kv = (min(range(25), key=lambda k: int(((v >> k) + 1 + k).sum())) for v in (gaps, values))
            w = Writer()
            w.put([kg, kv], 5)
            for g, v in zip(gaps.tolist(), values.tolist(), strict=True):
                for z, k in ((g, kg), (v, kv)):
                    w.put((1 << k) | (z & ((1 << k) - 1)), (z >> k) + 1 + k)
            raw = w.to_bytes()
            out.append(struct.pack("<II", len(at), len(raw)) + raw)
    return b"".join(out)


def read_maps(raw: bytes, channels: int, frames: int) -> tuple[list[ValueMap | None], int]:
    """The maps at the start of a chunk's payload, and where they end; ValueError for what the format doesn't allow."""

    def take(shape: str, at: int) -> tuple:
        if at + struct.calcsize(shape) > len(raw):
            raise ValueError("value maps end early")
        return struct.unpack_from(shape, raw, at)

    tag, at, out = take("<B", 0)[0], 1, []
    if tag > 1:
        raise ValueError("unknown value-map tag")
    if not tag:
        return [None] * channels, 1
    for _ in range(channels):
        flag, at = take("<B", at)[0], at + 1
        if flag > 2:
            raise ValueError("unknown value-map flag")
        if not flag:
            out.append(None)
            continue
        (p, c), at, fixes = take("<QQ", at), at + 16, {}
        if flag == 2:
            (count, size), at = take("<II", at), at + 8
            if not 1 <= count <= frames or at + size > len(raw):
                raise ValueError("value-map corrections out of range")
            r, place = Reader(raw[at : at + size]), -1
            kg, kv = r.get(5), r.get(5)
            if max(kg, kv) > 24:
                raise ValueError("invalid parameter of corrections")
            for _ in range(count):
                place += 1 + (r.unary((frames >> kg) + 1) << kg) + r.get(kg)
                fix = int(unzigzag(np.array([(r.unary((1 << 27 >> kv) + 1) << kv) + r.get(kv) + 1]))[0])
                if place >= frames or abs(fix) > LARGEST_FIX:
                    raise ValueError("value-map correction out of range")
                fixes[place] = fix
            r.align()
            if r.at != len(r.text):
                raise ValueError("bytes after the corrections")
            at += size
        out.append(ValueMap(p, c, fixes))
    if not any(out):
        raise ValueError("no channel is mapped")
    return out, at
