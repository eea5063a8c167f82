"""Bit fields, most significant bit first, and partitioned Rice codes."""

from __future__ import annotations

from functools import cached_property

import numpy as np

# Fixed values of the format.
SIZES = (32, 64, 128, 256, 512, 1024)
ESCAPE, LAST_INDEX, WIDEST, LONGEST = 63, 61, 56, 1 << 32


def zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 63)


def unzigzag(z: np.ndarray) -> np.ndarray:
    return (z >> 1) ^ -(z & 1)


class Writer:
    """Gathers (value, width) fields and packs them all at once; a width may pass 64, as leading zeros."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []

    def put(self, value, width) -> None:
        value = np.atleast_1d(np.asarray(value, np.int64))
        self.values.append(value)
        self.widths.append(np.broadcast_to(np.asarray(width, np.int64), value.shape))

    def extend(self, other: Writer) -> None:
        self.values += other.values
        self.widths += other.widths

    @property
    def bits(self) -> int:
        return int(sum(w.sum() for w in self.widths))

    def to_bytes(self) -> bytes:
        if not self.values:
            return b""
        v, w = np.concatenate(self.values), np.concatenate(self.widths)
        ends = np.cumsum(w)
        below = np.repeat(ends, w) - 1 - np.arange(ends[-1])
        bit = np.where(below < 64, np.repeat(v, w) >> np.minimum(below, 63), 0) & 1
        return np.packbits(bit.astype(np.uint8)).tobytes()


class Reader:
    """Raises ValueError past the end."""

    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.int64)
        self.text = (self.bits + 48).astype(np.uint8).tobytes().decode("ascii")
        self.at = 0

    @cached_property
    def ones(self) -> list[int]:
        """Place of the first one at or after each bit; the end where there is none."""
        n = len(self.bits)
        at = np.where(self.bits == 1, np.arange(n), n)
        return np.minimum.accumulate(at[::-1])[::-1].tolist()

    def get(self, width: int) -> int:
        a, self.at = self.at, self.at + width
        if self.at > len(self.text):
            raise ValueError("bits end early")
        return int(self.text[a : self.at], 2) if width else 0

    def fields(self, count: int, width: int) -> np.ndarray:
        """`count` fields of one width, at most 62."""
        a, self.at = self.at, self.at + count * width
        if self.at > len(self.text):
            raise ValueError("bits end early")
        return self.bits[a : self.at].reshape(count, width) @ (1 << np.arange(width, dtype=np.int64)[::-1])

    def signed_fields(self, count: int, width: int) -> np.ndarray:
        v = self.fields(count, width)
        return np.where(v >> max(0, width - 1) & 1, v - (1 << width), v) if width else v

    def signed(self, width: int) -> int:
        v = self.get(width)
        return v - (1 << width) if width and v >> width - 1 else v

    def unary(self, most: int = LONGEST) -> int:
        one = self.text.find("1", self.at)
        if one < 0 or one - self.at > most:
            raise ValueError("unary code too long")
        n, self.at = one - self.at, one + 1
        return n

    def align(self) -> None:
        end = -(-self.at // 8) * 8
        if "1" in self.text[self.at : end]:
            raise ValueError("padding isn't zero")
        self.at = end


def _lengths(z: np.ndarray, index: int) -> np.ndarray:
    k = index >> 1
    if not index & 1:
        return (z >> k) + 1 + k
    low = 2 << k
    return np.where(z < low, k + 2, ((z - low) >> k) + 2 + k)


def _put_codes(out: Writer, z: np.ndarray, index: int) -> None:
    k = index >> 1
    low = 2 << k if index & 1 else 0
    rest = z - low
    # a one of the unary part and the low bits are one field; its zeros widen it
    value, width = (1 << k) | (rest & ((1 << k) - 1)), (rest >> k) + 1 + k
    if index & 1:
        value, width = np.where(z < low, low | z, value), np.where(z < low, k + 2, width + 1)
    out.put(value, width)


def _put_index(out: Writer, index: int, before: int | None) -> None:
    step = None if before is None or index == ESCAPE else index - before
    if before is None:
        out.put(index, 6)
    elif step == 0:
        out.put(0, 1)
    elif step is not None and abs(step) <= 2:
        out.put((2 if abs(step) == 1 else 6) << 1 | (step < 0), abs(step) + 2)
    else:
        out.put(7 << 6 | index, 9)


def _index_bits(index: int, before: int | None) -> int:
    if before is None:
        return 6
    return 9 if index == ESCAPE or abs(index - before) > 2 else (1, 3, 4)[abs(index - before)]


def rice_plan(residual: np.ndarray) -> tuple[int, int, list[tuple[int, int]]]:
    """(bits, number of the partition size, (index, escape width) of each partition) of the cheapest code.

    Lengths under every index near the mean's are summed over blocks of 32 once; larger partitions add them up.
    """
    z = zigzag(np.asarray(residual, np.int64))
    blocks = -(-len(z) // SIZES[0])
    at = np.arange(0, len(z), SIZES[0])
    middle = 2 * max(0, (int(z.sum()) // max(1, len(z))).bit_length() - 1)
    spread = 2 * max(0, (int(z.max(initial=0))).bit_length())
    low = max(0, min(middle, LAST_INDEX) - 14)
    tried = list(range(low, max(low, min(LAST_INDEX, middle + 10, spread + 1)) + 1))
    cost = np.stack([np.add.reduceat(np.minimum(_lengths(z, i), 1 << 40), at) for i in tried], axis=1) if blocks else np.zeros((0, len(tried)), np.int64)
    peak, size = np.maximum.reduceat(z, at) if blocks else z, np.full(blocks, SIZES[0], np.int64)
    if blocks:
        size[-1] = len(z) - SIZES[0] * (blocks - 1)
    best = None
    for number in range(len(SIZES)):
        if number:
            if len(cost) == 1:
                break
            odd = len(cost) & 1
            cost, peak, size = (np.concatenate([v, np.zeros((1, *v.shape[1:]), v.dtype)]) if odd else v for v in (cost, peak, size))
            cost, peak, size = cost[::2] + cost[1::2], np.maximum(peak[::2], peak[1::2]), size[::2] + size[1::2]
        pick = cost.argmin(axis=1) if blocks else cost
        bits, before, parts = 3, None, []
        for row, i, top, n in zip(cost, pick.tolist() if blocks else [], peak.tolist(), size.tolist(), strict=True):
            index, width, own = tried[i], top.bit_length(), int(row[i])
            if before is not None and before != index and tried[0] <= before <= tried[-1]:
                same = int(row[before - tried[0]])
                if same + 1 <= own + _index_bits(index, before):
                    index, own = before, same
            raw = 6 + width * n
            if width <= WIDEST and raw + _index_bits(ESCAPE, before) < own + _index_bits(index, before):
                index, own = ESCAPE, raw
            bits += own + _index_bits(index, before)
            parts.append((index, width))
            before = before if index == ESCAPE else index
        if best is None or bits < best[0]:
            best = (bits, number, parts)
    return best


def rice_encode(residual: np.ndarray, plan: tuple | None = None) -> Writer:
    z = zigzag(np.asarray(residual, np.int64))
    _, number, parts = plan or rice_plan(residual)
    out, before = Writer(), None
    out.put(number, 3)
    for at, (index, width) in enumerate(parts):
        part = z[at * SIZES[number] : (at + 1) * SIZES[number]]
        _put_index(out, index, before)
        if index == ESCAPE:
            out.put(width, 6)
            out.put(part, width)
        else:
            _put_codes(out, part, index)
            before = index
    return out


def rice_decode(r: Reader, n: int) -> np.ndarray:
    """Only the places of the codes are found one by one; their quotients and low bits come out a partition at a time."""
    number = r.get(3)
    if number >= len(SIZES):
        raise ValueError("invalid partition size")
    z, done, before, one, end = [np.zeros(0, np.int64)], 0, None, r.ones, len(r.text)
    while done < n:
        count = min(SIZES[number], n - done)
        done += count
        if before is None:
            index = r.get(6)
        elif not r.get(1):
            index = before
        elif not r.get(1):
            index = before - 1 if r.get(1) else before + 1
        elif not r.get(1):
            index = before - 2 if r.get(1) else before + 2
        else:
            index = r.get(6)
        if index == ESCAPE:
            width = r.get(6)
            if width > WIDEST:
                raise ValueError("escape too wide")
            z.append(r.fields(count, width))
            continue
        if not 0 <= index <= LAST_INDEX:
            raise ValueError("invalid parameter")
        before, k, odd = index, index >> 1, index & 1
        starts, firsts, at = [], [], r.at
        for _ in range(count):
            if at >= end:
                raise ValueError("bits end early")
            first = one[at]
            starts.append(at)
            firsts.append(first)
            at = first + 1 + k + (odd and first == at)
        if at > end or firsts[-1] >= end:
            raise ValueError("bits end early")
        r.at = at
        first = np.array(firsts, np.int64)
        q = first - np.array(starts, np.int64)
        if q.max() > LONGEST:
            raise ValueError("unary code too long")
        low = np.zeros(count, np.int64)
        for j in range(k):
            low = low << 1 | r.bits[first + 1 + j]
        if odd:
            more = r.bits[np.minimum(first + 1 + k, end - 1)]
            z.append(np.where(q == 0, low << 1 | more, (q + 1 << k) + low))
        else:
            z.append((q << k) + low)
    return unzigzag(np.concatenate(z))
