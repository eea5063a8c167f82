"""Reed-Solomon parity over chunk payloads: any e lost chunks come back from any e shards. One task holds one group of chunks."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.integer import FIELD

# Fixed values of the format.
MOST_SHARDS, MOST_CHUNKS = 1024, 60000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of 2, twice over so that sums of logarithms need no reduction, and logarithms."""
    power, log, v = np.zeros(2 * 65535, np.int64), np.zeros(65536, np.int64), 1
    for i in range(65535):
        power[i] = power[i + 65535] = v
        log[v] = i
        v = v << 1 ^ (FIELD if v & 0x8000 else 0)
    return power, log


def times(c: int, symbols: np.ndarray) -> np.ndarray:
    power, log = _tables()
    return np.where((symbols == 0) | (c == 0), 0, power[log[symbols] + log[c]])


def inverse(c: int) -> int:
    power, log = _tables()
    return int(power[65535 - log[c]])


def weight(shard: int, chunk: int) -> int:
    return inverse(shard ^ (MOST_SHARDS + chunk))


def symbols(payload: bytes, size: int) -> np.ndarray:
    return np.frombuffer(payload.ljust(size, b"\0"), "<u2").astype(np.int64)


def shards(payloads: list[bytes], m: int) -> list[bytes]:
    """m shards, each as long as the longest payload, rounded up to an even length."""
    size = -(-max(map(len, payloads)) // 2) * 2
    out = [np.zeros(size // 2, np.int64) for _ in range(m)]
    for i, p in enumerate(payloads):
        s = symbols(p, size)
        for j in range(m):
            out[j] ^= times(weight(j, i), s)
    return [o.astype("<u2").tobytes() for o in out]


def recover(payloads: list[bytes | None], lengths: list[int], good: dict[int, bytes]) -> list[bytes]:
    """All payloads, with the None ones rebuilt from the shards that are good; ValueError if those are too few."""
    lost = [i for i, p in enumerate(payloads) if p is None]
    use = sorted(good)[: len(lost)]
    if len(use) < len(lost):
        raise ValueError(f"{len(lost)} chunks lost, {len(use)} shards left")
    if not lost:
        return list(payloads)
    size = len(good[use[0]])
    left = [[weight(j, i) for i in lost] for j in use]
    right = []
    for j in use:
        s = symbols(good[j], size).copy()
        for i, p in enumerate(payloads):
            if p is not None:
                s ^= times(weight(j, i), symbols(p, size))
        right.append(s)
    for a in range(len(lost)):  # every square part of this matrix has an inverse, and so has each leading pivot
        one = inverse(left[a][a])
        left[a], right[a] = list(times(one, np.array(left[a]))), times(one, right[a])
        for b in range(len(lost)):
            if b != a and left[b][a]:
                f = int(left[b][a])
                left[b] = list(np.array(left[b]) ^ times(f, np.array(left[a])))
                right[b] = right[b] ^ times(f, right[a])
    out = list(payloads)
    for i, s in zip(lost, right, strict=True):
        out[i] = s.astype("<u2").tobytes()[: lengths[i]]
    return out


def protect(chunks: DataFrame, group: int = 32, m: int = 1) -> DataFrame:
    """(stream_id, grp, table, shard_crc, shards) of chunks (stream_id, chunk, frames, payload), a row for each `group` consecutive chunks. m is cut to the chunks of the group."""
    if not (1 <= group <= MOST_CHUNKS and 1 <= m <= MOST_SHARDS):
        raise ValueError("group or m out of range")

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        payloads = [bytes(p) for p in rows.payload]
        made = shards(payloads, min(m, len(payloads)))
        table = [{"chunk": int(c), "frames": int(f), "bytes": len(p), "crc": zlib.crc32(p)} for c, f, p in zip(rows.chunk, rows.frames, payloads, strict=True)]
        return pd.DataFrame([{"stream_id": key[0], "grp": key[1], "table": table, "shard_crc": [zlib.crc32(s) for s in made], "shards": made}])

    shape = f"stream_id {chunks.schema['stream_id'].dataType.simpleString()}, grp bigint, table array<struct<chunk:bigint,frames:bigint,bytes:bigint,crc:bigint>>, shard_crc array<bigint>, shards array<binary>"
    rows = chunks.select("stream_id", F.col("chunk").cast("long"), "frames", "payload", F.floor(F.col("chunk") / group).cast("long").alias("grp"))
    return rows.groupBy("stream_id", "grp").applyInPandas(one, shape)


def repair(chunks: DataFrame, parity: DataFrame, group: int = 32) -> DataFrame:
    """(stream_id, chunk, frames, payload, rebuilt) of every chunk the parity covers. A chunk that is missing or whose payload fails the table's CRC is rebuilt; a group beyond repair raises, never giving wrong bytes."""

    def one(rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in kept.itertuples():
            have = {int(c): bytes(b) for c, b in zip(rows.chunk, rows.payload, strict=True) if b is not None}
            payloads = [have.get(t["chunk"]) for t in p.table]
            payloads = [b if b is not None and zlib.crc32(b) == t["crc"] else None for b, t in zip(payloads, p.table, strict=True)]
            good = {j: bytes(s) for j, s in enumerate(p.shards) if zlib.crc32(bytes(s)) == p.shard_crc[j]}
            whole = recover(payloads, [t["bytes"] for t in p.table], good)
            for t, before, b in zip(p.table, payloads, whole, strict=True):
                if zlib.crc32(b) != t["crc"]:
                    raise ValueError(f"chunk {t['chunk']} can't be rebuilt")
                out.append((p.stream_id, t["chunk"], t["frames"], b, before is None))
        return pd.DataFrame(out, columns=["stream_id", "chunk", "frames", "payload", "rebuilt"])

    shape = f"stream_id {chunks.schema['stream_id'].dataType.simpleString()}, chunk bigint, frames bigint, payload binary, rebuilt boolean"
    rows = chunks.select("stream_id", F.col("chunk").cast("long"), "payload", F.floor(F.col("chunk") / group).cast("long").alias("grp"))
    return rows.groupBy("stream_id", "grp").cogroup(parity.groupBy("stream_id", "grp")).applyInPandas(one, shape)
