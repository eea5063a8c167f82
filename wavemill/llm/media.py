"""Media columns: lossless greyscale PNG in binary columns, checked and unfiltered on reading, with cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fields, table

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, WIDTH, PAD = 0, 576, 255
LEVEL, HASH = 1, 8
#: Columns to which samples are folded before hashing: 576 = 24 * 24, so even one row of samples has both directions.
FOLD = 24


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """One 8-bit grey image, rows of `width` samples. Of the None, Sub and Up filters, each row gets that with the least sum of absolute residuals (the first at a tie)."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    body = np.empty((len(rows), width + 1), dtype=np.uint8)
    for at in range(0, len(rows), 4096):  # bounded memory for very long payloads
        x = rows[at : at + 4096]
        above = rows[at - 1 : at - 1 + len(x)] if at else np.vstack([np.zeros((1, width), np.uint8), x[:-1]])
        left = x.copy()
        left[:, 1:] -= x[:, :-1]
        up = x - above
        cost = [np.abs(f.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for f in (x, left, up)]
        kind = np.argmin(cost, axis=0)
        part = body[at : at + len(x)]
        part[:, 0] = kind
        part[:, 1:] = np.choose(kind[:, None], [x, left, up])
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, GREY, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body.data, level)) + _chunk(b"IEND", b"")


def _average(row: np.ndarray, above: np.ndarray, step: int) -> None:
    for i in range(len(row)):
        left = int(row[i - step]) if i >= step else 0
        row[i] = (int(row[i]) + (left + int(above[i])) // 2) & 255


def _paeth(row: np.ndarray, above: np.ndarray, step: int) -> None:
    for i in range(len(row)):
        a, b, c = (int(row[i - step]) if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
        da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        row[i] = (int(row[i]) + (a if da <= db and da <= dc else b if db <= dc else c)) & 255


def decode_png(data: bytes) -> np.ndarray:
    """Samples (rows, row bytes) of an 8-bit non-interlaced PNG of any colour type but palette; raises ValueError on a bad signature, chunk checksum, order, filter or size."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(data):
            raise ValueError("the file ends within a chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"critical chunk {kind!r} is unknown")
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[4:] != (0, 0, 0):
        raise ValueError("unsupported image header")
    width, height, step = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    line, unzip = width * step, zlib.decompressobj()
    raw = unzip.decompress(b"".join(parts), height * (line + 1) + 1)
    if len(raw) != height * (line + 1) or not unzip.eof:
        raise ValueError("image data has the wrong size")
    body = np.frombuffer(raw, dtype=np.uint8).reshape(height, line + 1)
    kinds, out = body[:, 0], body[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown filter")
    sub = np.flatnonzero(kinds == 1)
    if len(sub):  # independent of other rows: all at once
        x = out[sub].reshape(len(sub), width, step)
        out[sub] = np.cumsum(x, axis=1, dtype=np.uint8).reshape(len(sub), line)
    zero = np.zeros(line, np.uint8)
    for y in np.flatnonzero(kinds > 1).tolist():
        above = out[y - 1] if y else zero
        if kinds[y] == 2:
            out[y] += above
        else:
            (_average if kinds[y] == 3 else _paeth)(out[y], above, step)
    return out


@lru_cache(maxsize=512)
def _basis(n: int, low: int = HASH, grid: int = 32) -> np.ndarray:
    """(low, n): means over a grid of 32 cells (linear shares of samples), then the first cosine-transform rows."""
    edges = np.linspace(0, n, grid + 1)
    i = np.arange(n)
    share = np.clip(np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i), 0, None) * (grid / n)
    k = np.arange(low)[:, None]
    return np.cos(np.pi * (2 * np.arange(grid) + 1) * k / (2 * grid)) @ share


def dct_hash(image: np.ndarray, low: int = HASH) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine coefficients exceed their median, the constant one left out of it."""
    across, total = _basis(image.shape[1], low).T, np.zeros((low, low))
    down = _basis(image.shape[0], low)
    for at in range(0, len(image), 4096):
        total += down[:, at : at + 4096] @ (image[at : at + 4096].astype(np.float64) @ across)
    c = np.round(total / 1024, 6).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes().hex()


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)), len(raw)


SHAPE = "doc_id long, n_bytes long, png binary"


def store_text(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, png): each text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as a PNG.

    Null text counts as empty (one row of padding). Repeated rows give equal rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [payload_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode_png(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "png"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, fields(SHAPE))


DIGESTS = [("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]


def digest(png: bytes) -> tuple:
    image = decode_png(png)
    data = image.tobytes()
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(png), hashlib.sha256(png).hexdigest(), dct_hash(image.reshape(-1, FOLD))


def features(media: DataFrame) -> DataFrame:
    """Reads every stored image back: its samples' size, hash and tail checksum, the file's size and hash, the cosine hash. A null image gives nulls; a damaged one raises."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(None,) * len(DIGESTS) if p is None else digest(p) for p in b.column(2).to_pylist()]
            cols = list(zip(*got, strict=True)) or [()] * len(DIGESTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, (_, t, _) in zip(cols, DIGESTS, strict=True))], names=["doc_id", "n_bytes", *(n for n, _, _ in DIGESTS)])

    return media.select("doc_id", "n_bytes", "png").mapInArrow(task, fields("doc_id long, n_bytes long, " + ", ".join(f"{n} {t}" for n, _, t in DIGESTS)))


def op7_png_media(spark, sf_dir):
    return features(store_text(table(spark, sf_dir, "documents")))
