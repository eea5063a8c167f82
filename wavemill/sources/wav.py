"""PCM WAV as a Spark data source: `spark.read.format("pcmwav")` and `df.write.format("pcmwav")`.

Reading splits the sample data into ranges of whole frames, one task each; a task reads only its own bytes. Writing is
by chunk: tasks write the interleaved bytes of their rows, and the commit puts a header before them in order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files

SCHEMA = "path string, channel int, t bigint, x bigint"
#: Frames of a partition and of a batch.
SPLIT, BATCH = 1 << 22, 1 << 16
# Fixed values of the format.
PCM, FLOAT, EXTENSIBLE, UNKNOWN = 1, 3, 0xFFFE, 0xFFFFFFFF


@dataclass
class Layout:
    channels: int
    rate: int
    bits: int
    is_float: bool
    offset: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.bits // 8


def layout(path: str) -> Layout:
    """Header of a file; raises ValueError if it isn't a WAV of 8, 16, 24 or 32 bits, or ends within a frame. A data size of 0, 0xFFFFFFFF or past the end means up to the end."""
    with files.open_input(path) as f:
        size = f.size()
        head = f.read(12)
        if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
            raise ValueError(f"{path}: not a WAV file")
        form = None
        while len(part := f.read(8)) == 8:
            kind, n = part[:4], struct.unpack("<I", part[4:])[0]
            if kind == b"fmt ":
                body = f.read(n)
                if len(body) < 16:
                    raise ValueError(f"{path}: short format chunk")
                tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
                if tag == EXTENSIBLE and len(body) >= 26:
                    tag = struct.unpack("<H", body[24:26])[0]
                if tag not in (PCM, FLOAT) or bits not in (8, 16, 24, 32) or not channels or tag == FLOAT and bits != 32:
                    raise ValueError(f"{path}: unsupported sample format")
                form = (channels, rate, bits, tag == FLOAT)
                f.seek(f.tell() + (n & 1))
            elif kind == b"data":
                if form is None:
                    raise ValueError(f"{path}: data before its format")
                at, left = f.tell(), size - f.tell()
                n = left if n in (0, UNKNOWN) or n > left else n
                width = form[0] * form[2] // 8
                if n % width:
                    raise ValueError(f"{path}: ends within a frame")
                return Layout(*form, at, n // width)
            else:
                f.seek(min(size, f.tell() + n + (n & 1)))
    raise ValueError(f"{path}: no sample data")


def unpack(raw: bytes, bits: int, is_float: bool = False) -> np.ndarray:
    """Samples as 64-bit integers: 8-bit is unsigned with offset 128; float32 stays as its bit pattern."""
    if bits == 8:
        return np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        return b[:, 0] | b[:, 1] << 8 | (b[:, 2] ^ 128) - 128 << 16
    return np.frombuffer(raw, {16: "<i2", 32: "<u4" if is_float else "<i4"}[bits]).astype(np.int64)


def pack(x: np.ndarray, bits: int) -> bytes:
    low, high = -(1 << bits - 1), (1 << bits - 1) - 1
    if len(x) and (x.min() < low or x.max() > high):
        raise ValueError(f"samples don't fit {bits} bits")
    if bits == 8:
        return (x + 128).astype(np.uint8).tobytes()
    if bits == 24:
        return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return x.astype({16: "<i2", 32: "<i4"}[bits]).tobytes()


def header(channels: int, rate: int, bits: int, data: int, is_float: bool = False) -> bytes:
    """Sizes that pass 32 bits are written as unknown."""
    size = lambda n: min(n, UNKNOWN)
    return b"RIFF" + struct.pack("<I", size(36 + data + (data & 1))) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, FLOAT if is_float else PCM, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + b"data" + struct.pack("<I", size(data))


class _Range(InputPartition):
    def __init__(self, path: str, first: int, frames: int):
        self.path, self.first, self.frames = path, first, frames


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        names = files.listing(self.path)
        out: list[InputPartition] = []
        for name in names:
            n = layout(name).frames
            out += [_Range(name, at, min(self.split, n - at)) for at in range(0, n, self.split)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.frames:
            return
        form = layout(partition.path)
        with files.open_input(partition.path) as f:
            f.seek(form.offset + partition.first * form.frame_bytes)
            for at in range(0, partition.frames, BATCH):
                n = min(BATCH, partition.frames - at)
                x = unpack(f.read(n * form.frame_bytes), form.bits, form.is_float)
                t = np.repeat(np.arange(n, dtype=np.int64) + partition.first + at, form.channels)
                channel = np.tile(np.arange(form.channels, dtype=np.int32), n)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(x)), pa.array(channel), pa.array(t), pa.array(x)], names=["path", "channel", "t", "x"])


@dataclass
class _Part(WriterCommitMessage):
    name: str
    first: int
    frames: int


class _Writer(DataSourceArrowWriter):
    """Rows (channel, t, x), sorted by (t, channel) within partitions whose ranges of t don't overlap, as repartitionByRange("t") gives. Parts lie beside the file, in whatever store it is in."""

    def __init__(self, options: dict):
        self.path, self.channels, self.rate, self.bits = options["path"], int(options.get("channels", 1)), int(options.get("rate", 44100)), int(options.get("bits", 16))
        self.is_float = options.get("float", "false").lower() == "true"
        if self.is_float and self.bits != 32:
            raise ValueError("float samples have 32 bits")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        name, first, count = f"{self.path}.part-{TaskContext.get().taskAttemptId()}", None, 0
        with files.open_output(name) as f:
            for b in iterator:
                if not b.num_rows:
                    continue
                channel, t, x = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("channel", "t", "x"))
                first = int(t[0]) if first is None else first
                place = count + np.arange(b.num_rows)
                if (t != first + place // self.channels).any() or (channel != place % self.channels).any():
                    raise ValueError("rows must be dense and sorted by (t, channel)")
                if self.is_float and (x.min() < 0 or x.max() > UNKNOWN):
                    raise ValueError("not patterns of 32 bits")
                f.write(x.astype("<u4").tobytes() if self.is_float else pack(x, self.bits))
                count += b.num_rows
        if count % self.channels:
            raise ValueError("a frame lacks channels")
        return _Part(name, -1 if first is None else first, count // self.channels)

    def commit(self, messages: list[_Part]) -> None:
        """One file needs one writer: the parts are streamed after the header, 4 MB at a time."""
        parts = sorted((m for m in messages if m.frames), key=lambda m: m.first)
        if any(a.first + a.frames != b.first for a, b in zip(parts, parts[1:], strict=False)):
            raise ValueError("partitions overlap or leave a gap")
        data = sum(m.frames for m in parts) * self.channels * self.bits // 8
        with files.open_output(f"{self.path}.tmp") as f:
            f.write(header(self.channels, self.rate, self.bits, data, self.is_float))
            for m in parts:
                with files.open_input(m.name) as part:
                    while block := part.read(1 << 22):
                        f.write(block)
            f.write(b"\0" * (data & 1))
        files.move(f"{self.path}.tmp", self.path)
        self.abort(messages)

    def abort(self, messages: list[_Part]) -> None:
        for m in messages:
            if m is not None:
                files.remove(m.name)


class PcmWav(DataSource):
    """Options: path; for reading split (frames of a partition), for writing channels, rate, bits, float (x are bit patterns)."""

    @classmethod
    def name(cls) -> str:
        return "pcmwav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)
