"""The container around coded chunks: header, metadata, chunks with inline headers, parity blocks. Reading seeks by the inline headers; a Spark data source reads ranges of chunks side by side; writing has one task a stream."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions.metadata import Metadata, check_points, read_body, write_block
from ..operators import codec, parity
from . import files
from .wav import pack

# Fixed values of the format: marks, version, lengths and bounds.
MAGIC, CHUNK, SHARDS, VERSION, HEADER_BYTES, CHUNK_BYTES, PARITY_BYTES = b"FAK1", b"FCHK", b"FPAR", 21, 56, 16, 18
UNKNOWN, MOST_METADATA, DEPTHS, RESYNC_MOST = (1 << 64) - 1, 128 << 20, (8, 16, 24, 32), 1024
ENDING = ".fak"
#: Chunks of a read partition.
PER_TASK = 16


@dataclass
class Header:
    channels: int
    bits: int
    rate: int
    frames: int = UNKNOWN
    digest: bytes = bytes(32)

    def to_bytes(self) -> bytes:
        body = struct.pack("<BBBBIQ32s", VERSION, self.channels, self.bits, 0, self.rate, self.frames, self.digest)
        return MAGIC + body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def read(cls, raw: bytes) -> Header:
        if len(raw) < HEADER_BYTES or raw[:4] != MAGIC:
            raise ValueError("not a container of coded chunks")
        version, channels, bits, mode, rate, frames, digest, crc = struct.unpack("<BBBBIQ32sI", raw[4:HEADER_BYTES])
        if version != VERSION:
            raise ValueError(f"unsupported version {version}")
        if crc != zlib.crc32(raw[4 : HEADER_BYTES - 4]):
            raise ValueError("damaged header")
        if not channels or bits not in DEPTHS or mode or not rate:
            raise ValueError("invalid header")
        return cls(channels, bits, rate, frames, digest)

    @property
    def known(self) -> bool:
        return self.frames != UNKNOWN


@dataclass
class Chunk:
    start: int
    frames: int
    at: int  # of the payload
    size: int
    crc: int


@dataclass
class Block:
    """A parity block: the chunks [first, first + len(table)) that it covers, and where its shards are."""

    first: int
    m: int
    shard: int
    at: int
    table: list[tuple[int, int, int]]
    crc: int

    @property
    def end(self) -> int:
        return self.at + PARITY_BYTES + 12 * len(self.table) + 4 * self.m + self.m * self.shard


def write_chunk(payload: bytes, frames: int) -> bytes:
    return CHUNK + struct.pack("<III", frames, len(payload), zlib.crc32(payload)) + payload


def write_parity(payloads: list[bytes], frames: list[int], m: int) -> bytes:
    """A parity block over some chunks: marks, table, checksums, shards."""
    made = parity.shards(payloads, min(m, len(payloads)))
    size = len(made[0])
    table = b"".join(struct.pack("<III", n, len(p), zlib.crc32(p)) for n, p in zip(frames, payloads, strict=True))
    sums = b"".join(struct.pack("<I", zlib.crc32(s)) for s in made)
    lead = struct.pack("<IHI", len(payloads), len(made), size)
    return SHARDS + lead + struct.pack("<I", zlib.crc32(lead + table + sums)) + table + sums + b"".join(made)


def default_parity(count: int) -> int:
    """About one shard to a hundred chunks, two at least."""
    return min(max(-(-count // 100), 2), parity.MOST_SHARDS, count)


class File:
    """An open container: only its index is in memory, payloads are read where they are asked for."""

    def __init__(self, file, index: bool = True):
        self.file, self.size = file, file.size()
        self.header = Header.read(self.read(0, min(self.size, HEADER_BYTES)))
        (length,) = struct.unpack("<I", self.read(HEADER_BYTES, 4))
        body = self.read(HEADER_BYTES + 4, length)
        if struct.unpack("<I", self.read(HEADER_BYTES + 4 + length, 4))[0] != zlib.crc32(body):
            raise ValueError("damaged metadata")
        self.metadata = read_body(body)
        check_points(self.metadata.tracks, self.header.frames if self.header.known else None)
        self.payload_start = HEADER_BYTES + 8 + length
        self.chunks: list[Chunk] = []
        self.blocks: list[Block] = []
        self._fixed: dict[int, dict[int, bytes]] = {}
        if index:
            try:
                self.chunks, self.blocks = self._walk()
            except ValueError:
                found = self._resync()
                if found is None:
                    raise
                self.chunks, self.blocks = found

    def read(self, at: int, n: int) -> bytes:
        if at + n > self.size:
            raise ValueError("the file ends early")
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, at: int, first: int) -> Block:
        count, m, shard, crc = struct.unpack("<IHII", self.read(at + 4, PARITY_BYTES - 4))
        if not (1 <= count <= parity.MOST_CHUNKS and 1 <= m <= min(parity.MOST_SHARDS, count)):
            raise ValueError("invalid parity block")
        table = [tuple(r) for r in np.frombuffer(self.read(at + PARITY_BYTES, 12 * count), "<u4").reshape(count, 3).tolist()]
        block = Block(first, m, shard, at, table, crc)
        if block.end > self.size:
            raise ValueError("a parity block runs past the end")
        return block

    def _walk(self) -> tuple[list[Chunk], list[Block]]:
        at, done, chunks, blocks = self.payload_start, 0, [], []
        while at < self.size:
            lead = self.read(at, min(CHUNK_BYTES, self.size - at))
            if lead[:4] == SHARDS:
                block = self._block(at, 0)
                block.first = len(chunks) - len(block.table)
                if block.first < 0:
                    raise ValueError("a parity block covers more chunks than there are")
                blocks.append(block)
                at = block.end
                continue
            if self.header.known and done == self.header.frames:
                raise ValueError("bytes after the last chunk")
            if len(lead) < CHUNK_BYTES or lead[:4] != CHUNK:
                raise ValueError("no chunk where one should be")
            frames, size, crc = struct.unpack("<III", lead[4:])
            if not 0 < frames <= codec.MOST_FRAMES or at + CHUNK_BYTES + size > self.size:
                raise ValueError("invalid chunk header")
            chunks.append(Chunk(done, frames, at + CHUNK_BYTES, size, crc))
            at, done = at + CHUNK_BYTES + size, done + frames
            if self.header.known and done > self.header.frames:
                raise ValueError("more frames than declared")
        if self.header.known and done != self.header.frames:
            raise ValueError("fewer frames than declared")
        return chunks, blocks

    def _sound(self, block: Block) -> bool:
        n = len(block.table)
        raw = self.read(block.at + 4, 10) + self.read(block.at + PARITY_BYTES, 12 * n + 4 * block.m)
        return zlib.crc32(raw) == block.crc

    def _resync(self) -> tuple[list[Chunk], list[Block]] | None:
        """Chunks and parity blocks from the tables of sound parity blocks that together cover the whole file; None if they don't."""
        at, places, step, tail = self.payload_start, [], 1 << 22, b""
        while at < self.size and len(places) < RESYNC_MOST:
            part = tail + self.read(at, min(step, self.size - at))
            base, i = at - len(tail), part.find(SHARDS)
            while i >= 0:
                places.append(base + i)
                i = part.find(SHARDS, i + 1)
            at, tail = at + step, part[-3:]
        by_start: dict[int, Block] = {}
        for p in dict.fromkeys(places):
            try:
                block = self._block(p, 0)
            except ValueError:
                continue
            if self._sound(block):
                by_start[p - sum(CHUNK_BYTES + s for _, s, _ in block.table)] = block
        chunks, blocks, at, done = [], [], self.payload_start, 0
        while at < self.size:
            if (block := by_start.get(at)) is None:
                return None
            block.first = len(chunks)
            for frames, size, crc in block.table:
                chunks.append(Chunk(done, frames, at + CHUNK_BYTES, size, crc))
                at, done = at + CHUNK_BYTES + size, done + frames
            blocks.append(block)
            at = block.end
        return (chunks, blocks) if done == self.header.frames else None

    def payload(self, i: int) -> bytes:
        """A chunk's payload, rebuilt from parity if it fails its checksum; ValueError if that can't be."""
        c = self.chunks[i]
        raw = self.read(c.at, c.size)
        if zlib.crc32(raw) == c.crc:
            return raw
        for k, b in enumerate(self.blocks):
            if b.first <= i < b.first + len(b.table):
                if k not in self._fixed:
                    self._fixed[k] = self._repair(b)
                return self._fixed[k].get(i, raw)
        raise ValueError(f"chunk {i} fails its checksum")

    def _repair(self, b: Block) -> dict[int, bytes]:
        """The damaged payloads of a block's chunks, each checked against the table."""
        if not self._sound(b):
            raise ValueError("damaged parity block")
        sums_at = b.at + PARITY_BYTES + 12 * len(b.table)
        sums = struct.unpack(f"<{b.m}I", self.read(sums_at, 4 * b.m))
        shards_ = [self.read(sums_at + 4 * b.m + j * b.shard, b.shard) for j in range(b.m)]
        good = {j: s for j, s in enumerate(shards_) if zlib.crc32(s) == sums[j]}
        own = self.chunks[b.first : b.first + len(b.table)]
        raw = [self.read(c.at, c.size) for c in own]
        held = [r if zlib.crc32(r) == t[2] and len(r) == t[1] else None for r, t in zip(raw, b.table, strict=True)]
        whole = parity.recover(held, [t[1] for t in b.table], good)
        if any(zlib.crc32(w) != t[2] for w, t in zip(whole, b.table, strict=True)):
            raise ValueError("a chunk can't be rebuilt")
        return {b.first + i: w for i, (h, r, w) in enumerate(zip(held, raw, whole, strict=True)) if h is None or zlib.crc32(r) != own[i].crc}

    def decode(self, i: int) -> np.ndarray:
        return codec.decode_chunk(self.payload(i), self.chunks[i].frames, self.header.channels, self.header.bits)

    def at_frame(self, frame: int) -> int:
        """Number of the chunk that holds a frame."""
        if not self.chunks or not 0 <= frame < self.chunks[-1].start + self.chunks[-1].frames:
            raise ValueError("no such frame")
        return int(np.searchsorted([c.start for c in self.chunks], frame, "right")) - 1

    def samples(self, first: int, last: int) -> np.ndarray:
        """Samples (channels, frames) of [first, last); only the chunks that hold them are read."""
        if first >= last:
            return np.zeros((self.header.channels, 0), np.int64)
        a, b = self.at_frame(first), self.at_frame(last - 1)
        whole = np.concatenate([self.decode(i) for i in range(a, b + 1)], axis=1)
        return whole[:, first - self.chunks[a].start : last - self.chunks[a].start]

    def verify(self) -> str | None:
        """None if every chunk decodes and the whole has the header's digest, else what is wrong."""
        try:
            h = hashlib.sha256()
            for i in range(len(self.chunks)):
                h.update(pcm(self.decode(i), self.header.bits))
        except ValueError as e:
            return str(e)
        return None if not self.header.known or h.digest() == self.header.digest else "the digest differs"


def pcm(x: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian bytes of samples (channels, frames), signed at every depth."""
    flat = x.T.ravel()
    return flat.astype(np.int8).tobytes() if bits == 8 else pack(flat, bits)


def rewrite_metadata(source: str, target: str, change: Callable[[Metadata, Header], None]) -> None:
    """Copies a container with changed metadata; header and audio bytes stay as they are."""
    with files.open_input(source) as f, files.open_output(f"{target}.part") as out:
        held = File(f, index=False)
        change(held.metadata, held.header)
        check_points(held.metadata.tracks, held.header.frames if held.header.known else None)
        out.write(held.read(0, HEADER_BYTES) + write_block(held.metadata))
        for at in range(held.payload_start, held.size, 1 << 22):
            out.write(held.read(at, min(1 << 22, held.size - at)))
    files.move(f"{target}.part", target)


class StreamWriter:
    """Writes chunks of a stream of unknown length as they come; never seeks, holds no chunk."""

    def __init__(self, out, channels: int, bits: int, rate: int, metadata: Metadata | None = None, level: str = codec.DEFAULT):
        self.out, self.channels, self.bits, self.level = out, channels, bits, level
        out.write(Header(channels, bits, rate).to_bytes() + write_block(metadata or Metadata()))

    def push(self, channels: list[np.ndarray]) -> None:
        if len(channels) != self.channels or not len(channels[0]):
            raise ValueError("a chunk needs every channel, and a frame")
        self.out.write(write_chunk(codec.encode_chunk(channels, self.bits, self.level), len(channels[0])))


def read_stream(read: Callable[[int], bytes]) -> Iterator:
    """The header, the metadata, then each chunk's samples as soon as its bytes are there. read(n) gives up to n bytes, none at the end; only the end of a chunk may be the stream's."""

    def exact(n: int, may_end: bool = False) -> bytes | None:
        parts, left = [], n
        while left:
            part = read(left)
            if not part:
                if may_end and left == n:
                    return None
                raise ValueError("the stream ends within a chunk")
            parts.append(part)
            left -= len(part)
        return b"".join(parts)

    header = Header.read(exact(HEADER_BYTES))
    (length,) = struct.unpack("<I", exact(4))
    if length > MOST_METADATA:
        raise ValueError("metadata too long")
    body = exact(length)
    if struct.unpack("<I", exact(4))[0] != zlib.crc32(body):
        raise ValueError("damaged metadata")
    yield header
    yield read_body(body)
    done = 0
    while not header.known or done < header.frames:
        lead = exact(CHUNK_BYTES, may_end=not header.known)
        if lead is None:
            return
        frames, size, crc = struct.unpack("<III", lead[4:])
        if lead[:4] != CHUNK or not 0 < frames <= codec.MOST_FRAMES or size > 8 * 4 * frames * header.channels + (1 << 20):
            raise ValueError("invalid chunk header")
        payload = exact(size)
        if zlib.crc32(payload) != crc:
            raise ValueError("damaged payload")
        done += frames
        if header.known and done > header.frames:
            raise ValueError("more frames than declared")
        yield codec.decode_chunk(payload, frames, header.channels, header.bits)


@dataclass
class Spec:
    """What a written stream's header and metadata say; group: chunks of a parity block (0: none), m: its shards (0: the default)."""

    rate: int = 44100
    bits: int = 16
    level: str = codec.DEFAULT
    chunk_frames: int = 45056
    group: int = 0
    m: int = 0
    metadata: dict[str, Metadata] = field(default_factory=dict)


def write(samples: DataFrame, folder: str, spec: Spec | None = None) -> DataFrame:
    """(stream_id, path, frames, channels, bytes, sha256): a container in `folder` for each stream of samples (stream_id, channel, t, x).

    Chunks are coded side by side; each carries its bytes for the digest, which is sequential by nature, to the one task
    that writes its stream. That task streams: it holds a chunk, or a parity group. A file appears under its name only
    when it is whole, so a repeated task leaves nothing half written.
    """
    spec = spec or Spec()
    kind = samples.schema["stream_id"].dataType.simpleString()
    rows = codec.blocks(samples, spec.chunk_frames).groupBy("stream_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("channel", "t0", "t1", "xs"))).alias("c"))
    coded = codec.encode_blocks(rows, spec.bits, spec.chunk_frames, spec.level)
    ordered = coded.repartition("stream_id").sortWithinPartitions("stream_id", "chunk").select("stream_id", "chunk", "frames", "channels", "payload")

    def finish(state: dict) -> tuple:
        if spec.group and state["group"]:
            state["body"].write(write_parity([p for p, _ in state["group"]], [n for _, n in state["group"]], spec.m or default_parity(len(state["group"]))))
        state["body"].close()
        path, name = f"{folder.rstrip('/')}/{state['id']}{ENDING}", state["name"]
        header = Header(state["channels"], spec.bits, spec.rate, state["frames"], state["hash"].digest())
        m = spec.metadata.get(str(state["id"]), Metadata())
        m.sync(spec.rate, state["frames"])
        with files.open_output(f"{name}.part") as out, files.open_input(name) as body:
            out.write(header.to_bytes() + write_block(m))
            while block := body.read(1 << 22):
                out.write(block)
            size = out.tell()
        files.move(f"{name}.part", path)
        files.remove(name)
        return state["id"], path, state["frames"], state["channels"], size, state["hash"].hexdigest()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, done = None, []
        for b in batches:
            for stream, chunk, frames, channels, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is not None and state["id"] != stream:
                    done.append(finish(state))
                    state = None
                if state is None:
                    name = f"{folder.rstrip('/')}/.{stream}-{TaskContext.get().taskAttemptId()}"
                    state = {"id": stream, "name": name, "body": files.open_output(name), "hash": hashlib.sha256(), "frames": 0, "channels": channels, "group": [], "next": 0, "short": False}
                if chunk != state["next"] or channels != state["channels"] or state["short"]:
                    raise ValueError(f"stream {stream}: chunk {state['next']} is missing or short")
                state["short"] = frames < spec.chunk_frames
                state["next"] += 1
                state["frames"] += frames
                state["hash"].update(pcm(codec.decode_chunk(payload, frames, channels, spec.bits), spec.bits))  # what a reader will get
                state["body"].write(write_chunk(payload, frames))
                if spec.group:
                    state["group"].append((payload, frames))
                    if len(state["group"]) == spec.group:
                        state["body"].write(write_parity([p for p, _ in state["group"]], [n for _, n in state["group"]], spec.m or default_parity(spec.group)))
                        state["group"] = []
        if state is not None:
            done.append(finish(state))
        cols = list(zip(*done, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type if done else None), *(pa.array(c, t) for c, t in zip(cols[1:], [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()], strict=True))], names=["stream_id", "path", "frames", "channels", "bytes", "sha256"]) if done else pa.RecordBatch.from_pylist([])

    return ordered.mapInArrow(lambda it: (b for b in task(it) if b.num_rows), f"stream_id {kind}, path string, frames bigint, channels int, bytes bigint, sha256 string")


TABLES = {
    "samples": "path string, channel int, t bigint, x bigint",
    "chunks": "path string, chunk int, start_frame bigint, frames bigint, channels int, crc bigint, sound boolean, payload binary",
    "streams": "path string, channels int, bits int, rate bigint, frames bigint, chunks int, parity int, bytes bigint, sha256 string, error string",
    "tags": "path string, key string, value string",
    "pictures": "path string, n int, kind int, mime string, description string, data binary",
    "tracks": "path string, number int, isrc string, first bigint, last bigint",
    "exceptions": "path string, scale int, channel int, t bigint, bits bigint",
}


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.per = options["path"], options.get("table", "samples"), int(options.get("chunksPerTask", PER_TASK))
        self.permissive = options.get("mode", "failfast") == "permissive"
        self.low, self.high = 0, UNKNOWN

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on t choose the chunks that are read; Spark still applies every filter."""
        for f in filters:
            if self.table == "samples" and getattr(f, "attribute", None) == ("t",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high = min(self.high, f.value + 1 - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[InputPartition]:
        names = files.listing(self.path, ENDING)
        if self.table not in ("samples", "chunks"):
            return [_Range(n, 0, 0) for n in names] or [_Range("", 0, 0)]
        out: list[InputPartition] = []
        for name in names:
            with files.open_input(name) as f:
                held = File(f)
            use = [i for i, c in enumerate(held.chunks) if self.table == "chunks" or c.start < self.high and c.start + c.frames > self.low]
            out += [_Range(name, use[k], use[min(k + self.per, len(use)) - 1] + 1) for k in range(0, len(use), self.per)]
        return out or [_Range("", 0, 0)]

    def _rows(self, f: File, path: str) -> list[tuple]:
        h, m = f.header, f.metadata
        if self.table == "streams":
            return [(path, h.channels, h.bits, h.rate, h.frames if h.known else None, len(f.chunks), sum(b.m for b in f.blocks), f.size, h.digest.hex(), None)]
        if self.table == "tags":
            return [(path, *(t.split("=", 1) if "=" in t else (t, None))) for t in m.tags]
        if self.table == "pictures":
            return [(path, i, p.kind, p.mime, p.description, p.data) for i, p in enumerate(m.pictures)]
        if self.table == "tracks":
            return [(path, t.number, t.isrc, *m.range(t.number, h.frames)) for t in m.tracks]
        return [(path, m.scale, c, t, b) for c, t, b in m.exceptions]

    def read(self, partition: _Range) -> Iterator:
        path = partition.path
        if not path:
            return
        if self.table not in ("samples", "chunks"):
            try:
                with files.open_input(path) as f:
                    yield from self._rows(File(f, index=self.table == "streams"), path)
            except (ValueError, struct.error) as e:
                if not self.permissive:
                    raise
                if self.table == "streams":
                    yield (path, None, None, None, None, None, None, None, None, str(e))
            return
        with files.open_input(path) as f:
            held = File(f)
            for i in range(partition.first, partition.last):
                c = held.chunks[i]
                if self.table == "chunks":
                    raw = held.read(c.at, c.size)
                    yield (path, i, c.start, c.frames, held.header.channels, c.crc, zlib.crc32(raw) == c.crc, raw)
                    continue
                x = held.decode(i)
                n = c.frames
                for k in range(held.header.channels):
                    t = np.arange(c.start, c.start + n, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, k, np.int32)), pa.array(t), pa.array(x[k])], names=["path", "channel", "t", "x"])


class Container(DataSource):
    """Options: path (a file or a folder), table (samples, chunks, streams, tags, pictures, tracks, exceptions), chunksPerTask, mode (failfast, or permissive: an unreadable file is a row of streams with its error). Only samples and chunks read payloads."""

    @classmethod
    def name(cls) -> str:
        return "codedchunks"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "samples")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def verify(spark, path: str) -> DataFrame:
    """(path, ok, reason) of every container under a path, one task a file."""
    names = spark.createDataFrame([(n,) for n in files.listing(path, ENDING)], "path string")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                try:
                    with files.open_input(name) as f:
                        reason = File(f).verify()
                except (ValueError, struct.error) as e:
                    reason = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([reason is None]), pa.array([reason], pa.string())], names=["path", "ok", "reason"])

    return names.repartition(max(1, names.count()), "path").mapInArrow(task, "path string, ok boolean, reason string")
