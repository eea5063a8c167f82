"""Token-ID files: independent zstandard frames, one a document, with a trailing seek table and per-frame checksums.

Layout of a file: a zstandard frame for each document (its ids as little-endian unsigned 32-bit integers), a skippable
frame with the documents' keys (64-bit integers and null flags), and the public seekable-format table: a skippable frame
with compressed size, decompressed size and the low 32 bits of XXH64 for each frame, ended by the number of frames, a
descriptor byte and the magic number. Any zstandard tool can decompress the whole; a reader that wants one document
reads the table and that document's bytes alone.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fields, scratch_path, table

# Fixed values of the public seekable zstandard format.
SKIPPABLE_TABLE, SKIPPABLE_KEYS, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
END_ID, LEVEL = 1, 3
#: Files at least, and stored bytes of the input that a file stands for.
RANGES, RANGE_BYTES = 48, 64 << 20
#: Words that a worker's cache of encoded words holds; beyond it the cache starts anew.
CACHE_WORDS = 700_000
_SPACE = "\t\n\v\f\r "


class WordEncoder:
    """Ids of a text as bytes, by the library's model.

    For a tokenizer that `gap_free` accepts, white space only separates, so a text's ids are those of its words end to
    end. A word's ids are kept; a new word of plain characters is cut by the tokenizer's own splitting pattern, and each
    piece goes to the library's model once. Any other word goes through the library's whole encode.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self.gap_free(spec)
        if self.by_word:
            self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall

    @staticmethod
    def gap_free(spec: dict) -> bool:
        """True for lower-cased, byte-level text cut by a pattern that no white space matches, and no added token with white space or stripping."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        split = [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[^\s" in steps[0].get("pattern", {}).get("Regex", "") and not (steps[1].get("add_prefix_space") or steps[1].get("use_regex"))
        norms = (spec.get("normalizer") or {}).get("normalizers") or []
        plain = [n.get("type") for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1].get("pattern") == {"Regex": r"\s+"} and norms[1].get("content") == " "
        added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(_SPACE)) and "<" in t["content"] for t in spec.get("added_tokens", []))
        return bool(split and plain and added and not spec.get("truncation") and not spec.get("post_processor"))

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
            got = b"".join(t.id.to_bytes(4, "little") for t in self.tok.model.tokenize(shown))
            if len(self.pieces) < CACHE_WORDS:
                self.pieces[piece] = got
        return got

    def word(self, word: str) -> bytes:
        if _PLAIN(word):
            got = b"".join(map(self.piece, self.cut(word.lower())))
        else:
            got = np.asarray(self.tok.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.known) < CACHE_WORDS:
            self.known[word] = got
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        out, get = [], self.known.get
        for text in texts:
            words = _GAP.split(text) if _ODD(text) else text.split()
            ids = list(map(get, words))
            if None in ids:
                ids = [self.word(w) if i is None else i for w, i in zip(words, ids, strict=True)]
            out.append(b"".join(ids))
        return out


#: Characters that Python's split() takes for white space but the pattern's ASCII gaps don't have; and the gaps.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_GAP = re.compile("[\t-\r ]+")
#: Words that composing, lower-casing and added tokens treat one character at a time: printable ASCII but <, and Latin-1 letters.
_PLAIN = re.compile("[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from code point 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


_SHOWN = _byte_letters()
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Writer:
    """Writes one file; close() returns nothing, the file is whole only then."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.zip, self.rows, self.keys = out, zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True), [], []

    def add(self, key: int | None, raw: bytes) -> None:
        frame = self.zip.compress(raw)
        self.out.write(frame)
        self.rows.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.keys.append(key)

    def close(self) -> None:
        keys = np.asarray([0 if k is None else k for k in self.keys], dtype="<i8").tobytes() + bytes(k is None for k in self.keys)
        self.out.write(struct.pack("<II", SKIPPABLE_KEYS, len(keys)) + keys)
        foot = b"".join(self.rows) + struct.pack("<IBI", len(self.rows), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(foot)) + foot)
        self.out.close()


class Reader:
    """Opens a file by its seek table. documents are numbered from 0; read(i) touches that frame alone and tests its checksum."""

    def __init__(self, file):
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        size = file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        whole = 12 * count + 9
        head, length = struct.unpack("<II", self._at(size - whole - 8, 8))
        if head != SKIPPABLE_TABLE or length != whole:
            raise ValueError("the seek table is damaged")
        rows = np.frombuffer(self._at(size - whole, 12 * count), dtype="<u4").reshape(count, 3)
        self.sizes, self.lengths, self.sums = rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        raw = self._at(int(self.offsets[-1]), 8 + 9 * count)
        if struct.unpack("<II", raw[:8]) != (SKIPPABLE_KEYS, 9 * count):
            raise ValueError("the key frame is damaged")
        null = raw[8 + 8 * count :]
        self.keys = [None if n else k for k, n in zip(np.frombuffer(raw[8 : 8 + 8 * count], dtype="<i8").tolist(), null, strict=True)]

    def _at(self, offset: int, n: int) -> bytes:
        if offset < 0:
            raise ValueError("the file is too short")
        self.file.seek(offset)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the file ends early")
        return data

    def _open(self, frame: bytes, i: int) -> bytes:
        raw = self.unzip.decompress(frame, max_output_size=int(self.lengths[i]) or 1)
        if len(raw) != self.lengths[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} fails its checksum")
        return raw

    def read(self, i: int) -> bytes:
        return self._open(self._at(int(self.offsets[i]), int(self.sizes[i])), i)

    def scan(self, most: int = 1 << 22) -> Iterator[tuple[int | None, bytes]]:
        """Every document in order; reads ahead a few megabytes at a time."""
        i, n = 0, len(self.sizes)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + most, "right")) - 1)
            block = self._at(int(self.offsets[i]), int(self.offsets[j] - self.offsets[i]))
            for k in range(i, j):
                at = int(self.offsets[k] - self.offsets[i])
                yield self.keys[k], self._open(block[at : at + int(self.sizes[k])], k)
            i = j


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def ranges_of(docs: DataFrame) -> int:
    """Files for docs: as many as the optimizer's estimate of the input asks for, so tasks stay alike at every size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(100_000, max(RANGES, size // RANGE_BYTES))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, ranges: int | None = None) -> list[dict]:
    """Encodes and writes docs (doc_id, text) to `folder`, a URI that all executors share; returns a line for each file.

    Documents are range-partitioned and sorted by (doc_id, text), null ids first, so files and frames are in ascending
    order and repeated rows stay apart. A task writes its own file under a name of its attempt and reports it only once
    closed: a lost or repeated attempt leaves a file that no one reads. The driver gets a line a file, never ids.
    Null text counts as empty: its document is the end id alone. An empty table gives no files.
    """
    bounded_batches(docs.sparkSession)
    place, base = _place(folder)
    place.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(ranges or ranges_of(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, name, count = None, "", 0
        enc, where = encoder(tokenizer), TaskContext.get()
        disk, top = _place(folder)
        n = 0
        for b in batches:
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for key, raw in zip(keys, enc.encode(texts), strict=True):
                if to is None:
                    name = f"ids-{where.partitionId():06d}-{where.taskAttemptId()}.zst"
                    to = Writer(disk.open_output_stream(f"{top}/{name}", compression=None))
                to.add(key, raw + end)
                count, n = count + len(raw) // 4 + 1, n + 1
        if to is not None:
            to.close()
            yield pa.RecordBatch.from_pydict({"part": [where.partitionId()], "file": [name], "docs": [n], "ids": [count]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    files = sorted((r.asDict() for r in rows.mapInArrow(task, "part int, file string, docs long, ids long").collect()), key=lambda r: r["part"])
    start = 0
    for f in files:
        f["start"], start = start, start + f["ids"]
    with place.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"end_id": end_id, "files": files}).encode())
    return files


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files that the manifest in `folder` lists, one task a file."""
    place, base = _place(folder)
    with place.open_input_stream(f"{base}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    lines = spark.createDataFrame([(f["file"], f["start"]) for f in files], "file string, start long")
    shape = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = _place(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                with disk.open_input_file(f"{top}/{name}") as f:
                    for key, raw in Reader(f).scan():
                        rows.append((key, start, len(raw) // 4, raw))
                        start, size = start + len(raw) // 4, size + len(raw)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)

    return lines.repartition(max(1, len(files))).mapInArrow(task, fields("doc_id long, start long, n_tokens long, ids binary"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "ids")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def brute(rows: list[tuple[int | None, str | None]], tokenizer: str, end_id: int = END_ID) -> list[tuple]:
    """The same result by the library's plain encode, without files."""
    from tokenizers import Tokenizer

    tok, out, start = Tokenizer.from_file(tokenizer), [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((key, start, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out
