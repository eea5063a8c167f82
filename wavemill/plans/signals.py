"""Queries of the operators that work on a chunk's samples as arrays, of containers, floats and cue sheets, with DuckDB SQL that computes the same by other means."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import floats
from ..functions.metadata import Metadata, write_block
from ..operators import codec, stages
from ..sources import container
from . import cue
from .views import duckdb, run

_LAG, _TAPS = 40, (5, 9, 5)
_CROSS, _MAP = ((3, -5, 9), 3), (5884105195, 700000001)
_SHORT = {"bits": 32, "chunk_frames": 4096}


def _arrays(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(chunk, t, a column of arrays for each of columns), a row a chunk, in order of t."""
    held = rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("t", *columns))).alias("_s"))
    return held.select("chunk", F.col("_s.t").alias("t"), *(F.col(f"_s.{c}").alias(c) for c in columns))


def _by_chunk(rows: DataFrame, columns: tuple[str, ...], kernel: Callable[..., np.ndarray], name: str) -> DataFrame:
    """(t, name): kernel's array for each chunk's arrays, one value a sample."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [kernel(*(b.column(2 + j)[i].values.to_numpy(zero_copy_only=False) for j in range(len(columns)))) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["t", name])

    got = _arrays(rows, columns).mapInArrow(task, f"t array<bigint>, {name} array<bigint>")
    return got.select(F.explode(F.arrays_zip("t", name)).alias("r")).select("r.t", f"r.{name}")


def _sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "SELECT * FROM {sig}")


def _difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "SELECT t, chunk, coalesce(e, 0) AS e FROM {res1}")


def long_term(spark, sf_dir):
    return _by_chunk(_difference(spark, sf_dir), ("e",), lambda e: stages.long_encode(e, _LAG, list(_TAPS)), "c")


def long_term_back(spark, sf_dir):
    return _by_chunk(_difference(spark, sf_dir), ("e",), lambda e: stages.long_decode(stages.long_encode(e, _LAG, list(_TAPS)), _LAG, list(_TAPS)), "e")


def cross_term(spark, sf_dir):
    rows = run(spark, sf_dir, "SELECT t, chunk, r FROM {sig2}")
    return _by_chunk(rows, ("r",), lambda r: stages.cross_term(r, -1, list(_CROSS[0]), _CROSS[1]), "term")


def adaptive_back(spark, sf_dir):
    def both(e: np.ndarray) -> np.ndarray:
        s = stages.shift_for(e)
        return stages.adapt(stages.adapt(e, 16, 4, s, False), 16, 4, s, True)

    return _by_chunk(_difference(spark, sf_dir), ("e",), both, "e")


def carried_back(spark, sf_dir):
    """The chunk in frames of 1,500, every other one through the filter, which the rest only teach."""

    def both(e: np.ndarray) -> np.ndarray:
        there, back, out = stages.Carried(512, 8), stages.Carried(512, 8), []
        for k, a in enumerate(range(0, len(e), 1500)):
            part = e[a : a + 1500]
            if k % 2:
                there.skip(part)
                back.skip(part)
                out.append(part)
            else:
                s = stages.shift_for(part)
                out.append(back.run(there.run(part, s, False), s, True))
        return np.concatenate(out)

    return _by_chunk(_difference(spark, sf_dir), ("e",), both, "e")


def map_values(spark, sf_dir):
    return _by_chunk(_sig(spark, sf_dir), ("x",), lambda x: stages.ValueMap(*_MAP).apply(x, 24), "y")


def detected_maps(spark, sf_dir):
    """Step and offset that detection finds for each chunk of the lattice, written as a section and read again."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for i in range(b.num_rows):
                x = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                (m,), _ = stages.read_maps(stages.write_maps([stages.detect(x, 24)]), 1, len(x))
                got.append((m.p >> stages.FINE, m.c >> stages.FINE) if m else (None, None))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[j] for g in got], pa.int64()) for j in (0, 1))], names=["chunk", "step", "start"])

    return _arrays(run(spark, sf_dir, "SELECT * FROM {lattice}"), ("x",)).mapInArrow(task, "chunk bigint, step bigint, start bigint")


_LONG_LAGS = (0, 1, 32, 100, 1000, 2047)


def long_autocorrelation(spark, sf_dir):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.rint(stages.autocorrelation(b.column(2)[i].values.to_numpy(zero_copy_only=False), max(_LONG_LAGS))).astype(np.int64)[list(_LONG_LAGS)] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], names=["chunk", "r"])

    rows = _arrays(run(spark, sf_dir, "SELECT t, chunk, x div 16 AS x FROM {sig}"), ("x",)).mapInArrow(task, "chunk bigint, r array<bigint>")
    lags = F.array(*(F.lit(k).cast("long") for k in _LONG_LAGS))
    return rows.select("chunk", F.explode(F.arrays_zip(lags.alias("lag"), "r")).alias("v")).select("chunk", "v.lag", "v.r")


def _chunks(spark, sf_dir) -> DataFrame:
    long = "SELECT 'events' AS stream_id, CAST(0 AS INT) AS channel, t, l AS x FROM {sig2} UNION ALL SELECT 'events', CAST(1 AS INT), t, r FROM {sig2}"
    return codec.encode(run(spark, sf_dir, long), **_SHORT)


def sound_chunks(spark, sf_dir):
    """Every third chunk's payload loses a bit; which chunks' checksums still hold."""
    rows = _chunks(spark, sf_dir)
    broken = F.when(F.col("chunk") % 3 == 0, F.concat(F.substring("payload", 1, 2), F.unhex(F.lit("00")), F.expr("substring(payload, 4)"))).otherwise(F.col("payload"))
    return rows.select("chunk", (F.crc32(broken) == F.col("crc")).alias("ok"))


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def size(self) -> int:
        return len(self.data)

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


def _files(spark, sf_dir) -> DataFrame:
    """(part, chunk, frames, payload): the stereo signal as streams of eight chunks, each small enough for a file in memory."""
    return _chunks(spark, sf_dir).select(F.expr("chunk div 8").alias("part"), "chunk", F.col("frames").cast("long"), "payload")


def _container(kernel: Callable[[container.File], list[tuple]], schema: str):
    """A query that builds each part's container, with header, metadata, digest and parity, and reads it by kernel."""

    def query(spark, sf_dir) -> DataFrame:
        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("chunk")
            payloads, counts = [bytes(p) for p in rows.payload], [int(n) for n in rows.frames]
            digest = hashlib.sha256()
            for p, n in zip(payloads, counts, strict=True):
                digest.update(container.pcm(codec.decode_chunk(p, n, 2, 32), 32))
            head = container.Header(2, 32, 44100, sum(counts), digest.digest()).to_bytes() + write_block(Metadata(["TITLE=events"]))
            body = b"".join(container.write_chunk(p, n) for p, n in zip(payloads, counts, strict=True))
            whole = bytearray(head + body + container.write_parity(payloads, counts, 2))
            whole[len(head) + 16 + 20] ^= 0x55  # the first chunk is damaged: parity mends it
            struct.pack_into("<I", whole, len(head) + 4, 0)  # and its header too: it is found by the table
            out = kernel(container.File(_Bytes(bytes(whole))))
            return pd.DataFrame([(int(key[0]), *r) for r in out], columns=[c.split()[0] for c in schema.split(", ")])

        return _files(spark, sf_dir).groupBy("part").applyInPandas(one, schema)

    return query


located = _container(lambda f: [(i, c.start, c.frames) for i, c in enumerate(f.chunks)], "part bigint, n bigint, start_frame bigint, frames bigint")
digests = _container(lambda f: [(f.header.digest.hex(), f.verify() is None)], "part bigint, sha256 string, ok boolean")
sought = _container(lambda f: [(t, int(x)) for t, x in zip(range(5000, 5010), f.samples(5000, 5010)[0] if f.header.frames >= 5010 else [], strict=False)], "part bigint, t bigint, x bigint")


def _floats(spark, sf_dir) -> DataFrame:
    """Bit patterns of x / 2**(t % 4), and at every 97th place one that is on no grid."""
    rows = _sig(spark, sf_dir)
    own = floats.pattern(F.col("x"), (F.col("t") % 4).cast("long"))
    odd = F.element_at(F.array(*(F.lit(v).cast("long") for v in _ODD)), (F.col("t") % 4 + 1).cast("int"))
    return rows.select(F.lit("events").alias("stream_id"), F.lit(0).alias("channel"), "t", F.when(F.col("t") % 97 == 0, odd).otherwise(own).alias("bits"))


#: Patterns of not-a-number, the infinities and -0.0.
_ODD = (0x7FC00000, 0x7F800000, 0xFF800000, 0x80000000)


def float_grid(spark, sf_dir):
    mapped, _ = floats.to_grid(_floats(spark, sf_dir))
    return mapped.select("t", "x", F.col("exception").isNotNull().alias("off"))


def float_scale(spark, sf_dir):
    return floats.to_grid(_floats(spark, sf_dir))[1].select("scale", F.col("bits").cast("long"))


def float_back(spark, sf_dir):
    mapped, info = floats.to_grid(_floats(spark, sf_dir))
    laid = mapped.where("exception is not null").select("stream_id", "channel", "t", F.col("exception").alias("bits"))
    back = floats.from_grid(mapped, info, laid).select("t", "bits")
    return back.join(_floats(spark, sf_dir).select("t", F.col("bits").alias("want")), "t").select("t", (F.col("bits") == F.col("want")).alias("same"))


_SHEET = "SELECT conv_id AS sheet_id, concat('CATALOG \"', conv_id, '\"\\r\\nFILE \"a.wav\" WAVE\\r\\n', array_join(transform(array_sort(collect_list(struct(track, start_frame))), x -> concat('  TRACK ', lpad(CAST(x.track + 1 AS STRING), 2, '0'), ' AUDIO\\r\\n    TITLE \"t\"\\r\\n    INDEX 00 ', {pre}, '\\r\\n    INDEX 01 ', {at})), '\\r\\n')) AS text FROM {tracks} GROUP BY conv_id"
_STAMP = "concat(lpad(CAST({f} div 4500 AS STRING), 2, '0'), ':', lpad(CAST({f} div 75 % 60 AS STRING), 2, '0'), ':', lpad(CAST({f} % 75 AS STRING), 2, '0'))"


def _sheets(spark, sf_dir, back: str = "0") -> DataFrame:
    at = "x.start_frame div 588"
    return run(spark, sf_dir, _SHEET.replace("{at}", _STAMP.replace("{f}", f"({at})")).replace("{pre}", _STAMP.replace("{f}", f"({at} + {back})")))


def cue_points(spark, sf_dir):
    return cue.parse(_sheets(spark, sf_dir), 48000).select("sheet_id", "catalog", "track", "point", "frame")


def cue_rejects(spark, sf_dir):
    """Sheets whose third track's pre-gap is said to start after it."""
    return cue.rejects(_sheets(spark, sf_dir, "CASE WHEN x.track = 2 THEN 5 ELSE 0 END"))


_HEX = "string_agg(format('{:02x}{:02x}{:02x}{:02x}', v & 255, (v >> 8) & 255, (v >> 16) & 255, (v >> 24) & 255), '' ORDER BY t, c)"
QUERIES = {
    "sq11_long_term": long_term, "sq12_long_term_back": long_term_back, "sq5_cross_term": cross_term, "sq7_adaptive_back": adaptive_back, "sq8_carried_back": carried_back,
    "sq13_map_values": map_values, "st12_detected_maps": detected_maps, "ag8_long_autocorrelation": long_autocorrelation, "fi4_sound_chunks": sound_chunks,
    "sc6_located_chunks": located, "ag16_stream_digest": digests, "sc10_sought_samples": sought, "pr10_float_grid": float_grid, "ag21_float_scale": float_scale, "jo5_float_overlay": float_back,
    "st1_cue_parse": cue_points, "st1_cue_rejects": cue_rejects,
}
_E = "SELECT t, coalesce(e, 0) AS e FROM {res1}"
ORACLES = {
    name: duckdb(text)
    for name, text in {
        "sq11_long_term": f"WITH g AS (SELECT t, e, lag(e, {_LAG + 1}) OVER w AS a, lag(e, {_LAG}) OVER w AS b, lag(e, {_LAG - 1}) OVER w AS c, row_number() OVER w AS n FROM (SELECT t, chunk, coalesce(e, 0) AS e FROM {{res1}}) WINDOW w AS (PARTITION BY chunk ORDER BY t)) SELECT t, CASE WHEN n > {_LAG + 1} THEN e - (({_TAPS[0]} * a + {_TAPS[1]} * b + {_TAPS[2]} * c + 16) >> 5) ELSE e END AS c FROM g",
        "sq12_long_term_back": _E, "sq7_adaptive_back": _E, "sq8_carried_back": _E,
        "sq5_cross_term": "WITH g AS (SELECT t, r, coalesce(lag(r) OVER w, r) AS a, coalesce(lead(r) OVER w, r) AS b FROM (SELECT t, chunk, r FROM {sig2}) WINDOW w AS (PARTITION BY chunk ORDER BY t)) SELECT t, (3 * a - 5 * r + 9 * b) >> 3 AS term FROM g",
        "sq13_map_values": f"SELECT t, least(greatest((x::HUGEINT * {_MAP[0]} + {_MAP[1]}) // 4294967296 - CASE WHEN (x::HUGEINT * {_MAP[0]} + {_MAP[1]}) < 0 AND (x::HUGEINT * {_MAP[0]} + {_MAP[1]}) % 4294967296 <> 0 THEN 1 ELSE 0 END, -8388608), 8388607)::BIGINT AS y FROM {{sig}}",
        "st12_detected_maps": "SELECT chunk, 3::BIGINT AS step, 2::BIGINT AS start FROM {sig} GROUP BY chunk",
        "ag8_long_autocorrelation": "WITH s AS (SELECT t, chunk, x // 16 AS x FROM {sig}) SELECT a.chunk, k.lag::BIGINT AS lag, coalesce(sum(a.x * b.x), 0)::BIGINT AS r FROM s a CROSS JOIN (VALUES (0), (1), (32), (100), (1000), (2047)) AS k(lag) LEFT JOIN s b ON a.chunk = b.chunk AND a.t - k.lag = b.t GROUP BY a.chunk, k.lag",
        "fi4_sound_chunks": "SELECT chunk, chunk % 3 <> 0 AS ok FROM {chunks}",
        "sc6_located_chunks": "SELECT chunk // 8 AS part, chunk % 8 AS n, start_frame - min(start_frame) OVER (PARTITION BY chunk // 8) AS start_frame, frames FROM {chunks}",
        "ag16_stream_digest": f"SELECT part, sha256(unhex({_HEX})) AS sha256, true AS ok FROM (SELECT chunk // 8 AS part, t, 0 AS c, l & 4294967295 AS v FROM {{sig2}} UNION ALL SELECT chunk // 8, t, 1, r & 4294967295 FROM {{sig2}}) GROUP BY part",
        "sc10_sought_samples": "SELECT chunk // 8 AS part, t - chunk // 8 * 32768 AS t, l AS x FROM {sig2} WHERE t - chunk // 8 * 32768 BETWEEN 5000 AND 5009",
        "pr10_float_grid": "SELECT t, CASE WHEN t % 97 = 0 THEN 0 ELSE x * (1 << (3 - t % 4)::INT) END::BIGINT AS x, t % 97 = 0 AS off FROM {sig}",
        "ag21_float_scale": "SELECT 3::BIGINT AS scale, (CASE WHEN max(abs(x * (1 << (3 - t % 4)::INT))) < 128 THEN 8 WHEN max(abs(x * (1 << (3 - t % 4)::INT))) < 32768 THEN 16 WHEN max(abs(x * (1 << (3 - t % 4)::INT))) < 8388608 THEN 24 ELSE 32 END)::BIGINT AS bits FROM {sig} WHERE t % 97 <> 0",
        "jo5_float_overlay": "SELECT t, true AS same FROM {sig}",
        "st1_cue_parse": "SELECT conv_id AS sheet_id, conv_id::VARCHAR AS catalog, (track + 1)::INTEGER AS track, k.point::INTEGER AS point, start_frame // 588 * 640 AS frame FROM {tracks} CROSS JOIN (VALUES (0), (1)) AS k(point)",
        "st1_cue_rejects": "SELECT conv_id AS sheet_id, 'backwards' AS reason FROM {tracks} WHERE track = 2",
    }.items()
}
