"""Times the headline queries; prints one JSON line."""

import json
import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wavemill.operators import codec
from wavemill.plans import registry

#: Seconds of made stereo audio that the codec is timed on, its rate, and frames of a chunk.
AUDIO, RATE, CHUNK = 600, 44100, 45056

HEADLINE = ["wi1_fixed_residual", "ag5_rice_estimate", "tk1_min_plan", "tk2_stereo_mode", "tk4_partition_size", "tk8_rice_parameter", "ag7_autocorrelation", "ag9_normal_equations", "wi6_rle_runs", "jo1_stereo_pair", "jo3_track_cut", "ag18_track_checksum"]


def audio(batches):
    """A row a chunk: two tones with noise, the right channel close to the left."""
    ints = pa.list_(pa.int64())
    kind = pa.list_(pa.struct([("channel", pa.int32()), ("t0", pa.int64()), ("t1", pa.int64()), ("xs", ints)]))
    for b in batches:
        for k in b.column(0).to_pylist():
            t = np.arange(CHUNK) + k * CHUNK
            rng = np.random.default_rng(k)
            left = (6000 * np.sin(0.031 * t) + 3000 * np.sin(0.0071 * t) + rng.normal(0, 60, CHUNK)).astype(np.int64)
            right = (0.7 * left).astype(np.int64) + rng.integers(-30, 30, CHUNK)
            row = [{"channel": c, "t0": int(t[0]), "t1": int(t[-1]), "xs": x} for c, x in enumerate((left, right))]
            yield pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([k], pa.int64()), pa.array([row], kind)], names=["stream_id", "chunk", "c"])


def codec_speed(spark: SparkSession, level: str) -> dict[str, float]:
    """Times real time of encoding and decoding AUDIO seconds, and the coded size against verbatim samples."""
    n = -(-AUDIO * RATE // CHUNK)
    made = spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(audio, "stream_id string, chunk bigint, c array<struct<channel:int,t0:bigint,t1:bigint,xs:array<bigint>>>").persist()
    made.count()
    t = time.time()
    coded = codec.encode_blocks(made, 16, CHUNK, level).persist()
    size = coded.agg(F.sum(F.length("payload"))).first()[0]
    there, t = time.time() - t, time.time()
    codec.decode_blocks(coded).write.format("noop").mode("overwrite").save()
    back = time.time() - t
    for df in (coded, made):
        df.unpersist()
    seconds = n * CHUNK / RATE
    return {f"encode_{level}_x_realtime": round(seconds / there, 1), f"decode_{level}_x_realtime": round(seconds / back, 1), f"size_{level}_of_verbatim": round(size / (n * CHUNK * 4), 3)}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = []
        for _ in range(2):
            t = time.time()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best.append(time.time() - t)
        took[name] = round(min(best), 3)
    total = sum(took.values())
    speed = codec_speed(spark, "fast") | codec_speed(spark, "normal")
    samples = spark.read.parquet(f"{sf}/events.parquet").count()
    print(json.dumps({"metric": "headline queries, total", "value": round(total, 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "fixed_residual_x_realtime_44100": round(samples / 44100 / took["wi1_fixed_residual"], 1)} | speed))
    spark.stop()


if __name__ == "__main__":
    main()
