import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import floats, integer
from wavemill.sources import wav
from wavemill.streaming.residuals import write_residuals


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
@pytest.mark.parametrize("channels", [1, 2, 6])
def test_wav_round_trip(spark, tmp_path, bits, channels):
    spark.dataSource.register(wav.PcmWav)
    low, high, frames = -(1 << bits - 1), (1 << bits - 1) - 1, 1000
    x = np.random.default_rng(bits).integers(low, high, frames * channels, endpoint=True)
    x[: min(4, channels)] = [low, high, 0, -1][: min(4, channels)]
    rows = spark.createDataFrame([(int(i % channels), int(i // channels), int(v)) for i, v in enumerate(x)], "channel int, t long, x long")
    path = str(tmp_path / "a.wav")
    rows = rows.repartitionByRange(3, "t").sortWithinPartitions("t", "channel").select(F.lit("").alias("path"), "channel", "t", "x")
    rows.write.format("pcmwav").option("channels", channels).option("bits", bits).mode("append").save(path)
    back = spark.read.format("pcmwav").option("split", 300).load(path).orderBy("t", "channel").select("x").collect()
    assert [r[0] for r in back] == x.tolist()


def test_float_files_and_grid(spark, tmp_path):
    spark.dataSource.register(wav.PcmWav)
    x = np.round(8000 * np.sin(0.02 * np.arange(2000))).astype(np.float32) / np.float32(32768)
    x[[10, 20, 30, 40]] = [np.nan, np.inf, -np.inf, -0.0]
    bits = x.view(np.uint32).astype(np.int64)
    rows = spark.createDataFrame([("a", 0, int(t), int(b)) for t, b in enumerate(bits)], "path string, channel int, t long, x long")
    path = str(tmp_path / "f.wav")
    rows.repartitionByRange(3, "t").sortWithinPartitions("t", "channel").write.format("pcmwav").option("bits", 32).option("float", "true").mode("append").save(path)
    assert wav.layout(path).is_float
    back = spark.read.format("pcmwav").load(path)
    assert [r["x"] for r in back.orderBy("t").collect()] == bits.tolist()
    samples = back.select(F.lit("a").alias("stream_id"), "channel", "t", F.col("x").alias("bits"))
    mapped, info = floats.to_grid(samples)
    assert [tuple(r) for r in info.select("scale", "bits").collect()] == [(15, 16)]
    off = mapped.where("exception is not null").select("stream_id", "channel", "t", F.col("exception").alias("bits"))
    assert sorted(r["t"] for r in off.collect()) == [10, 20, 30, 40]
    again = floats.from_grid(mapped, info, off).orderBy("t").collect()
    assert [r["bits"] for r in again] == bits.tolist()
    assert sorted((r["t"]) for r in floats.rebased(off, 15, 20).collect()) == [5, 15]


@pytest.mark.parametrize("value,scale,k", [(0.0, 0, 0), (1.5, 1, 3), (-0.375, 3, -3), (3e9, 0, None), (2.0**-31, 31, 1), (2.0**-40, 40, None), (1e-45, 149, None), (8388607.5, 1, 16777215)])
def test_float_scales(spark, value, scale, k):
    bits = int(np.float32(value).view(np.uint32))
    c = F.lit(bits).cast("long")
    r = spark.range(1).select(floats.least_scale(c).alias("s"), floats.grid_value(c, F.lit(min(scale, 31)).cast("long")).alias("k")).first()
    assert (r["s"], r["k"]) == (scale, k)
    if k is not None:
        assert spark.range(1).select(floats.pattern(F.lit(k).cast("long"), F.lit(scale).cast("long")).alias("b")).first()["b"] == bits


@pytest.mark.parametrize("bits,values,raw", [(16, [1, -1], "0100ffff"), (24, [-8388608, 8388607], "000080ffff7f"), (8, [-128, 127], "00ff")])
def test_known_packings(bits, values, raw):
    assert wav.pack(np.array(values), bits).hex() == raw
    assert wav.unpack(bytes.fromhex(raw), bits).tolist() == values


def test_bad_files_are_rejected(tmp_path):
    good = wav.header(2, 44100, 16, 8) + bytes(8)
    for data in (b"", b"RIFF", b"not a wave file at all", good[:-1], good[:30]):
        p = tmp_path / "bad.wav"
        p.write_bytes(data)
        with pytest.raises(ValueError):
            wav.layout(str(p))


def test_integer_functions(spark):
    rows = spark.range(0, 2000).select((F.col("id") * 7919 % 4001 - 2000).alias("l"), (F.col("id") * 104729 % 3001 - 1500).alias("r"))
    s, m = integer.side(F.col("l"), F.col("r")), integer.mid(F.col("l"), F.col("r"))
    left = integer.left_of(m, s)
    bad = rows.where((left != F.col("l")) | (left - s != F.col("r")) | (integer.unzigzag(integer.zigzag(F.col("l"))) != F.col("l")))
    assert bad.count() == 0


def test_field_multiply(spark):
    def slow(a, b):
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = (a << 1) ^ (integer.FIELD if a & 0x8000 else 0), b >> 1
        return out

    pairs = [(0, 5), (1, 65535), (7, 9), (65535, 300), (2, 32768), (12345, 4096)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", integer.field_multiply(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["c"] for r in rows] == [slow(a, b) for a, b in pairs]


def test_streaming_residuals(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 0, [1, 4, 9, 16]), ("a", 1, [5, 5, 5])], "stream_id string, chunk int, samples array<bigint>").write.parquet(src)
    stream = spark.readStream.schema("stream_id string, chunk int, samples array<bigint>").parquet(src)
    write_residuals(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("chunk", "t").select("chunk", "t", "z").collect()
    assert [tuple(r) for r in got] == [(0, 2, 4), (0, 3, 4), (1, 2, 0)]
