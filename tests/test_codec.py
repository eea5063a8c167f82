import zlib

import numpy as np
import pytest

from wavemill.functions.bits import Reader, Writer, rice_decode, rice_encode
from wavemill.operators import codec, parity

RNG = np.random.default_rng(5)


def tone(n, c=0):
    t = np.arange(n)
    return (8000 * np.sin(0.031 * t * (1 + c / 2)) + RNG.integers(-40, 40, n)).astype(np.int64)


@pytest.mark.parametrize("values", [[0], [-1], [5] * 40, [1 << 40, 0, -3] * 50, list(RNG.integers(-9, 9, 3000)), list(RNG.integers(-(1 << 20), 1 << 20, 100)) + [0] * 900])
def test_rice_round_trip(values):
    w = rice_encode(np.array(values))
    assert rice_decode(Reader(w.to_bytes()), len(values)).tolist() == [int(v) for v in values]


def test_bit_fields():
    w = Writer()
    w.put([5, 1, 0], [3, 70, 2])
    r = Reader(w.to_bytes())
    assert (r.get(3), r.unary(), r.get(2)) == (5, 69, 0)
    with pytest.raises(ValueError):
        r.get(99)


SIGNALS = {
    "tone": (16, [tone(9000)]),
    "stereo": (16, [tone(9001), tone(9001, 1)]),
    "mirror": (16, [tone(4096), -tone(4096)]),
    "constant": (8, [np.full(700, -128)]),
    "palette": (24, [RNG.choice([-7, 0, 90001], 5000)]),
    "wasted": (16, [tone(5000) * 4]),
    "noise": (32, [RNG.integers(-(1 << 31), 1 << 31, 4500) for _ in range(2)]),
    "extremes": (8, [np.array([-128, 127] * 300), np.array([127, -128] * 300), np.zeros(600, np.int64)]),
    "one": (16, [np.array([-5]), np.array([7])]),
}


@pytest.mark.parametrize("name", SIGNALS)
def test_chunk_round_trip(name):
    bits, channels = SIGNALS[name]
    payload = codec.encode_chunk(channels, bits)
    assert (codec.decode_chunk(payload, len(channels[0]), len(channels), bits) == np.array(channels)).all()


def test_prediction_pays():
    assert len(codec.encode_chunk([tone(8192)], 16)) < 8192 * 2 * 0.6


def test_hostile_payloads_raise_only_value_errors():
    whole = codec.encode_chunk([tone(600)], 16)
    for i in range(300):
        raw = bytearray(whole)
        raw[RNG.integers(len(raw))] ^= 1 << RNG.integers(8)
        try:
            codec.decode_chunk(bytes(raw[: RNG.integers(len(raw)) if i % 2 else None]), 600, 1, 16)
        except ValueError:
            pass


def test_spark_round_trip_and_repair(spark):
    rows = [("a", c, t, int(x)) for c in range(2) for t, x in enumerate(tone(2500, c))]
    df = spark.createDataFrame(rows, "stream_id string, channel int, t long, x long")
    chunks = codec.encode(df, 16, 512)
    kept = [r.asDict() for r in chunks.collect()]
    again = spark.createDataFrame(kept, chunks.schema)
    assert sorted(map(tuple, codec.decode(again).collect())) == rows
    shield = parity.protect(again, 4, 2)
    broken = [dict(r, payload=bytearray(b"x") if r["chunk"] == 1 else r["payload"]) for r in kept if r["chunk"] != 2]
    fixed = parity.repair(spark.createDataFrame(broken, chunks.schema), shield, 4).collect()
    assert {(r.chunk, bytes(r.payload)) for r in fixed} == {(r["chunk"], bytes(r["payload"])) for r in kept}
    assert {r.chunk for r in fixed if r.rebuilt} == {1, 2}


def test_recover_needs_as_many_shards_as_losses():
    payloads = [bytes(RNG.integers(0, 256, n, np.uint8)) for n in (5, 100, 33, 8)]
    made = parity.shards(payloads, 3)
    got = parity.recover([None, payloads[1], None, None], [5, 100, 33, 8], dict(enumerate(made)))
    assert [zlib.crc32(g) for g in got] == [zlib.crc32(p) for p in payloads]
    with pytest.raises(ValueError):
        parity.recover([None, payloads[1], None, None], [5, 100, 33, 8], {0: made[0]})
