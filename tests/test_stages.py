import numpy as np
import pytest

from wavemill.functions.bits import Reader
from wavemill.operators import codec, predict, stages

RNG = np.random.default_rng(11)


def music(n, seed=0):
    t = np.arange(n)
    rng = np.random.default_rng(seed)
    return (6000 * np.sin(0.031 * t) + 3000 * np.sin(0.0071 * t + seed) + rng.normal(0, 60, n)).astype(np.int64)


def size(channels, bits, level):
    payload = codec.encode_chunk(channels, bits, level)
    assert (codec.decode_chunk(payload, len(channels[0]), len(channels), bits) == np.array(channels)).all()
    return len(payload)


LEFT = music(9000)
PULSE = np.tile(RNG.integers(-3000, 3000, 300), 30)[:9000] + RNG.integers(-3, 4, 9000)
SIGNALS = {
    "pair": (16, [LEFT, (0.7 * LEFT + 0.2 * np.append(0, LEFT[:-1])).astype(np.int64) + RNG.integers(-3, 4, 9000)]),
    "repeating": (16, [PULSE]),
    "square": (16, [np.where(np.arange(9000) // 220 % 2, 9000, -9000)]),
    "lattice": (24, [3 * LEFT + 1, 256 * LEFT + 128]),
    "clipped lattice": (16, [np.clip(5 * music(5000, 2) + 2, -32768, 32767)]),
    "deep": (32, [RNG.integers(-(1 << 30), 1 << 30, 5000), music(5000) << 14]),
    "six": (16, [music(3000, s) for s in range(6)]),
    "short": (8, [np.array([5, -128, 127])]),
    "same": (16, [LEFT, LEFT]),
}


@pytest.mark.parametrize("level", codec.LEVELS)
@pytest.mark.parametrize("name", SIGNALS)
def test_round_trip_at_every_level(name, level):
    bits, channels = SIGNALS[name]
    n = 3000 if level == "insane" else 9000
    size([c[:n] for c in channels], bits, level)


def test_each_stage_pays_where_it_should():
    raw = {k: len(c) * len(c[0]) * b // 8 for k, (b, c) in SIGNALS.items()}
    assert size(SIGNALS["square"][1], 16, "normal") * 8 < 0.1 * 9000  # runs: well under one bit a sample
    assert size(SIGNALS["repeating"][1], 16, "normal") < 0.8 * size(SIGNALS["repeating"][1], 16, "fast")
    assert size(SIGNALS["lattice"][1], 24, "normal") < 0.9 * size(SIGNALS["lattice"][1], 24, "fast")
    assert size(SIGNALS["pair"][1], 16, "normal") < size(SIGNALS["pair"][1], 16, "fast") < 0.6 * raw["pair"]
    two = [RNG.choice([-7, 9001], 8000)]
    assert size(two, 16, "normal") * 8 / 8000 < 1.03


@pytest.mark.parametrize("taps,k,s", [(16, 4, 0), (32, 5, -3), (256, 7, 4)])
def test_adaptive_stage_inverts(taps, k, s):
    r = music(2000) // 8
    e = stages.adapt(r, taps, k, s, False)
    assert (stages.adapt(e, taps, k, s, True) == r).all() and (e != r).any()


def test_carried_filter_inverts_across_subframes():
    a, b, c = stages.Carried(512, 8), stages.Carried(512, 8), music(1500) // 16
    for part in (c[:700], c[700:701], c[701:]):
        s = stages.shift_for(part)
        assert (b.run(a.run(part, s, False), s, True) == part).all()
        a.skip(part)
        b.skip(part)
    assert (a.w == b.w).all() and a.past == b.past and a.avg == b.avg


def test_long_term_prediction_against_its_formula():
    e = PULSE[:2500].copy()
    for lag, g in [(300, [20, -3, 4]), (32, [1] * 9), (40, [-64])]:
        h, want = len(g) // 2, e.copy()
        for n in range(lag + h, len(e)):
            want[n] = e[n] - ((sum(v * int(e[n - lag - h + j]) for j, v in enumerate(g)) + 16) >> 5)
        c = stages.long_encode(e, lag, g)
        assert (c == want).all() and (stages.long_decode(c, lag, g) == e).all()
    assert stages.long_search(e)[0][0] % 300 == 0


def test_autocorrelation_by_transform():
    x = music(700)
    assert np.allclose(stages.autocorrelation(x, 40), [float((x[j:] * x[: len(x) - j]).sum()) for j in range(41)], rtol=1e-9, atol=1)


def test_cross_term_against_its_formula():
    src, c = music(50), [3, -5, 9]
    want = [sum(v * int(src[min(max(t - 2 + k, 0), 49)]) for k, v in enumerate(c)) >> 3 for t in range(50)]
    assert stages.cross_term(src, -2, c, 3).tolist() == want


def test_value_maps():
    m = stages.ValueMap(int(1.37 * 2**32), 5 << 30, {3: -2, 9: 7})
    k = np.arange(-40, 60)
    plain = [max(-32768, min(32767, ((int(v) * m.p + m.c) >> 32) + m.fixes.get(i, 0))) for i, v in enumerate(k)]
    assert m.apply(k, 16).tolist() == plain
    raw = stages.write_maps([None, m])
    (none, back), end = stages.read_maps(raw + b"rest", 2, 100)
    assert none is None and end == len(raw) and (back.p, back.c, back.fixes) == (m.p, m.c, m.fixes)
    assert stages.detect(music(500), 16) is None and stages.detect(4 * music(500), 16) is None
    found = stages.detect(3 * music(500) + 128, 24)
    assert (found.p, found.c) == (3 << 32, (128 % 3) << 32)
    for bad in (b"\2", b"\1\0\0", b"\1\3", b"\1\1" + bytes(16), raw[:-1]):
        with pytest.raises(ValueError):
            stages.read_maps(bad, 2, 100)


def test_levinson_solves_the_normal_equations():
    x = music(4000) * predict.window("tukey", 4000)
    r = np.array([x[: len(x) - j] @ x[j:] for j in range(9)])
    r[0] *= 1 + 1e-6
    for a, error in predict.levinson(r, 8):
        m = len(a)
        t = r[np.abs(np.subtract.outer(np.arange(m), np.arange(m)))]
        assert np.allclose(t @ a, r[1 : m + 1], rtol=1e-4, atol=abs(r[0]) * 1e-9)
        assert error == pytest.approx(r[0] - a @ r[1 : m + 1], rel=1e-3)


def test_windows():
    assert predict.window("hann", 4).tolist() == pytest.approx([0.1464466, 0.8535534, 0.8535534, 0.1464466])
    assert predict.window("welch", 2).tolist() == [0.75, 0.75] and predict.window("none", 3).tolist() == [1, 1, 1]
    assert predict.window("tukey", 8)[2:6].tolist() == [1, 1, 1, 1]


def test_quantised_error_is_fed_back():
    q, shift = predict.quantise(np.array([0.3, 0.3, 0.3, 0.3]), 4)
    assert shift == 4 and abs(q.sum() - 0.3 * 4 * 16) <= 0.5


def test_hostile_payloads_raise_only_value_errors():
    for level in ("normal", "insane"):
        whole = codec.encode_chunk([c[:1200] for c in SIGNALS["pair"][1]], 16, level)
        for i in range(150):
            raw = bytearray(whole)
            raw[RNG.integers(len(raw))] ^= 1 << RNG.integers(8)
            try:
                codec.decode_chunk(bytes(raw[: RNG.integers(len(raw)) if i % 2 else None]), 1200, 2, 16)
            except ValueError:
                pass


def test_reader_fields():
    r = Reader(bytes([0b10110011, 0b01000000]))
    assert r.fields(3, 3).tolist() == [0b101, 0b100, 0b110] and r.signed_fields(2, 2).tolist() == [-2, 0]
    assert r.ones[13:] == [16, 16, 16]
