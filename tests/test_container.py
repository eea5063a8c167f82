import dataclasses
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavemill.functions import disc, metadata
from wavemill.functions.metadata import Metadata, Picture, Track
from wavemill.operators import codec
from wavemill.sources import container, files

FROZEN = {"a": (2, 16, 30000, "normal", True), "b": (1, 24, 20000, "normal", False), "c": (2, 16, 12000, "fast", False), "d": (2, 8, 10000, "max", False)}


def signal(channels, bits, frames):
    """Sines, a ramp and noise of a shift register; each further channel follows the one before."""
    state, mask, noise = 0x9E3779B97F4A7C15 ^ frames, (1 << 64) - 1, []
    for _ in range(frames * channels):
        state ^= state << 13 & mask
        state ^= state >> 7
        state ^= state << 17 & mask
        noise.append(state % 2001)
    peak, t = ((1 << bits - 1) - 1) * 0.6, np.arange(frames)
    out = [np.rint((0.5 * np.sin(0.031 * t) + 0.3 * np.sin(0.0071 * t) + 0.15 * (t % 441 / 441 - 0.5) + 0.02 * (np.array(noise[:frames]) - 1000) / 1000) * peak).astype(np.int64)]
    for c in range(1, channels):
        out.append(np.rint(0.7 * out[-1] + 0.2 * np.append(0, out[-1][:-1])).astype(np.int64) + np.array(noise[c * frames : (c + 1) * frames]) % 7 - 3)
    return np.array(out)


def frame(spark, x, stream):
    rows = [pa.table({"stream_id": [stream] * x.shape[1], "channel": np.full(x.shape[1], c, np.int32), "t": np.arange(x.shape[1]), "x": x[c]}) for c in range(len(x))]
    return spark.createDataFrame(pa.concat_tables(rows).to_pandas())


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    spark.dataSource.register(container.Container)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    out = {}
    for name, (channels, bits, frames, level, fec) in FROZEN.items():
        folder = str(tmp_path_factory.mktemp(name))
        m = Metadata(tags=["TITLE=Frozen", "ARTIST=x", "CUESHEET=TRACK 01 AUDIO\nINDEX 01 00:00:00\nTRACK 02 AUDIO\nINDEX 01 00:00:10"], pictures=[Picture(b"png", "image/png")])
        x = signal(channels, bits, frames)
        spec = container.Spec(bits=bits, level=level, chunk_frames=4096, group=4 if fec else 0, m=2 if fec else 0, metadata={name: m})
        got = container.write(frame(spark, x, name), folder, spec).collect()
        assert [(r["stream_id"], r["frames"], r["channels"]) for r in got] == [(name, frames, channels)]
        out[name] = (got[0]["path"], x, got[0]["sha256"])
    return out


@pytest.mark.parametrize("name", FROZEN)
def test_round_trip_with_metadata_digest_and_seeking(spark, written, name):
    path, x, digest = written[name]
    back = spark.read.format("codedchunks").option("chunksPerTask", 2).load(path)
    got = np.array([[r[0] for r in back.where(F.col("channel") == c).orderBy("t").select("x").collect()] for c in range(len(x))])
    assert (got == x).all()
    with files.open_input(path) as f:
        held = container.File(f)
        assert held.verify() is None and held.header.digest.hex() == digest
        assert (held.samples(4000, 8300) == x[:, 4000:8300]).all() and held.at_frame(4096) == 1
        assert held.metadata.tags[:2] == ["TITLE=Frozen", "ARTIST=x"] and held.metadata.range(1, x.shape[1]) == (0, 5880)
        with pytest.raises(ValueError):
            held.at_frame(x.shape[1])
    row = spark.read.format("codedchunks").option("table", "streams").load(path).first()
    assert (row["channels"], row["bits"], row["frames"], row["chunks"], row["error"]) == (len(x), FROZEN[name][1], x.shape[1], -(-x.shape[1] // 4096), None)


def test_bounds_on_t_choose_the_chunks(spark, written):
    path, x, _ = written["a"]
    reader = container._Reader({"path": path, "chunksPerTask": "1"})
    list(reader.pushFilters([container.GreaterThanOrEqual(("t",), 5000), container.LessThan(("t",), 8192)]))
    assert [(p.first, p.last) for p in reader.partitions()] == [(1, 2)]
    got = spark.read.format("codedchunks").load(path).where("t >= 5000 and t < 5003 and channel = 1").orderBy("t").collect()
    assert [r["x"] for r in got] == x[1, 5000:5003].tolist()


def test_tables_of_metadata(spark, written):
    path = written["b"][0]
    table = lambda t: spark.read.format("codedchunks").option("table", t).load(path)
    assert [(r["key"], r["value"]) for r in table("tags").collect()][:2] == [("TITLE", "Frozen"), ("ARTIST", "x")]
    assert [tuple(r)[1:] for r in table("tracks").collect()] == [(1, "", 0, 5880), (2, "", 5880, 20000)]
    assert [bytes(r["data"]) for r in table("pictures").collect()] == [b"png"]
    assert table("exceptions").count() == 0 and table("chunks").where("sound").count() == 5


def raw(path):
    with open(files.place(path)[1], "rb") as f:
        return f.read()


def opened(data):
    return container.File(Buffer(data))


class Buffer:
    def __init__(self, data):
        self.data, self.at = data, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.at += n
        return self.data[self.at - n : self.at]


def test_damage_is_repaired_or_told(written):
    data, x = raw(written["a"][0]), written["a"][1]
    held = opened(data)
    for at in (held.chunks[0].at + 200, held.chunks[5].at + 9):
        broken = bytearray(data)
        broken[at] ^= 0x55
        fixed = opened(bytes(broken))
        assert fixed.verify() is None and (fixed.samples(0, 30000) == x).all()
    two = bytearray(data)
    for i in (0, 1):
        two[held.chunks[i].at + 3] ^= 1
    assert opened(bytes(two)).verify() is None
    three = bytearray(two)
    three[held.chunks[2].at + 3] ^= 1
    assert "lost" in opened(bytes(three)).verify()
    lost_header = bytearray(data)
    lost_header[held.chunks[2].at - container.CHUNK_BYTES] ^= 0xFF
    assert opened(bytes(lost_header)).verify() is None  # located by the tables of the parity blocks
    plain, other = bytearray(raw(written["c"][0])), opened(raw(written["c"][0]))
    plain[other.chunks[1].at + 5] ^= 1
    assert "checksum" in opened(bytes(plain)).verify()
    plain = bytearray(raw(written["c"][0]))
    plain[other.chunks[1].at - 16] ^= 1
    with pytest.raises(ValueError):
        opened(bytes(plain))


@pytest.mark.parametrize("version", [0, 1, 20, 22, 255])
def test_other_versions_are_rejected(written, version):
    data = bytearray(raw(written["c"][0]))
    data[4] = version
    data[52:56] = struct.pack("<I", zlib.crc32(bytes(data[4:52])))
    with pytest.raises(ValueError, match="version"):
        opened(bytes(data))


def test_hostile_files_raise_only_value_errors(written):
    rng = np.random.default_rng(1)
    data = raw(written["a"][0])
    for i in range(400):
        broken = bytearray(data[: rng.integers(len(data))] if i % 2 else data)
        for _ in range(rng.integers(0, 4)):
            if broken:
                broken[rng.integers(min(len(broken), 400 if i % 3 else len(broken)))] ^= 1 << rng.integers(8)
        try:
            opened(bytes(broken))
        except (ValueError, UnicodeDecodeError):
            pass
    for cut in range(0, 400, 7):
        with pytest.raises((ValueError, struct.error)):
            opened(data[:cut])


def test_verify_and_permissive_reading(spark, written, tmp_path):
    for n, (path, _, _) in written.items():
        (tmp_path / f"{n}.fak").write_bytes(raw(path))
    bad = bytearray(raw(written["c"][0]))
    bad[-3] ^= 1
    (tmp_path / "e.fak").write_bytes(bytes(bad))
    (tmp_path / "f.fak").write_bytes(b"no such thing")
    got = {r["path"][-5:]: (r["ok"], r["reason"]) for r in container.verify(spark, str(tmp_path)).collect()}
    assert [got[f"{n}.fak"][0] for n in "abcdef"] == [True] * 4 + [False] * 2
    rows = spark.read.format("codedchunks").option("table", "streams").option("mode", "permissive").load(str(tmp_path)).collect()
    assert sorted((r["path"][-5:], r["error"] is None) for r in rows) == [(f"{n}.fak", n != "f") for n in "abcdef"]


def test_metadata_changes_leave_audio_bytes(written, tmp_path):
    path = written["b"][0]

    def change(m, header):
        m.replace("title", "New")
        m.replace(metadata.SHEET, "TRACK 01 AUDIO\nINDEX 01 00:00:01")
        m.sync(header.rate, header.frames)

    target = str(tmp_path / "x.fak")
    container.rewrite_metadata(path, target, change)
    a, b = opened(raw(path)), opened(raw(target))
    assert b.metadata.values("TITLE") == ["New"] and [t.points for t in b.metadata.tracks] == [[(1, 588)]]
    assert raw(path)[a.payload_start :] == raw(target)[b.payload_start :] and b.verify() is None
    with pytest.raises(ValueError):
        container.rewrite_metadata(path, target, lambda m, h: m.tracks.append(Track(9, [(1, 10**9)])))


def test_streams_come_chunk_by_chunk_and_must_end_at_one():
    out = pa.BufferOutputStream()
    w = container.StreamWriter(out, 2, 16, 44100)
    parts = []
    for i in range(6):
        t = np.arange(3000 + 91 * i)
        parts.append([(9000 * np.sin(0.013 * t)).astype(np.int64) + np.random.default_rng(s + i).integers(-150, 151, len(t)) for s in (100, 900)])
        w.push(parts[-1])
    data = out.getvalue().to_pybytes()
    fed = []

    def feed(source):
        def read(n):
            part = source.read(min(n, 1000))
            fed.append(len(part))
            return part

        return read

    import io

    stream = container.read_stream(feed(io.BytesIO(data)))
    assert not next(stream).known and next(stream).empty
    before = sum(fed)
    for p in parts:
        assert (next(stream) == np.array(p)).all()
        assert sum(fed) > before
        before = sum(fed)
    assert next(stream, None) is None
    ends = {len(data)}
    held = opened(data)
    ends |= {c.at - 16 for c in held.chunks}
    for cut in [*range(60, len(data), 997), *ends]:
        got = container.read_stream(io.BytesIO(data[:cut]).read)
        if cut in ends:
            assert len(list(got)) >= 2
        else:
            with pytest.raises(ValueError):
                list(got)


SHEET = '﻿CATALOG "123"\r\nFILE "a.wav" WAVE\r\n  TRACK 01 AUDIO\r\n    TITLE "x"\r\n    ISRC AB123\r\n    INDEX 01 00:00:00\r\n  TRACK 02 AUDIO\r\n    INDEX 01 00:02:00\r\n  TRACK 03 AUDIO\r\n    INDEX 00 00:03:50\r\n    INDEX 01 00:04:00\r\n'


def test_cue_sheets():
    catalog, tracks = metadata.parse_sheet(SHEET, 44100)
    assert catalog == "123" and [(t.number, t.isrc, t.points) for t in tracks] == [(1, "AB123", [(1, 0)]), (2, "", [(1, 88200)]), (3, "", [(0, 161700), (1, 176400)])]
    m = Metadata(tracks=tracks, catalog=catalog)
    assert [m.range(n, 264600) for n in (1, 2, 3)] == [(0, 88200), (88200, 176400), (176400, 264600)]
    again = metadata.parse_sheet(m.sheet(44100, "a.wav"), 44100)
    assert again == (catalog, tracks)
    for bad in ("FILE a\nFILE b\n", "TRACK x AUDIO\n", "INDEX 01 00:00:00\n", "TRACK 01 AUDIO\n", "TRACK 02 A\nINDEX 01 0:0:0\nTRACK 01 A\nINDEX 01 0:0:1\n", "TRACK 01 A\nINDEX 01 0:0:5\nINDEX 02 0:0:1\n", "TRACK 01 A\nINDEX 01 99999999999999999:00:00\n", "TRACK 01 A\nINDEX 01 0:0\n"):
        with pytest.raises(ValueError):
            metadata.parse_sheet(bad, 44100)
    m.tags.append("cuesheet=TRACK 01 AUDIO\nINDEX 01 00:00:10")
    m.sync(44100, 10000)
    assert [t.points for t in m.tracks] == [[(1, 5880)]]
    m.replace("CUESHEET", None)
    m.sync(44100, 10000, keep_untagged=False)
    assert m.tracks == []


def test_metadata_blocks():
    m = Metadata(["A=1", "a=2", "x"], [Picture(b"123", "image/png", 4, "d", (1, 2, 3, 4))], "77", [Track(1, [(0, 5), (1, 9)], "I")], 0, 15, [(1, 2, 3)])
    block = metadata.write_block(m)
    assert metadata.read_body(block[4:-4]) == m and m.values("a") == ["1", "2"] and Metadata().empty and not m.empty
    for cut in range(len(block) - 9):
        with pytest.raises((ValueError, UnicodeDecodeError)):
            metadata.read_body(block[4 : 4 + cut])
    with pytest.raises(ValueError):
        metadata.write_block(dataclasses.replace(m, catalog="9" * 65))
    assert metadata.picture_of("back:c.JPG", b"") == Picture(b"", "image/jpeg", 4) and metadata.picture_of("C:/x.png", b"").kind == 3
    with pytest.raises(ValueError):
        metadata.picture_of("a.webp", b"")
    assert [metadata.human_bytes(n) for n in (9999, 10_000, 20_000_000)] == ["9999 B", "10.0 kB", "20.0 MB"] and metadata.format_time(44100 * 61 + 441, 44100) == "1:01.010"


STARTS = [0, 15537, 31691, 50866, 66466, 81202, 99409, 115920, 133093, 149847, 161560, 177682, 207106]


def test_disc_identifiers_by_known_answers():
    toc = disc.Contents(STARTS, 210385, frozenset({12}))
    assert toc.sums() == (0x0013BD5A, 0x00B8D489) and toc.digits() == 0xC60AF50D
    assert toc.path() == "a/5/d/dBAR-012-0013bd5a-00b8d489-c60af50d.bin"
    assert toc.hashed() == "KnpGsLhvH.lPrNc1PBL21lb9Bg4-"
    assert toc.text() == ":".join(map(str, STARTS[:-1])) + ":-207106:210385"
    assert disc.Contents([0, 15213, 32164, 46442, 63264, 80339], 95312).hashed() == "49HHV7Eb8UKF3aQiNmu1GR8vKTY-"


def test_disc_checksums_leave_the_edges_out():
    f = np.arange(10_000, dtype=np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32)

    def direct(a, b):
        low = sum(int(v) * p & 0xFFFFFFFF for p, v in enumerate(f, 1) if a <= p <= b)
        return low & 0xFFFFFFFF, low + sum(int(v) * p >> 32 for p, v in enumerate(f, 1) if a <= p <= b) & 0xFFFFFFFF

    for first, last, a, b in ((0, 0, 0, 10_000), (1, 0, 2940, 10_000), (0, 1, 0, 7060), (1, 1, 2940, 7060)):
        assert disc.track_sums(f, first, last) == direct(a, b)


def test_disc_tags():
    m = Metadata(tracks=[Track(n, [(1, s * 588)]) for n, s in ((1, 0), (2, 30), (3, 70))])
    i = np.arange(100 * 588)
    x = np.array([i * 7919 % 65536 - 32768, i * 104729 % 65536 - 32768])
    tags = disc.disc_tags(x, 44100, 16, m)
    assert tags["FAK_CD_TOC"] == "0:30:70:100" and tags["ACCURATERIPID"] == f"003-{disc.Contents([0, 30, 70], 100).path()[15:41]}"
    f = disc.packed(*x)
    assert tags["FAK_ACCURATERIP_V2"].split()[1] == f"{disc.track_sums(f[30 * 588 : 70 * 588], False, False)[1]:08x}"
    assert tags["FAK_CTDB_CRC"] == f"{zlib.crc32(f[5880 : 58800 - 5880].astype('<u4').tobytes()):08x}"
    assert disc.disc_tags(x, 48000, 16, m) is None and disc.disc_tags(x, 44100, 24, m) is None and disc.disc_tags(x[:, 1:], 44100, 16, m) is None
    m.tags = ["discid=mine", "FAK_CD_TOC=old"]
    disc.apply_disc_tags(m, x, 44100, 16, keep=("DISCID",))
    assert m.values("DISCID") == ["mine"] and m.values("fak_cd_toc") == ["0:30:70:100"] and len(m.tags) == 7
    disc.drop_own_tags(m)
    assert not m.values("FAK_CD_TOC") and m.values("DISCID")


def test_every_level_is_read(spark, tmp_path):
    for level in codec.LEVELS:
        x = signal(2, 16, 5000)
        got = container.write(frame(spark, x, level), str(tmp_path), container.Spec(level=level, chunk_frames=2500)).first()
        assert opened(raw(got["path"])).verify() is None
