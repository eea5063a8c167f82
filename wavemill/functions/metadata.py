"""Metadata of a stream: tags, pictures, cue sheet, speaker mask, float side information; their block, and cue sheet text."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

# Fixed values of the format: bounds of a metadata block.
VENDOR, MOST_TAGS, MOST_TEXT, MOST_CODE, MOST_PICTURES, MOST_IMAGE, MOST_TRACKS, MOST_POINTS, MOST_EXCEPTIONS = "wavemill", 4096, 1 << 16, 64, 64, 64 << 20, 999, 100, 1 << 22
CD_RATE, SHEET = 75, "CUESHEET"
PICTURE_KINDS = {"other": 0, "front": 3, "back": 4, "artist": 8}
MIME = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg"}


@dataclass
class Picture:
    data: bytes
    mime: str = ""
    kind: int = 3
    description: str = ""
    shape: tuple[int, int, int, int] = (0, 0, 0, 0)  # width, height, depth, colours


@dataclass
class Track:
    number: int
    points: list[tuple[int, int]] = field(default_factory=list)  # index number, frame
    isrc: str = ""

    @property
    def start(self) -> int:
        return next(at for n, at in self.points if n == 1)


@dataclass
class Metadata:
    tags: list[str] = field(default_factory=list)
    pictures: list[Picture] = field(default_factory=list)
    catalog: str = ""
    tracks: list[Track] = field(default_factory=list)
    mask: int | None = None
    scale: int | None = None
    exceptions: list[tuple[int, int, int]] = field(default_factory=list)  # channel, frame, float bits
    vendor: str = VENDOR

    @property
    def empty(self) -> bool:
        return not (self.tags or self.pictures or self.tracks or self.mask is not None or self.scale is not None)

    def values(self, key: str) -> list[str]:
        """Values of a tag key, whatever its case."""
        return [t.split("=", 1)[1] for t in self.tags if "=" in t and t.split("=", 1)[0].lower() == key.lower()]

    def replace(self, key: str, value: str | None) -> None:
        """Takes a key's tags away, and adds one with the value if there is one."""
        self.tags = [t for t in self.tags if t.split("=", 1)[0].lower() != key.lower()] + ([] if value is None else [f"{key}={value}"])

    def sync(self, rate: int, frames: int | None, keep_untagged: bool = True) -> None:
        """Makes the cue sheet agree with the sheet's text in the tags, which counts where there is one; ValueError for a point past the end."""
        if text := self.values(SHEET):
            self.catalog, self.tracks = parse_sheet(text[0], rate)
        elif not keep_untagged:
            self.catalog, self.tracks = "", []
        check_points(self.tracks, frames)

    def sheet(self, rate: int, name: str) -> str | None:
        """The sheet's text: the tag's own, else one made from the points."""
        if text := self.values(SHEET):
            return text[0]
        return render_sheet(self.catalog, self.tracks, rate, name) if self.tracks else None

    def range(self, number: int, frames: int) -> tuple[int, int]:
        """First frame of a track and the first after it."""
        at = next((i for i, t in enumerate(self.tracks) if t.number == number), None)
        if at is None:
            raise ValueError(f"no track {number}")
        end = self.tracks[at + 1].start if at + 1 < len(self.tracks) else frames
        if not self.tracks[at].start <= end <= frames:
            raise ValueError(f"track {number} is out of range")
        return self.tracks[at].start, end


def check_points(tracks: list[Track], frames: int | None) -> None:
    if frames is not None and any(at > frames for t in tracks for _, at in t.points):
        raise ValueError("cue sheet: an index point is past the end of the audio")


def parse_sheet(text: str, rate: int) -> tuple[str, list[Track]]:
    """(catalog, tracks) of a cue sheet of one file; ValueError for one that can't describe a stream."""
    catalog, tracks, files = "", [], 0

    def number(s: str, most: int) -> int:
        if not (s.isascii() and s.isdigit()) or int(s) > most:
            raise ValueError(f"cue sheet: invalid number {s!r}")
        return int(s)

    for line in text.removeprefix("﻿").splitlines():
        words = line.split()
        if len(words) < 2:
            continue
        key, rest = words[0].upper(), line.strip()[len(words[0]) :].strip()
        if key == "CATALOG":
            catalog = rest.strip('"')
        elif key == "FILE":
            files += 1
        elif key == "TRACK":
            tracks.append(Track(number(words[1], 255)))
        elif key in ("ISRC", "INDEX") and not tracks:
            raise ValueError(f"cue sheet: {key} before any TRACK")
        elif key == "ISRC":
            tracks[-1].isrc = rest.strip('"')
        elif key == "INDEX":
            stamp = words[2].split(":", 2) if len(words) > 2 else []
            if len(stamp) != 3:
                raise ValueError(f"cue sheet: invalid INDEX line {line!r}")
            m, s, f = (number(x, (1 << 64) - 1) for x in stamp)
            at = ((m * 60 + s) * CD_RATE + f) * rate + CD_RATE // 2
            if at >= 1 << 64:
                raise ValueError("cue sheet: timestamp out of range")
            tracks[-1].points.append((number(words[1], 255), at // CD_RATE))
    if files > 1:
        raise ValueError("cue sheet: more than one FILE")
    if len(tracks) > MOST_TRACKS:
        raise ValueError("cue sheet: too many tracks")
    last, before = 0, 0
    for t in tracks:
        if t.number <= before or len(t.points) > MOST_POINTS or all(n != 1 for n, _ in t.points):
            raise ValueError(f"cue sheet: track {t.number} is out of order, too long or without INDEX 01")
        before = t.number
        for _, at in t.points:
            if at < last:
                raise ValueError(f"cue sheet: track {t.number} goes backwards")
            last = at
    return catalog, tracks


def stamp(frame: int, rate: int) -> str:
    cd = frame * CD_RATE // rate
    return f"{cd // CD_RATE // 60:02d}:{cd // CD_RATE % 60:02d}:{cd % CD_RATE:02d}"


def render_sheet(catalog: str, tracks: list[Track], rate: int, name: str) -> str:
    lines = [f"CATALOG {catalog}"] * bool(catalog) + [f'FILE "{name}" WAVE']
    for t in tracks:
        lines += [f"  TRACK {t.number:02d} AUDIO", *[f"    ISRC {t.isrc}"] * bool(t.isrc), *(f"    INDEX {n:02d} {stamp(at, rate)}" for n, at in t.points)]
    return "".join(f"{x}\r\n" for x in lines)


def picture_of(spec: str, data: bytes) -> Picture:
    """A picture from TYPE:PATH or PATH, by the path's extension; only PNG and JPEG."""
    head, _, rest = spec.partition(":")
    kind, path = (head, rest) if head in ("front", "back", "artist") else ("front", spec)
    mime = next((m for e, m in MIME.items() if path.lower().endswith(e)), None)
    if mime is None:
        raise ValueError(f"{path}: only .png, .jpg and .jpeg pictures")
    return Picture(data, mime, PICTURE_KINDS[kind])


def write_block(m: Metadata) -> bytes:
    """Length, body and checksum."""
    out: list[bytes] = []

    def text(s: str | bytes) -> None:
        raw = s.encode() if isinstance(s, str) else s
        out.append(struct.pack("<I", len(raw)) + raw)

    text(m.vendor)
    out.append(struct.pack("<I", len(m.tags)))
    for t in m.tags:
        text(t)
    out.append(struct.pack("<I", len(m.pictures)))
    for p in m.pictures:
        out.append(bytes([p.kind]))
        text(p.mime)
        text(p.description)
        out.append(struct.pack("<4I", *p.shape))
        text(p.data)
    text(m.catalog if m.tracks else "")
    out.append(struct.pack("<I", len(m.tracks)))
    for t in m.tracks:
        out.append(bytes([t.number]))
        text(t.isrc)
        out.append(struct.pack("<I", len(t.points)) + b"".join(struct.pack("<BQ", n, at) for n, at in t.points))
    out.append(struct.pack("<BI", m.mask is not None, m.mask or 0))
    out.append(bytes([m.scale is not None]))
    if m.scale is not None:
        out.append(struct.pack("<BI", m.scale, len(m.exceptions)) + b"".join(struct.pack("<IQI", *e) for e in m.exceptions))
    body = b"".join(out)
    read_body(body)  # whatever a reader would reject isn't written
    return struct.pack("<I", len(body)) + body + struct.pack("<I", zlib.crc32(body))


def read_body(body: bytes) -> Metadata:
    """Parses a block's body; ValueError where it ends early, goes on, or passes a bound."""
    at = 0

    def take(shape: str) -> tuple:
        nonlocal at
        if at + struct.calcsize(shape) > len(body):
            raise ValueError("metadata ends early")
        got = struct.unpack_from(shape, body, at)
        at += struct.calcsize(shape)
        return got

    def count(most: int, what: str) -> int:
        (n,) = take("<I")
        if n > most:
            raise ValueError(f"metadata: too many {what}")
        return n

    def raw(most: int) -> bytes:
        nonlocal at
        n = count(most, "bytes")
        if at + n > len(body):
            raise ValueError("metadata ends early")
        at += n
        return body[at - n : at]

    text = lambda most=MOST_TEXT: raw(most).decode("utf-8")
    m = Metadata(vendor=text())
    m.tags = [text() for _ in range(count(MOST_TAGS, "tags"))]
    for _ in range(count(MOST_PICTURES, "pictures")):
        (kind,) = take("<B")
        mime, description, shape = text(), text(), take("<4I")
        m.pictures.append(Picture(raw(MOST_IMAGE), mime, kind, description, shape))
    m.catalog = text(MOST_CODE)
    for _ in range(count(MOST_TRACKS, "tracks")):
        (number,) = take("<B")
        isrc = text(MOST_CODE)
        m.tracks.append(Track(number, [take("<BQ") for _ in range(count(MOST_POINTS, "index points"))], isrc))
    present, mask = take("<BI")
    floats = take("<B")[0]
    if present > 1 or floats > 1:
        raise ValueError("metadata: invalid flag")
    m.mask = mask if present else None
    if floats:
        (m.scale,) = take("<B")
        m.exceptions = [take("<IQI") for _ in range(count(MOST_EXCEPTIONS, "exceptions"))]
    if at != len(body):
        raise ValueError("metadata: bytes after its end")
    return m


def human_bytes(n: int) -> str:
    return f"{n / 1e6:.1f} MB" if n >= 10 << 20 else f"{n / 1e3:.1f} kB" if n >= 10_000 else f"{n} B"


def format_time(frames: int, rate: int) -> str:
    ms = frames * 1000 // max(1, rate)
    return f"{ms // 60_000}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"
