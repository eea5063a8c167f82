"""Identifiers and checksums of CD images."""

from __future__ import annotations

import base64
import hashlib
import zlib
from dataclasses import dataclass

import numpy as np

from .metadata import Metadata

# Frames of a sector, of the edges that the checksums leave out, and the tag keys.
SECTOR, EDGE, DISC_EDGE, LEAD_IN, SECOND, GAP = 588, 2940, 5880, 150, 75, 11400
KEYS = ("DISCID", "MUSICBRAINZ_DISCID", "ACCURATERIPID", "FAK_CD_TOC", "FAK_ACCURATERIP_V1", "FAK_ACCURATERIP_V2", "FAK_CTDB_CRC")
OWN_KEYS, MASK = KEYS[3:], 0xFFFFFFFF


@dataclass
class Contents:
    """A disc's table of contents: first sector of each track and whether it is audio, and the sector after the last."""

    starts: list[int]
    end: int
    data: frozenset[int] = frozenset()  # numbers of data tracks, from 0

    @classmethod
    def of(cls, m: Metadata, rate: int, frames: int) -> Contents | None:
        """Of a single-file image; None where a track or the end isn't at a whole sector."""
        places = [t.start for t in m.tracks] + [frames]
        if len(places) < 2 or any(at * SECOND % rate for at in places):
            return None
        *starts, end = (at * SECOND // rate for at in places)
        return cls(starts, end)

    @property
    def audio(self) -> list[int]:
        return [s for i, s in enumerate(self.starts) if i not in self.data]

    @property
    def audio_end(self) -> int:
        return self.starts[-1] - GAP if self.starts and len(self.starts) - 1 in self.data else self.end

    def frames(self, track: int) -> tuple[int, int]:
        """Range of an audio track, numbered from 1."""
        ends = [*self.audio[1:], self.audio_end]
        return self.audio[track - 1] * SECTOR, ends[track - 1] * SECTOR

    def sums(self) -> tuple[int, int]:
        """Sum of the starts, and their sum weighted by track number, with the end as one track more."""
        audio = [(i, s) for i, s in enumerate(self.starts) if i not in self.data]
        plain = sum(s for _, s in audio) + self.end
        weighted = sum(max(s, 1) * (i + 1) for i, s in audio) + self.end * (len(audio) + 1)
        return plain & MASK, weighted & MASK

    def digits(self) -> int:
        """Digit sums of the starts in seconds, the disc's seconds and its tracks."""
        n = sum(sum(map(int, str((s + LEAD_IN) // SECOND))) for s in self.starts)
        return n % 255 << 24 | self.end // SECOND - (self.starts[0] // SECOND if self.starts else 0) << 8 | len(self.starts)

    def path(self) -> str:
        a, b = self.sums()
        h = f"{a:08x}"
        return f"{h[7]}/{h[6]}/{h[5]}/dBAR-{len(self.audio):03d}-{a:08x}-{b:08x}-{self.digits():08x}.bin"

    def hashed(self) -> str:
        """SHA-1 of the offsets, in a base-64 alphabet that suits addresses."""
        offsets = [s + LEAD_IN for s in self.audio] + [0] * (99 - len(self.audio))
        text = f"{1:02X}{len(self.audio):02X}{self.audio_end + LEAD_IN:08X}" + "".join(f"{v:08X}" for v in offsets)
        return base64.b64encode(hashlib.sha1(text.encode()).digest(), b"._").decode().replace("=", "-")

    def text(self) -> str:
        return ":".join([*(f"{'-' * (i in self.data)}{s}" for i, s in enumerate(self.starts)), str(self.end)])


def packed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Stereo frames as 32-bit numbers, left in the low half."""
    if any(len(c) and (c.min() < -32768 or c.max() > 32767) for c in (left, right)):
        raise ValueError("not 16-bit samples")
    return (left & 0xFFFF).astype(np.uint64) | (right & 0xFFFF).astype(np.uint64) << np.uint64(16)


def track_sums(frames: np.ndarray, first: bool, last: bool) -> tuple[int, int]:
    """Sum of frame times place (from 1) over a track modulo 2**32, and the same plus the products' high halves. A disc's first and last tracks leave an edge out."""
    place = np.arange(1, len(frames) + 1, dtype=np.uint64)
    use = (place >= (EDGE if first else 0)) & (place <= (max(0, len(frames) - EDGE) if last else len(frames)))
    product = frames[use] * place[use]
    low = int((product & np.uint64(MASK)).sum(dtype=np.uint64)) & MASK
    return low, (low + int((product >> np.uint64(32)).sum(dtype=np.uint64))) & MASK


def disc_crc(frames: np.ndarray) -> int:
    """Checksum of a whole disc but its edges; 0 if it has nothing else."""
    tail = DISC_EDGE + len(frames) % DISC_EDGE
    return zlib.crc32(frames[DISC_EDGE : len(frames) - tail].astype("<u4").tobytes()) if len(frames) >= DISC_EDGE + tail else 0


def disc_tags(channels: np.ndarray, rate: int, bits: int, m: Metadata) -> dict[str, str] | None:
    """Tags of an exact image: 16-bit stereo at 44.1 kHz with every track at a whole sector; None otherwise."""
    if len(channels) != 2 or rate != 44100 or bits != 16 or (toc := Contents.of(m, rate, len(channels[0]))) is None:
        return None
    frames, n = packed(*channels), len(toc.audio)
    sums = [track_sums(frames[slice(*toc.frames(k))], k == 1, k == n) for k in range(1, n + 1)]
    a, b = toc.sums()
    whole = frames[toc.frames(1)[0] : toc.frames(n)[1]]
    values = (f"{toc.digits():08x}", toc.hashed(), f"{n:03d}-{a:08x}-{b:08x}-{toc.digits():08x}", toc.text(), *(" ".join(f"{s[i]:08x}" for s in sums) for i in (0, 1)), f"{disc_crc(whole):08x}")
    return dict(zip(KEYS, values, strict=True))


def apply_disc_tags(m: Metadata, channels: np.ndarray, rate: int, bits: int, keep: tuple[str, ...] = ()) -> None:
    """Replaces the disc tags that aren't kept by those of the audio and its cue sheet; none stay where it isn't an exact image."""
    kept = {k.lower() for k in keep}
    for k in KEYS:
        if k.lower() not in kept:
            m.replace(k, None)
    m.tags += [f"{k}={v}" for k, v in ((disc_tags(channels, rate, bits, m) if m.tracks else None) or {}).items() if k.lower() not in kept]


def drop_own_tags(m: Metadata, keep: tuple[str, ...] = ()) -> None:
    """Takes away the tags that only describe a table of contents, as when the sheet goes."""
    for k in OWN_KEYS:
        if k.lower() not in {x.lower() for x in keep}:
            m.replace(k, None)
