"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice, Viterbi scores guiding a backward A* search."""

from __future__ import annotations

import functools
import gc
import heapq
import itertools
import math
import operator
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table

SPACE = "▁"
#: Segmentations of a text that are returned.
BEST = 4
#: Words whose losses a worker keeps, and words whose lists of segmentations it keeps.
CACHE, LISTS = 500_000, 30_000
#: Rank sum up to which two pieces in place of a word's own are found by look-up.
USUAL = 36
#: Cost of a character without a piece, in a departure from the model's own segmentation; it is written as its bytes.
UNKNOWN = 2.0
_NEVER, _EVER, _place = -math.inf, math.inf, operator.itemgetter(0)
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Pieces:
    """Lattice search for one model.

    Every piece of the model that stands in a text is an arc of its lattice. A merge-trained model's scores are the ranks
    of its merges, and no sum of them gives its segmentations; so arcs of the segmentation that the model's own library
    gives score 0, any other arc -1 less its rank's share of the vocabulary. The best path is then the library's, with
    score 0, and the next ones leave it in the fewest and most usual pieces. Of equal sums the first in order of expansion
    comes first. Given bare scores instead of a file, arcs score just those.
    """

    def __init__(self, path: str | None = None, scores: dict[str, float] | None = None):
        """From a model file, or from pieces and scores (ids in order), as tests do."""
        self.byte, self.sp, self.size, self.byte_ids = {}, None, [], set()
        if path is not None:
            from sentencepiece import SentencePieceProcessor

            self.sp = sp = SentencePieceProcessor(model_file=path)
            names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
            usable = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
            self.byte = {int(names[i][3:5], 16): i for i in range(len(names)) if sp.is_byte(i)}
            self.value = {i: b for b, i in self.byte.items()}
            self.byte_ids = set(self.value)
            rank = {i: r for r, i in enumerate(sorted(usable, key=lambda i: (-sp.get_score(i), i)))}
            self.score = {names[i]: -1.0 - rank[i] / len(names) for i in usable}
            rank_of = {names[i]: r for i, r in rank.items()}
            self.id = {names[i]: i for i in usable}
            self.unk, self.unknown = sp.unk_id(), -UNKNOWN
            # characters that an id stands for: a byte that continues a character adds none
            self.size = [0 if 0x80 <= self.value.get(i, 0) < 0xC0 else 1 if i in self.value or i == sp.unk_id() else len(names[i]) for i in range(len(names))]
        else:
            names, self.score = list(scores), dict(scores)
            self.id, self.unk = {p: i for i, p in enumerate(names)}, len(names)
            self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.name = names
        self.find = ahocorasick.Automaton()
        for piece, value in self.score.items():
            self.find.add_word(piece, (len(piece) - 1, value))
        self.find.make_automaton()
        self.longest = max(map(len, self.score), default=1)
        self.single = {p for p in self.score if len(p) == 1}
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.bound = 2 + (USUAL + 0.5) / len(names)
        if path is not None:
            self.spans(list(rank_of)[: USUAL + 1])
        self.whole: dict[str, float] = {}  # losses
        self.lists: dict[tuple[str, int], list] = {}

    def spans(self, usual: list[str]) -> None:
        """Tables of the slight departures (a loss up to `bound`): one piece over several of the library's, or two of the most usual pieces over any.

        Both are strings over whole pieces of the library's, so they are walked piece by piece: a node is the start of
        such a string, and a node and the next id give the next node, if any.
        """
        rank = {p: r for r, p in enumerate(usual)}
        two: dict[str, float] = {}
        for (a, x), (b, y) in itertools.product(rank.items(), repeat=2):
            if x + y <= USUAL:
                two[a + b] = min(two.get(a + b, _EVER), -(self.score[a] + self.score[b]))
        self.dense = len({c for p in self.score for c in p} - self.single) == 0
        node: dict[str, int] = {}
        step: dict[int, int] = {}
        size, number = len(self.name), self.id.get
        for w in (*self.score, *two):
            at = [node.setdefault(w[:i], len(node)) for i in range(1, len(w) + 1)]
            for i in range(1, len(w)):
                for j in range(i + 1, len(w) + 1):
                    n = number(w[i:j])
                    if n is not None:
                        step[at[i - 1] * size + n] = at[j - 1]
        self.keys = np.array([*sorted(step), np.iinfo(np.int64).max])
        self.next = np.array([*(step[k] for k in self.keys[:-1].tolist()), -1])
        self.seen = np.zeros(1 << 22, bool)  # by a hash of the key, so that most keys without a step need no search
        self.seen[self.hashed(self.keys)] = True
        self.cost = np.full(len(node), _EVER)  # of a string over several pieces, by node
        for costs in (two, {p: -s for p, s in self.score.items()}):
            self.cost[[node[w] for w in costs]] = list(costs.values())
        self.start, self.split = np.full(size, -1), np.full(size, _EVER)  # by id: its node, and what two usual pieces for it cost
        self.opens, self.blank = np.zeros(size, bool), np.zeros(size, bool)
        for p, i in self.id.items():
            self.start[i], self.split[i] = node[p], two.get(p, _EVER)
            self.opens[i], self.blank[i] = p.startswith(SPACE), not p.strip(SPACE)
        self.sizes = np.array(self.size)

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def bounds(self, ids: np.ndarray) -> np.ndarray:
        """For each id, the least loss of a slight departure that starts with it, or less; infinity without one."""
        out, at, k = self.split[ids], np.arange(len(ids)), 0
        node = self.start[ids]
        while True:
            k += 1
            more = at < len(ids) - k
            at, node = at[more], node[more]
            if not len(at):
                return out
            key = node * len(self.name) + ids[at + k]
            likely = np.flatnonzero(self.seen[self.hashed(key)])
            at, key = at[likely], key[likely]
            place = np.searchsorted(self.keys, key)
            hit = self.keys[place] == key
            at, node = at[hit], self.next[place[hit]]
            out[at] = np.minimum(out[at], self.cost[node])

    def own(self, chunk: str) -> list[int]:
        """Ids of the library's segmentation of a chunk; none without a library."""
        if self.sp is None:
            return []
        return self.sp.encode(chunk[1:]) if len(chunk) > 1 else [self.id[chunk]]

    def starts(self, chunk: str, ids: Sequence[int]) -> list[int]:
        """For each place, where the library's arc that ends there starts; -1 where none does."""
        on, at = [-1] * (len(chunk) + 1), 0
        for n in map(self.size.__getitem__, ids):
            if n:
                at += n
                if at > len(chunk):
                    break
                on[at] = at - n
        if ids and at != len(chunk):
            raise ValueError("the model normalises text; its pieces are not parts of it")
        return on

    def forward(self, chunk: str, on: list[int]) -> tuple[list[float], list[int], list[float]]:
        """For each place: the best sum of the arcs up to it, where its best arc starts, and how much its second arc loses."""
        n = len(chunk)
        ahead, start, gap = [_NEVER] * (n + 1), [0] * (n + 1), [_EVER] * (n + 1)
        ahead[0] = 0.0
        arcs = self.find.iter(chunk)
        if not self.single.issuperset(chunk):
            arcs = [*arcs, *((i, (0, self.unknown)) for i, c in enumerate(chunk) if c not in self.single)]
            arcs.sort(key=_place)
        for last, (more, s) in arcs:
            i = last - more
            last += 1
            s = ahead[i] if on[last] == i else ahead[i] + s
            best = ahead[last]
            if s > best:
                gap[last], ahead[last], start[last] = s - best, s, i
            elif best - s < gap[last]:
                gap[last] = best - s
        return ahead, start, gap

    def nbest(self, chunk: str, most: int) -> list[tuple[float, list[tuple[int, int]]]]:
        """Up to `most` segmentations, best first, as (score, [(start, end)]).

        The forward Viterbi score of a place is the exact score of what a backward search still has to cover. So a node
        of the queue stands for a whole path of known score, and different nodes for different paths: one that `most`
        others beat is never opened, and is not even queued. Arcs are found where the search comes to a place, so a long
        chunk needs no list of them.
        """
        on = self.starts(chunk, self.own(chunk))
        ahead, n = self.forward(chunk, on)[0], len(chunk)
        order = 0
        queue: list[tuple] = [(-ahead[n], 0, n, 0.0, None)]
        alive = [ahead[n]]
        out: list[tuple[float, list[tuple[int, int]]]] = []
        while queue and len(out) < most:
            _, _, at, behind, path = heapq.heappop(queue)
            while at:
                best = None
                for i in range(max(0, at - self.longest), at):
                    s = self.score.get(chunk[i:at], self.unknown if i == at - 1 else None)
                    if s is None:
                        continue
                    s = 0.0 if on[at] == i else s
                    reach = s + ahead[i]
                    if best is None or reach > best[0]:
                        best, other = (reach, i, s), best
                    else:
                        other = (reach, i, s)
                    if other is not None and (len(alive) < most or behind + other[0] > alive[-1]):
                        alive = sorted([*alive, behind + other[0]], reverse=True)[:most]
                        order += 1
                        heapq.heappush(queue, (-behind - other[0], order, other[1], behind + other[2], ((other[1], at), path)))
                behind, path, at = behind + best[2], ((best[1], at), path), best[1]
            cuts, p = [], path
            while p is not None:
                cuts.append(p[0])
                p = p[1]
            out.append((behind, cuts))
        return out

    def ids_of(self, piece: str) -> tuple[int, ...]:
        if piece in self.id:
            return (self.id[piece],)
        return tuple(self.byte[b] for b in piece.encode("utf-8")) if self.byte else (self.unk,)

    def ids(self, chunk: str, cuts: list[tuple[int, int]]) -> tuple[int, ...]:
        return tuple(itertools.chain.from_iterable([self.ids_of(chunk[a:b]) for a, b in cuts]))

    def loss(self, chunk: str, ids: Sequence[int]) -> float:
        """How much the second segmentation of a word loses: it leaves the best one at the place with the least gap."""
        on = self.starts(chunk, ids)
        return min([g for g, i in zip(self.forward(chunk, on)[2], on, strict=True) if i >= 0])

    def scored(self, chunk: str) -> tuple[float, tuple[int, ...], float]:
        """(score, ids, loss of the next) of the best segmentation of one word by bare scores."""
        ahead, start, gap = self.forward(chunk, [-1] * (len(chunk) + 1))
        at, loss, cuts = len(chunk), _EVER, []
        while at:
            loss = min(loss, gap[at])
            cuts.append((start[at], at))
            at = start[at]
        return ahead[-1], self.ids(chunk, cuts[::-1]), loss

    def least(self, whole: str, ids: np.ndarray, most: int) -> list[tuple[int, int, str]]:
        """(first id, end, word) of up to `most` words with the least losses, of equal ones the first, in order of place.

        A word's loss is not below its bound, so words are weighed by rising bounds until no other can be among the least.
        """
        after = np.cumsum(self.sizes[ids])
        if after[-1] != len(whole):
            raise ValueError("the model normalises text; its pieces are not parts of it")
        opens = self.opens[ids]
        opens[1:] &= ~self.blank[ids[:-1]]
        firsts = np.flatnonzero(opens) if self.by_word else np.zeros(1, np.int64)
        ends = np.append(firsts[1:], len(ids))

        def word(k: int) -> tuple[int, int, str]:
            a, b = int(firsts[k]), int(ends[k])
            return a, b, whole[int(after[a - 1]) if a else 0 : int(after[b - 1])]

        def weigh(k: int) -> float:
            a, b, chunk = word(k)
            got = self.whole.get(chunk)
            if got is None:
                got = self.loss(chunk, ids[a:b].tolist())
                if len(self.whole) < CACHE and len(chunk) < 100:
                    self.whole[chunk] = got
            return got

        bound = np.minimum.reduceat(self.bounds(ids), firsts)
        if not self.dense:  # a piece may hold characters that are written as bytes
            bound[np.logical_or.reduceat(self.start[ids] < 0, firsts)] = 0.0
        found: list[tuple[float, int]] = []
        slight = np.flatnonzero(bound <= self.bound)
        for k in slight[np.argsort(bound[slight], kind="stable")].tolist():
            if len(found) == most and (bound[k], k) > found[-1]:
                break
            loss = weigh(k)
            if loss <= self.bound:
                found = sorted([*found, (loss, k)])[:most]
        if len(found) < most:  # too few slight departures: all are weighed
            found = heapq.nsmallest(most, [x for x in zip(map(weigh, range(len(firsts))), range(len(firsts)), strict=True) if x[0] < _EVER])
        return [word(k) for k in sorted([k for _, k in found])]

    def options(self, chunk: str, most: int) -> list[tuple[float, tuple[int, ...]]]:
        got = self.lists.get((chunk, most))
        if got is None:
            got = [(s, self.ids(chunk, cuts)) for s, cuts in self.nbest(chunk, most)]
            if len(self.lists) < LISTS and len(chunk) < 100:
                self.lists[chunk, most] = got
        return got

    def encode(self, text: str, most: int = BEST) -> list[tuple[float, list[int]]]:
        """Up to `most` segmentations of a text, best first, as lists of ids; see `segment`."""
        return [(s, ids.tolist()) for s, ids in self.segment(text, most)]

    def segment(self, text: str, most: int = BEST) -> list[tuple[float, np.ndarray]]:
        """Up to `most` segmentations of a text, best first. No piece of the model crosses the start of a word, so a text's lattice is its words' end to end, and its best sums are found over the words' own lists: only the words with the least losses can differ from their best in them. Empty text has one empty segmentation."""
        if not text:
            return [(0.0, np.zeros(0, np.int32))]
        whole = SPACE + text.replace(" ", SPACE)
        if self.sp is None:
            chunks = _CHUNK.findall(whole) if self.by_word else [whole]
            words = [self.scored(c) for c in chunks]
            base, first = sum([w[0] for w in words]), np.array(list(itertools.chain.from_iterable([w[1] for w in words])), np.int32)
            least = sorted([k for _, k in heapq.nsmallest(most - 1, [(w[2], k) for k, w in enumerate(words) if w[2] < _EVER])])
            starts = [0, *itertools.accumulate([len(w[1]) for w in words])]
            places = [(starts[k], starts[k + 1], chunks[k]) for k in least]
        else:
            base, first = 0.0, np.array(self.sp.encode(text), np.int32)
            places = self.least(whole, first, most - 1) if most > 1 else []
        out = [(base, first)]
        options = [self.options(chunk, most) for _, _, chunk in places]
        queue, seen = [(0.0, (0,) * len(places))], set()
        while queue and len(out) < most:
            lost, pick = heapq.heappop(queue)
            if pick in seen:
                continue
            seen.add(pick)
            if any(pick):
                ids, at = [], 0
                for (start, end, _), own, x in zip(places, options, pick, strict=True):
                    if x:
                        ids += [first[at:start], np.array(own[x][1], np.int32)]
                        at = end
                out.append((base - lost, np.concatenate([*ids, first[at:]])))
            for x, own in enumerate(options):
                if pick[x] + 1 < len(own):
                    step = own[pick[x]][0] - own[pick[x] + 1][0]
                    heapq.heappush(queue, (lost + step, pick[:x] + (pick[x] + 1,) + pick[x + 1 :]))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes are joined and decoded, the first word's space goes. Exact for encode's output unless the text has the space mark itself, which comes back as a space."""
        if not self.byte:
            text = "".join(self.name[i] if i < len(self.name) else "\ufffd" for i in ids)
        else:
            first, length, flat = self._raw
            ids = np.asarray(ids, np.int64)
            size = length[ids]
            after = np.cumsum(size)
            text = flat[np.repeat(first[ids] - after + size, size) + np.arange(after[-1] if len(ids) else 0)].tobytes().decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    @functools.cached_property
    def _raw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each id's bytes start, how many they are, and the bytes of all ids."""
        value = {i: bytes([b]) for b, i in self.byte.items()}
        parts = [value.get(i, p.encode("utf-8")) for i, p in enumerate(self.name)]
        length = np.array(list(map(len, parts)))
        return np.cumsum(length) - length, length, np.frombuffer(b"".join(parts), np.uint8)


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, path: str, most: int = BEST) -> DataFrame:
    """(doc_id, ids, scores, next_ids): the library's segmentation of each whole text, the scores of the `most` best ones, itself first, and the ids of the others.

    Null text counts as empty: no ids, score 0, nothing else. A text whose lattice has fewer paths has fewer scores. Ties
    go to the first found, always the same. Repeated rows give equal rows; other columns are ignored; an empty table
    gives no rows. A text is one row's work, in memory of a few times its size.
    """
    bounded_batches(docs.sparkSession, 128)
    rows = docs.select("doc_id", "text")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            got = [own.segment(t or "", most) for t in b.column(1).to_pylist()]
            gc.freeze()  # kept words have no cycles: the collector needn't walk them again
            ids = pa.list_(pa.int32())
            cols = (pa.array([g[0][1] for g in got], ids), pa.array([[s for s, _ in g] for g in got], pa.list_(pa.float64())), pa.array([[x for _, x in g[1:]] for g in got], pa.list_(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "ids", "scores", "next_ids"])

    ids = T.ArrayType(T.IntegerType())
    shape = T.StructType([rows.schema["doc_id"]]).add("ids", ids).add("scores", T.ArrayType(T.DoubleType())).add("next_ids", T.ArrayType(ids))
    return rows.mapInArrow(task, shape)


def digest(docs: DataFrame, path: str, most: int = BEST) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, scores, crcs, text_crc32, exact): encode and decode in one pass, so ids never leave the worker. scores and crcs (of the ids) are those of the `most` best segmentations, the library's first; text_crc32 is that of the decoded text, exact whether it is the text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            out = []
            gc.freeze()  # kept words have no cycles: the collector needn't walk them again
            for t in b.column(1).to_pylist():
                got = own.segment(t or "", most)
                back = own.decode(got[0][1])
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in got]
                out.append((len(got[0][1]), crcs[0], [s for s, _ in got], crcs, zlib.crc32(back.encode("utf-8")), back == (t or "")))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_pieces", "ids_crc32", "scores", "crcs", "text_crc32", "exact"])

    shape = T.StructType([rows.schema["doc_id"]]).add("n_pieces", "long").add("ids_crc32", "long").add("scores", T.ArrayType(T.DoubleType())).add("crcs", T.ArrayType(T.LongType())).add("text_crc32", "long").add("exact", "boolean")
    return rows.mapInArrow(task, shape)


def op6_pieces(spark, sf_dir):
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
