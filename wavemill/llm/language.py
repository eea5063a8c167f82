"""Language identification by cross-parsing: phrases of longest matches against a suffix automaton of each language's text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_of, table

#: Labelled characters of each language that are learnt at most: whole documents in hashed order, none longer than the bound.
SAMPLE_CHARS = 60_000
#: Letters with a column of their own in the table of transitions; those of the others are looked up.
OWN_LETTERS = 96
#: Texts are parsed in blocks of so many characters, so many side by side; phrases that cross a block's start are mended.
BLOCK, LANES = 1024, 2048
#: Languages are learnt where crc32(doc_id) mod FOLDS is not HELD.
FOLDS, HELD = 4, 2


def sample(docs: DataFrame, bound: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Texts to learn from: for each lang not null, rows outside the held-out fold. Counts cover all rows; a row is drawn if its hash is under a threshold that expects three times the bound, and whole documents are taken in order of hash until the bound."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_of("doc_id") % FOLDS, F.lit(0)) != HELD))
    rows = rows.where((F.length("text") <= bound) & F.col("text").rlike(r"\p{L}"))
    totals = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()
    lot = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 40))
    near = F.lit(False)
    for r in totals:
        near = near | ((F.col("lang") == r["lang"]) & (F.col("_lot") < min(1.0, 3 * bound / r["n"]) * (1 << 40)))
    out: dict[str, list[str]] = {}
    used: Counter = Counter()
    for r in sorted(rows.withColumn("_lot", lot).where(near).collect(), key=lambda r: (r["lang"], r["_lot"], r["doc_id"] or 0, r["text"])):
        if used[r["lang"]] + len(r["text"]) <= bound:
            out.setdefault(r["lang"], []).append(r["text"])
            used[r["lang"]] += len(r["text"])
    return out


def automaton(texts: list[np.ndarray]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of all texts, state 0 first. No match runs from one text into the next."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def copy(p: int, q: int, c: int) -> int:
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = len(step) - 1
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = link[q]
            p = link[p]
        return link[q]

    for text in texts:
        last = 0
        for c in text.tolist():
            q = step[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else copy(last, q, c)
                continue
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            new, p = len(step) - 1, last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else copy(p, q, c)
            last = new
    return step


class Parser:
    """Counts phrases of texts against every language at once. The model is only the sample; tables are built once in each worker."""

    def __init__(self, texts: tuple[tuple[str, tuple[str, ...]], ...]):
        self.langs = [k for k, _ in texts]
        seen = Counter(c for _, ts in texts for t in ts for c in t.lower() if c.isalpha())
        own = sorted(sorted(seen), key=lambda c: -seen[c])
        self.ids = np.zeros(0x110000, dtype=np.int32)
        self.ids[[i for i in range(0x110000) if chr(i).isalpha()]] = len(own) + 1  # never learnt: a phrase alone everywhere
        self.ids[[ord(c) for c in own]] = np.arange(1, len(own) + 1)
        self.wide, self.width = len(own) + 2, 1 + min(len(own), OWN_LETTERS)
        tables, keys, values, self.roots, self.scale, base = [], [], [], [], [], 0
        self.alone = np.zeros((len(texts), self.wide), dtype=np.int64)  # what a letter that begins a phrase leads to
        for k, (_, ts) in enumerate(texts):
            coded = [self.code(t) for t in ts]
            steps = automaton(coded)
            self.alone[k] = base * 2 + 1
            for c, to in steps[0].items():
                self.alone[k, c] = (to + base) * 2 + 1
            go = np.tile(self.alone[k, : self.width], (len(steps), 1))  # next state twice, and whether a phrase begins
            for i, row in enumerate(steps[1:], 1):
                for c, to in row.items():
                    if c < self.width:
                        go[i, c] = (to + base) * 2
                    else:
                        keys.append((i + base) * self.wide + c)
                        values.append((to + base) * 2)
            tables.append(go)
            self.roots.append(base)
            self.scale.append(np.log(2 + sum(map(len, coded))))
            base += len(steps)
        self.next = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, dtype=np.int32)[order], 0)

    def code(self, text: str) -> np.ndarray:
        """Letters as ids, each run of anything else as one 0."""
        ids = self.ids[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        kept = ids > 0
        kept[1:] |= ids[:-1] > 0
        return ids[kept]

    def step(self, state: np.ndarray, letter: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Next state twice, and whether a phrase begins, for arrays of states, letters and languages that broadcast to the states' shape."""
        rare = letter >= self.width
        if not rare.any():
            return self.next[state * self.width + letter]
        out = self.next[state * self.width + np.where(rare, 0, letter)]
        at = np.nonzero(np.broadcast_to(rare, state.shape))
        c, k = np.broadcast_to(letter, state.shape)[at], np.broadcast_to(lang, state.shape)[at]
        key = state[at].astype(np.int64) * self.wide + c
        place = np.searchsorted(self.keys, key)
        out[at] = np.where(self.keys[place] == key, self.values[place], self.alone[k, c])
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): phrases of each text."""
        starts, lengths, owner, at = [], [], [], 0
        for i, t in enumerate(texts):
            for s in range(0, len(t), BLOCK):
                starts.append(at + s)
                lengths.append(min(BLOCK, len(t) - s))
                owner.append(i)
            at += len(t)
        counts = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        flat, carry = np.concatenate(texts) if starts else None, None
        for a in range(0, len(starts), LANES):
            own = np.array(owner[a : a + LANES])
            first = np.append(a == 0 or owner[a - 1] != own[0], own[1:] != own[:-1])
            got, carry = self._group(flat, np.array(starts[a : a + LANES]), np.array(lengths[a : a + LANES]), first, carry)
            np.add.at(counts, own, got.T)
        return counts

    def _group(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray, carry: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (languages, blocks) of consecutive blocks, and the states at the end of the last. carry: the states before the first block, if a text goes on there.

        All blocks are parsed at once as if a phrase began with each. Then each block that goes on from another is parsed
        again from its true state, only until a phrase begins where one did before: from there both are the same.
        """
        n, langs = len(start), len(self.langs)
        order = np.argsort(-length, kind="stable")
        by_start, alive = start[order], np.searchsorted(-length[order], -np.arange(length.max()), "left")  # blocks longer than t
        lang = np.arange(langs)[:, None]
        state = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], n, axis=1)
        begins = np.zeros((int(length.max()), langs, n), dtype=bool)
        for t, m in enumerate(alive.tolist()):
            entry = self.step(state[:, :m], flat[by_start[:m] + t][None, :], lang)
            begins[t, :, order[:m]] = (entry & 1).T
            state[:, :m] = entry >> 1
        end = np.empty_like(state)
        end[:, order] = state
        guess = begins.sum(axis=0, dtype=np.int64)
        count, spec_end = guess.copy(), end.copy()
        k, i = np.nonzero(np.broadcast_to(~first, (langs, n)))
        while len(k):
            s = end[k, i - 1] if carry is None else np.where(i > 0, end[k, i - 1], carry[k])
            seen, live = np.zeros(len(k), dtype=np.int64), np.arange(len(k))
            was = end[k, i].copy()
            for t in range(int(length[i].max())):
                over = length[i[live]] <= t
                if over.any():
                    done = live[over]
                    count[k[done], i[done]], end[k[done], i[done]] = seen[done], s[done]
                    live = live[~over]
                if not len(live):
                    break
                entry = self.step(s[live], flat[start[i[live]] + t], k[live])
                s[live] = entry >> 1
                seen[live] += entry & 1
                same = (entry & 1).astype(bool) & begins[t, k[live], i[live]]
                if same.any():
                    done = live[same]
                    before = begins[: t + 1, k[done], i[done]].sum(axis=0)
                    count[k[done], i[done]] = seen[done] + guess[k[done], i[done]] - before
                    end[k[done], i[done]] = spec_end[k[done], i[done]]
                    live = live[~same]
            count[k[live], i[live]], end[k[live], i[live]] = seen[live], s[live]
            moved = (end[k, i] != was) & (i + 1 < n)
            moved[moved] &= ~first[i[moved] + 1]
            k, i = k[moved], i[moved] + 1  # their successors began from another state
        return count, end[:, -1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        coded = [self.code(t or "") for t in texts]
        counts = self.phrases(coded) if self.langs else np.zeros((len(texts), 0))
        out = []
        for t, row in zip(coded, counts, strict=True):
            if not self.langs or not t.any():
                out.append(("und", 0.0))
                continue
            rate = row * self.scale / len(t)
            best = int(np.argmin(rate))
            rest = np.delete(rate, best)
            out.append((self.langs[best], float(rest.min() / (rest.min() + rate[best])) if len(rest) else 1.0))
        return out


@lru_cache(maxsize=2)
def parser(texts: tuple) -> Parser:
    return Parser(texts)


def identify(docs: DataFrame, learnt: dict[str, list[str]]) -> DataFrame:
    """(doc_id, lang_pred, score) of docs (doc_id, text).

    A text is lower-cased, runs of non-letters become one gap, and the whole of it is cross-parsed, whatever its length:
    each phrase is the longest match in the language's text, a letter without any match a phrase alone. The language
    with the fewest phrases, times the log of what was learnt, for each letter wins; a tie goes to the first by code
    point. score is the runner-up's share of the two rates: 0.5 at a tie, 1 if only one language is known. Null text, or
    text without a letter, or nothing learnt: `und` and 0. Repeated rows, null ids too, give equal rows; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(tuple((k, tuple(learnt[k])) for k in sorted(learnt)))  # bounded by the sample
    rows = docs.select("doc_id", "text")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(model.value)
        for b in batches:
            got = own.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(task, T.StructType([rows.schema["doc_id"]]).add("lang_pred", "string").add("score", "double"))


def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_of("doc_id") % FOLDS == HELD, F.lit(False))
    return identify(docs, sample(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
