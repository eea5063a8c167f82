"""N-gram Jaccard join by chosen paths, with an exact check inside each group of candidates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table
from .groups import blocks, components, grouped, linked

#: Words of a shingle, similarity, and what a run and a level of the paths cost and find.
WORDS, SIMILARITY = 5, 0.8
#: Independent runs of a round, the first of them apart, and levels of a path. At similarity 0.8 a pair of equal sizes expects
#: 1.11 common children a node, so a run keeps it with probability 0.67, 0.52, 0.44 at levels 1, 2, 3; where one set holds
#: the other it is 0.63, 0.47, 0.37, and 14 runs miss it with 1.4e-3 at worst. Rounds of new runs follow until the audit is content.
RUNS, FIRST, LEVELS = 14, 2, 3
#: Buckets up to this size are compared at once; larger ones are split by another token.
SMALL, HOT = 192, 1024
SKETCH, NEAR = 128, 0.66
#: Documents that the audit asks, the longest in characters, tokens of all; recall of their links that ends the runs; rounds before all classes are compared.
AUDIT, LONGEST, AUDIT_TOKENS, RECALL, ROUNDS = 1024, 100_000, 1 << 22, 0.99, 3
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


_grid = np.random.default_rng(7)
_RUN_SEED = _grid.integers(1, 1 << 63, (ROUNDS, RUNS), dtype=np.uint64)
_SKETCH_MUL = _grid.integers(1, 1 << 31, SKETCH, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SKETCH_ADD = _grid.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _B)]), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INV)]), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles; of all its words if it has fewer; none without words."""
    raw = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    gap = _GAP[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    _grow(len(raw))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[: len(raw)], dtype=np.uint64)])
    word = _mix((sums[end] - sums[start]) * _inverse[start])
    k = min(WORDS, len(word))
    out = np.zeros(len(word) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x2545F4914F6CDD1D) + word[i : i + len(out)]
    return np.unique(_mix(out + np.uint64(k)))


def sketch(tokens: np.ndarray) -> bytes:
    """One byte of each of 128 least hashes."""
    t, low = (tokens >> np.uint64(20)).astype(np.uint32), np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(t), 4096):
        low = np.minimum(low, (t[None, at : at + 4096] * _SKETCH_MUL[:, None] + _SKETCH_ADD[:, None]).min(axis=1))
    return (low & np.uint32(255)).astype(np.uint8).tobytes()


def paths(tokens: np.ndarray, seeds: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """For each level, from one seed a run, the parents and nodes of the set's paths: a node keeps a token as a child if its hash under the node is below 1 / (similarity * size)."""
    keep = np.uint64(min(2**64 - 1, int(2**64 / (SIMILARITY * len(tokens)))))
    nodes, out = seeds, []
    for _ in range(LEVELS):
        found = []
        for at in range(0, len(nodes), 64):
            part = nodes[at : at + 64]
            for lo in range(0, len(tokens), 8192):
                h = _mix(tokens[None, lo : lo + 8192] ^ part[:, None])
                i, j = np.nonzero(h < keep)
                found.append((part[i], _mix(part[i] * np.uint64(3) + tokens[lo + j])))
        parents, nodes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (nodes[:0], nodes[:0])
        out.append((parents.view(np.int64).tolist(), nodes.view(np.int64).tolist()))
    return out


_SETS = "k1 long, k2 long, n int, sketch binary, hits array<int>" + "".join(f", parents{i} array<bigint>, nodes{i} array<bigint>" for i in range(1, LEVELS + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    return _signed(int(tokens.sum(dtype=np.uint64))), _signed(int(_mix(tokens + np.uint64(11)).sum(dtype=np.uint64)))


class Asked:
    """Token sets that the audit asks about, in one index from token to sets."""

    def __init__(self, sets_: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets_], dtype=np.int64)
        self.keys = [set_key(s) for s in sets_]
        self.own = {k: i for i, k in enumerate(self.keys)}
        owner = np.repeat(np.arange(len(sets_)), self.sizes)
        tokens = np.concatenate(sets_) if sets_ else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.tokens, first = np.unique(tokens[order], return_index=True)
        self.owner, self.starts = owner[order], np.append(first, len(order))

    def linked(self, tokens: np.ndarray, key: tuple[int, int]) -> list[int]:
        """Numbers of the asked sets, other than an equal one, at the similarity or more to a set."""
        if not len(self.tokens):
            return []
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        if not len(at):
            return []
        size = self.starts[at + 1] - self.starts[at]
        place = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        both = np.bincount(self.owner[place], minlength=len(self.sizes))
        got = np.flatnonzero(both >= SIMILARITY * (self.sizes + len(tokens) - both))
        return [i for i in got.tolist() if i != self.own.get(key)]


def _typed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text) of the rows that have a word; h tells texts of one id, or of none, apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def asked(docs: DataFrame) -> Asked:
    """The audit's sets: documents in hashed order of their ids, all of them if there are no more than AUDIT. AUDIT, LONGEST and AUDIT_TOKENS bound what the driver and the executors hold."""
    total = docs.count()
    lot = F.pmod(F.xxhash64(F.lit("audit"), "doc_id"), F.lit(1 << 40))
    rows = _typed(docs.where(F.col("doc_id").isNotNull() & (lot < int(min(1.0, AUDIT / max(total, 1)) * (1 << 40))) & (F.length("text") <= LONGEST)))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingles(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["doc_id", "h", "tokens"])

    found, used = {}, 0
    for r in sorted(rows.mapInArrow(task, "doc_id long, h long, tokens binary").limit(2 * AUDIT).collect(), key=lambda r: (r["doc_id"], r["h"])):
        t = np.frombuffer(bytes(r["tokens"]), dtype=np.uint64)
        if used + len(t) <= AUDIT_TOKENS and set_key(t) not in found:
            found[set_key(t)], used = t, used + len(t)
    return Asked(list(found.values()))


def sets(docs: DataFrame, round_: int, audit: Asked | None = None) -> DataFrame:
    """(doc_id, h, keys of the shingle set, its size, sketch, the asked sets it links to, and its paths in a round's runs) of documents with words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held, seeds = spark.sparkContext.broadcast(audit or Asked([])), _RUN_SEED[round_]  # at most AUDIT_TOKENS tokens

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * (2 * LEVELS)]
        for b in batches:
            rows = []
            for doc, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = shingles(text)
                key = set_key(t)
                rows.append((doc, h, *key, len(t), sketch(t), held.value.linked(t, key), *(x for level in paths(t, seeds) for x in level)))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "h", *(x.split()[0] for x in _SETS.split(", "))])

    return _typed(docs).mapInArrow(task, "doc_id long, h long, " + _SETS)


def _met(g: pa.Table) -> list[tuple]:
    """Edges between the known groups of the classes in one bucket or pair of blocks: each to the smallest that near sketches join it to."""
    ids, inv = np.unique(g.column("comp").to_numpy(), return_inverse=True)
    if len(ids) < 2:
        return []
    s = np.frombuffer(b"".join(g.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
    touch = np.zeros((len(ids), len(ids)), dtype=bool)
    for i in range(0, len(s), 16):
        x, y = np.nonzero((s[i : i + 16, None, :] == s[None, :, :]).sum(axis=2, dtype=np.uint8) >= NEAR * SKETCH)
        touch[inv[i + x], inv[y]] = True
    touch |= touch.T
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(linked(touch)) if r != i]


def candidate_edges(classes: DataFrame, seeds: np.ndarray | None, known: DataFrame | None) -> DataFrame:
    """Edges (a, b) between the known groups of classes (all their own at first) whose sketches are near, met in a bucket of the chosen paths from seeds; without seeds all classes are one bucket.

    Buckets of one class, or of one group, are dropped, small ones compared, larger ones split at the next level. What is
    still large after the last level is compared by pairs of blocks, but for blocks of one group: so nothing is cut, and
    a group of near copies that one run has joined costs later runs nothing.
    """

    def grouped_by(rows: DataFrame) -> DataFrame:
        if known is None:
            return rows.withColumn("comp", F.col("cls"))
        rows = rows.join(known, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
        mixed = rows.groupBy("node").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("node")
        return rows.join(mixed, "node", "left_semi")

    found, front = None, None
    if seeds is None:
        found = grouped_by(classes.select(F.lit(0).cast("long").alias("node"), "cls")).select("node", "cls", "comp")
    for level in range(1, LEVELS + 1) if seeds is not None else ():
        steps = F.arrays_zip(F.col(f"parents{level}").alias("p"), F.col(f"nodes{level}").alias("q"))
        if front is None:
            roots = F.array(*map(F.lit, seeds.view(np.int64).tolist()))
            rows = classes.select("cls", F.filter(steps, lambda x: F.array_contains(roots, x["p"])).alias("x"))
        else:  # a class has few open nodes: the join has a row a class
            rows = classes.select("cls", steps.alias("x")).join(front.groupBy("cls").agg(F.collect_list("node").alias("open")), "cls")
            rows = rows.select("cls", F.filter("x", lambda x: F.array_contains("open", x["p"])).alias("x"))
        rows = rows.select(F.explode("x.q").alias("node"), "cls")
        rows = rows if front is None else materialize(rows, "open")
        sizes = rows.groupBy("node").agg(F.count("*").alias("g")).where("g > 1")
        live = materialize(grouped_by(rows.join(sizes, "node")), "paths")
        now = (live if level == LEVELS else live.where(F.col("g") <= SMALL)).select("node", "cls", "comp")
        found = now if found is None else found.union(now)
        front = live.where(F.col("g") > SMALL)
        if level < LEVELS and front.isEmpty():
            break
    dealt = blocks(found, ["node"], "cls", HOT, group="comp").select("node", "_i", "_j", "cls", "comp").join(classes.select("cls", "sketch"), "cls")
    return grouped(dealt, ["node", "_i", "_j"], _met, "a bigint, b bigint").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right, or with each other."""
    both = left + (right or [])
    n, k = len(both), len(left)
    owner, tokens = np.repeat(np.arange(n), [len(s) for s in both]), np.concatenate(both)
    _, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    new = np.cumsum(shared) - 1
    use = shared[place]
    owner, place = owner[use], new[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((k, n - k if right else n), dtype=np.float32)
    width = max(64, (1 << 22) // n)
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, [lo, lo + width])
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[a:b], place[a:b] - lo] = 1
        total += m[:k] @ (m[k:] if right else m).T
    return total.astype(np.int64)


def _exact(g: pa.Table) -> list[tuple]:
    """For each class of a pair of blocks: documents and classes linked, and the smallest class of its exact group here."""
    ids, first = np.unique(g.column("cls").to_numpy(), return_index=True)  # a repeated row counts once
    own = g.column("_b").to_numpy()[first]
    order = np.argsort(own, kind="stable")
    ids, first, own = ids[order], first[order], own[order]
    copies, raw = g.column("copies").to_numpy()[first], g.column("tokens")
    sets_ = [np.frombuffer(raw[i].as_py(), dtype=np.uint64) for i in first.tolist()]
    size = np.array([len(s) for s in sets_])
    close = np.zeros((len(ids), len(ids)), dtype=bool)
    if g.column("_i")[0].as_py() == g.column("_j")[0].as_py():
        both = overlaps(sets_)
        close = both >= SIMILARITY * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(close, False)
    elif 0 < (k := int(np.searchsorted(own, own[-1]))):  # pairs within a block are another piece's
        both = overlaps(sets_[:k], sets_[k:])
        close[:k, k:] = both >= SIMILARITY * (size[:k, None] + size[None, k:] - both)
        close |= close.T
    by_id = np.argsort(ids)
    root = np.empty(len(ids), dtype=np.int64)
    root[by_id] = by_id[linked(close[np.ix_(by_id, by_id)])]
    docs, classes = close @ copies, close.sum(axis=1)
    return [(int(ids[i]), int(docs[i]), int(classes[i]), int(ids[root[i]])) for i in np.flatnonzero(classes).tolist()]


def _checked(docs: DataFrame, classes: DataFrame, near: DataFrame) -> DataFrame:
    """(cls, docs, classes, root) of the classes that have links: every pair of a candidate group checked on whole shingle sets."""
    member = materialize(near.join(classes.select("cls", "doc", F.col("h").alias("_h"), "copies", "n"), "cls"), "members")
    pick = F.broadcast(member) if member.count() <= 200_000 else member  # about 60 bytes a row
    texts = _typed(docs).join(pick, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("_h")))

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([shingles(t).tobytes() for t in b.column(3).to_pylist()], pa.binary())], names=["cls", "component", "copies", "tokens"])

    whole = texts.select("cls", "component", "copies", "text").mapInArrow(tokens, "cls bigint, component bigint, copies bigint, tokens binary")
    spread = blocks(member.withColumn("bytes", F.col("n").cast("long") * 8), ["component"], "cls", size="bytes").select("component", "cls", "_i", "_j", "_b")
    return materialize(grouped(whole.join(spread, ["component", "cls"]), ["component", "_i", "_j"], _exact, "cls bigint, docs bigint, classes bigint, root bigint"), "links")


def _recall(audit: Asked, classes: DataFrame, found: DataFrame) -> float | None:
    """Mean share, over the asked sets that have links, of their links to other classes that were found; None if none has any."""
    spark = classes.sparkSession
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(audit.keys)], "a int, k1 long, k2 long")
    truth = classes.select(F.explode("hits").alias("a")).groupBy("a").agg(F.count("*").alias("n")).join(F.broadcast(rows), "a")
    mine = classes.select("k1", "k2", "cls").join(F.broadcast(truth), ["k1", "k2"]).join(found.groupBy("cls").agg(F.sum("classes").alias("got")), "cls", "left")
    n, share = mine.agg(F.count("*"), F.avg(F.least(F.coalesce("got", F.lit(0)), F.col("n")) / F.col("n"))).first()
    return float(share) if n else None


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, recall, h, first): one row for each row of docs (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. n_links
    counts the other rows linked to this one, copies with the same set (n_copies, itself included) among them; class_id
    is the smallest doc_id reachable by links. Sets that are equal are one class from the start, so copies are never
    expanded. Chosen paths find candidates by sketch; each component of candidates then gets its whole shingle sets
    once, in pairs of blocks bounded in sets and bytes, and every pair in it is checked exactly. Runs repeat until the
    documents of an audit, compared exactly with all, have 0.99 of their links (recall; null where none has any); if three
    rounds of 14 runs do not suffice, the sketches of all classes are compared in pairs of blocks.

    Defined cases: a text with fewer than five words is one shingle; null or wordless text links with nothing and is its
    own class; rows with a null doc_id are linked like others and count, but never name a class: class_id is null where
    no member has an id; rows that repeat a doc_id are rows of their own, whether their texts are equal or not; an empty
    table gives no rows; other columns are ignored. h is a hash of the text; first marks the rows of each class whose
    (doc_id, h) is the smallest, nulls last: more than one only where a row repeats.
    """
    spark = docs.sparkSession
    audit = asked(docs)
    known = materialize(sets(docs, 0, audit).withColumn("row", F.monotonically_increasing_id()), "sets")
    first = [F.first(c).alias(c) for c in known.columns if c not in ("doc_id", "h", "row", "k1", "k2")]
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("rep")
    classes = known.groupBy("k1", "k2").agg(F.min("row").alias("cls"), F.count("*").alias("copies"), rep, *first)
    classes = materialize(classes.select("*", F.col("rep.doc_id").alias("doc"), F.col("rep.h").alias("h")), "classes")
    near, recall = None, 0.0
    for round_ in range(ROUNDS + 1):
        rows, seeds = classes, [None]
        if round_ < ROUNDS:
            if round_:
                again = sets(docs, round_).select("k1", "k2", *(c for c in known.columns if c[:5] in ("paren", "nodes"))).dropDuplicates(["k1", "k2"])
                rows = materialize(again.join(classes.select("k1", "k2", "cls", "sketch"), ["k1", "k2"]), "classes")
            seeds = [_RUN_SEED[round_][:FIRST], _RUN_SEED[round_][FIRST:]]
        for own in seeds:
            edges = candidate_edges(rows, own, near)
            if near is not None:
                edges = edges.union(near.select(F.col("cls").alias("a"), F.col("component").alias("b")))
            near = materialize(components(edges, "near").withColumnRenamed("id", "cls"), "near")
        checked = _checked(docs, classes, near)
        recall = _recall(audit, classes, checked)
        if recall is None or recall >= RECALL:
            break
    links = checked.groupBy("cls").agg(F.sum("docs").alias("docs"))
    groups = components(checked.select(F.col("cls").alias("a"), F.col("root").alias("b")), "classes").withColumnRenamed("id", "cls")
    keyed = classes.select("k1", "k2", "cls", "copies", "rep").join(links, "cls", "left").join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = keyed.groupBy("component").agg(F.min("rep").alias("least"))
    keyed = keyed.join(least, "component").select("k1", "k2", "least", (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    mine = known.select("doc_id", "h", "k1", "k2").join(keyed, ["k1", "k2"])
    is_first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))
    mine = mine.select("doc_id", F.col("least.doc_id").alias("class_id"), "n_links", "n_copies", F.lit(recall).cast("double").alias("recall"), "h", is_first.alias("first"))
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return mine.union(bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(recall).cast("double"), "h", F.lit(True)))


def op8_jaccard(spark, sf_dir):
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "recall")


def brute(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """(doc_id, class_id, n_links) by comparing every pair of unique ids."""
    own = {k: set(shingles(t).tolist()) for k, t in rows}
    ids = sorted(own)
    close = {k: [] for k in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(own[a] & own[b])
            if both and both >= SIMILARITY * (len(own[a]) + len(own[b]) - both):
                close[a].append(b)
                close[b].append(a)
    root: dict[int, int] = {}
    for k in ids:
        todo = [k] if k not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = k
                todo += close[x]
    return [(k, root[k], len(close[k])) for k in ids]


#: Exact pairs by shared shingles, then reachability. For tables whose ids are unique and not null, as the given ones.
ORACLE = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})]) END AS s FROM words),
own AS (SELECT doc_id, s, list_sort(s) AS k, len(s) AS n FROM cut),
alike AS (SELECT k, min(doc_id) AS cls, count(*) AS copies, any_value(s) AS s, any_value(n) AS n FROM own WHERE n > 0 GROUP BY k),
token AS (SELECT cls, n, unnest(s) AS t FROM alike),
pairs AS (SELECT a.cls AS a, b.cls AS b FROM token a JOIN token b ON a.t = b.t AND a.cls <> b.cls GROUP BY a.cls, b.cls HAVING count(*) >= {SIMILARITY} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT cls AS id, cls AS r FROM alike UNION SELECT p.a, r.r FROM reach r JOIN pairs p ON p.b = r.id),
least_ AS (SELECT id, min(r) AS class_id FROM reach GROUP BY id),
links AS (SELECT p.a AS id, sum(x.copies) AS docs FROM pairs p JOIN alike x ON x.cls = p.b GROUP BY p.a)
SELECT o.doc_id, coalesce(l.class_id, o.doc_id) AS class_id, (coalesce(d.docs, 0) + coalesce(x.copies, 1) - 1)::BIGINT AS n_links, coalesce(x.copies, 1)::BIGINT AS n_copies, CASE WHEN EXISTS (SELECT 1 FROM pairs) THEN 1.0::DOUBLE END AS recall
FROM own o LEFT JOIN alike x ON x.k = o.k AND o.n > 0 LEFT JOIN least_ l ON l.id = x.cls LEFT JOIN links d ON d.id = x.cls
"""
