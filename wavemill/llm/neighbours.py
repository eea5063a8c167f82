"""Embedding near-duplicates by NN-descent, audited, with neighbour lists enlarged to whole link components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table
from .groups import BLOCK, blocks, components, grouped, linked

SIMILARITY = 0.98
#: Neighbours kept in a list, trees that start the lists, rows of a tree's leaf, rounds at most, share of new entries that ends them.
LIST, TREES, LEAF, ROUNDS, SETTLED = 8, 3, 64, 4, 0.02
#: Vectors of an audit's slice, audited vectors with links that end it, slices compared at once at most.
AUDIT, SEEN, MOST_SLICES = 256, 256, 64
#: Recall that the audit must show, and attempts (each with twice the list and new trees) before all vectors are compared.
RECALL, ATTEMPTS = 0.99, 3
BITS = 20
#: Vectors in a block where components are compared whole, and centres of balls where they are compared with each other.
MEMBERS, CENTRES = 1024, 1024


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # tiny and huge components neither vanish nor overflow when squared
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    """(id, label, dim, emb) of the vectors that can link: label and id not null, all components finite, not all zero."""
    emb = F.col("embedding").cast("array<double>")
    sound = F.forall(emb, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(emb, lambda x: x != 0)
    rows = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return rows.where(sound).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), emb.alias("emb"))


def _leaves(nodes: DataFrame, tree: int) -> DataFrame:
    """(label, dim, leaf, id, emb): rows dealt by the signs of random projections, as many bits as leave about LEAF rows."""
    rows = nodes.select("label", "dim", "id", "bits", "emb")
    shape = "label string, dim int, id bigint, leaf bigint, emb array<double>"

    def task(batches):
        for b in batches:
            if not b.num_rows:
                continue
            dims, codes = b.column(1).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in set(dims.tolist()):
                at = np.flatnonzero(dims == d)
                planes = np.random.default_rng([tree, d]).standard_normal((d, BITS))
                side = _unit(b.column(4).take(pa.array(at))) @ planes > 0
                codes[at] = side @ (1 << np.arange(BITS, dtype=np.int64))
            codes &= (1 << b.column(3).to_numpy().astype(np.int64)) - 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(codes), b.column(4)], names=["label", "dim", "id", "leaf", "emb"])

    return rows.mapInArrow(task, shape)


def _best(g: pa.Table, most: int) -> list[tuple]:
    """Each row's nearest others in a group, as (u, v, sim)."""
    ids = g.column("id").to_numpy()
    ids, first = np.unique(ids, return_index=True)
    if len(ids) < 2:
        return []
    x = _unit(g.column("emb").take(pa.array(first)))
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(most, len(ids) - 1)
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return [(int(ids[u]), int(ids[v]), float(sim[u, v])) for u in range(len(ids)) for v in top[u].tolist()]


def _shorten(entries: DataFrame, most: int) -> DataFrame:
    """The `most` nearest of each list; ties by id."""
    order = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    return entries.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def descend(nodes: DataFrame, most: int, first_tree: int, known: DataFrame | None = None) -> DataFrame:
    """The refined neighbour graph (u, v, sim) of nodes (id, label, dim, bits, emb).

    Lists start from the leaves of random-projection trees. Each round joins a node's list, its reverse list and itself
    (neighbours of neighbours meet there), and every member keeps the best it met; it ends when few entries are new.
    """
    entries = known
    for tree in range(first_tree, first_tree + TREES):
        leaves = blocks(_leaves(nodes, tree), ["label", "dim", "leaf"], "id", 4 * LEAF, pairs=False)
        met = grouped(leaves.select("label", "dim", "leaf", "_i", "id", "emb"), ["label", "dim", "leaf", "_i"], lambda g: _best(g, most), "u bigint, v bigint, sim double")
        entries = met if entries is None else entries.union(met)
    graph = materialize(_shorten(entries, most), "graph")
    vectors = nodes.select(F.col("id"), "emb")
    for _ in range(ROUNDS):
        reverse = graph.select(F.col("v").alias("p"), F.col("u").alias("id"), "sim")
        order = Window.partitionBy("p").orderBy(F.col("sim").desc(), "id")
        reverse = reverse.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("p", "id")
        around = graph.select(F.col("u").alias("p"), F.col("v").alias("id")).union(reverse).union(graph.select(F.col("u").alias("p"), F.col("u").alias("id"))).distinct()
        met = grouped(around.join(vectors, "id").select("p", "id", "emb"), ["p"], lambda g: _best(g, 3), "u bigint, v bigint, sim double")
        new = materialize(_shorten(graph.union(met), most), "graph")
        total, fresh = new.count(), new.join(graph, ["u", "v"], "left_anti").count()
        graph = new
        if fresh <= SETTLED * total:
            break
    return graph


def _counts(g: pa.Table) -> list[tuple]:
    """Vectors linked to each row of a pair of blocks, copies counted, the distinct ones, and the smallest id of its group here."""
    ids, copies, own = g.column("id").to_numpy(), g.column("copies").to_numpy(), g.column("_b").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = _unit(g.column("emb").take(pa.array(order)))
    ids, copies, own = ids[order], copies[order], own[order]
    close = x @ x.T >= SIMILARITY
    np.fill_diagonal(close, False)
    if g.column("_i")[0].as_py() != g.column("_j")[0].as_py():
        close &= own[:, None] != own[None, :]
    root, n, distinct = linked(close), close @ copies, close.sum(axis=1)
    return [(int(ids[i]), int(n[i]), int(distinct[i]), int(ids[root[i]])) for i in np.flatnonzero(n).tolist()]


def _balls(g: pa.Table) -> list[tuple]:
    """Rows of a piece of a component dealt to balls: (id, id of the ball's centre, angle between them). Members link to their centre."""
    ids = g.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], _unit(g.column("emb").take(pa.array(order)))
    sim, centre = x @ x.T, np.full(len(ids), -1)
    for i in range(len(ids)):
        if centre[i] < 0:
            centre[(centre < 0) & (sim[i] >= SIMILARITY)] = i
            centre[i] = i
    angle = np.arccos(np.clip(sim[np.arange(len(ids)), centre], -1, 1))
    return [(int(ids[i]), int(ids[c]), 0.0 if i == c else float(angle[i])) for i, c in enumerate(centre.tolist())]


def _meet(g: pa.Table) -> list[tuple]:
    """Pairs of balls of different components in a pair of blocks whose members can link by the angle of the centres, as (a, b, cosine of the centres)."""
    ids, group, own, angle = (g.column(c).to_numpy() for c in ("id", "component", "_b", "angle"))
    x = _unit(g.column("emb"))
    sim = x @ x.T
    reach = math.acos(SIMILARITY) + 1e-6 + angle[:, None] + angle[None, :]
    can = (sim >= np.cos(np.minimum(reach, math.pi))) & (group[:, None] != group[None, :]) & (ids[:, None] < ids[None, :])
    if g.column("_i")[0].as_py() != g.column("_j")[0].as_py():
        can &= own[:, None] != own[None, :]
    return [(int(ids[i]), int(ids[j]), float(sim[i, j])) for i, j in np.argwhere(can).tolist()]


def _cross(g: pa.Table) -> list[tuple]:
    """The nearest members of two balls if they link."""
    ids, side, x = g.column("id").to_numpy(), g.column("side").to_numpy(), _unit(g.column("emb"))
    p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    sim = x[p] @ x[q].T
    i, j = np.unravel_index(sim.argmax(), sim.shape)
    return [(int(ids[p[i]]), int(ids[q[j]]))] if sim[i, j] >= SIMILARITY else []


def _touching(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """Links (a, b) that join different components of nodes, one at least for each two that touch. Exact: nodes are covered by balls, the centres of a label are compared in pairs of blocks, and the members of balls that are near enough one by one."""
    rows = materialize(nodes.join(member, "id", "left").withColumn("component", F.coalesce("component", "id")).select("label", "dim", "id", "component", "emb"), "open")
    dealt = blocks(rows.select("component", "id", "emb"), ["component"], "id", BLOCK, pairs=False)
    ball = materialize(grouped(dealt.select("component", "_i", "id", "emb"), ["component", "_i"], _balls, "id bigint, ball bigint, angle double"), "balls")
    wide = ball.groupBy("ball").agg(F.max("angle").alias("angle")).withColumnRenamed("ball", "id")
    dealt = blocks(rows.join(wide, "id"), ["label", "dim"], "id", CENTRES)
    met = grouped(dealt.select("label", "dim", "_i", "_j", "_b", "id", "component", "angle", "emb"), ["label", "dim", "_i", "_j"], _meet, "a bigint, b bigint, sim double")
    met = materialize(met, "met")
    far = met.where(F.col("sim") < SIMILARITY)
    sides = [far.join(ball.select(F.col("ball").alias(c), "id"), c).select("a", "b", F.lit(n).alias("side"), "id") for n, c in enumerate("ab")]
    pairs = sides[0].union(sides[1]).join(rows.select("id", "emb"), "id").select("a", "b", "side", "id", "emb")
    return met.where(F.col("sim") >= SIMILARITY).select("a", "b").union(grouped(pairs, ["a", "b"], _cross, "x bigint, y bigint"))


def _links(nodes: DataFrame, graph: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, linked, distinct), (id, component): threshold edges of the graph, closed within each component by comparing it whole in pairs of blocks, so a saturated list grows to all that it can reach.

    A list that ends at SIMILARITY or more has not shown where a node's links end; components are compared with each other at all such nodes; with every, at all nodes, which costs the square of a label's distinct vectors and misses no link.
    """
    edges = graph.where(F.col("sim") >= SIMILARITY).select(F.col("u").alias("a"), F.col("v").alias("b"))
    member = materialize(components(edges, "links"), "links")
    ended = graph.groupBy("u").agg(F.min("sim").alias("last")).where(F.col("last") < SIMILARITY).select(F.col("u").alias("id"))
    lost = materialize(_touching(nodes if every else nodes.join(ended, "id", "left_anti"), member), "touching")
    if not lost.isEmpty():
        member = materialize(components(edges.union(lost), "links"), "links")
    rows = member.join(nodes.select("id", "copies", "emb", (F.col("dim").cast("long") * 8).alias("bytes")), "id")
    dealt = blocks(rows, ["component"], "id", MEMBERS, size="bytes")
    counts = grouped(dealt.select("component", "_i", "_j", "_b", "id", "copies", "emb"), ["component", "_i", "_j"], _counts, "id bigint, n bigint, distinct bigint, root bigint")
    return counts.groupBy("id").agg(F.sum("n").alias("linked"), F.sum("distinct").alias("distinct")), member


def _true_links(nodes: DataFrame, asked: list) -> DataFrame:
    """(id, n): distinct vectors that each asked row links to, by comparing it with all rows."""
    by = {}
    for r in asked:
        by.setdefault((r["label"], r["dim"]), []).append(r)
    held = nodes.sparkSession.sparkContext.broadcast({k: (np.array([r["id"] for r in rs]), np.array([r["emb"] for r in rs])) for k, rs in by.items()})

    def task(batches):
        for b in batches:
            labels, dims, ids = np.array(b.column(0).to_pylist()), b.column(1).to_numpy(), b.column(2).to_numpy()
            out = []
            for (label, dim), (qs, q) in held.value.items():
                at = np.flatnonzero((labels == label) & (dims == dim))
                if len(at):
                    x = _unit(b.column(3).take(pa.array(at)))
                    for lo in range(0, len(qs), 1024):
                        y = q[lo : lo + 1024]
                        y = y / np.abs(y).max(axis=1, keepdims=True)
                        close = (y / np.sqrt((y * y).sum(axis=1, keepdims=True))) @ x.T >= SIMILARITY
                        close &= qs[lo : lo + 1024, None] != ids[at][None, :]
                        n = close.sum(axis=1)
                        out += [(int(qs[lo + i]), int(n[i])) for i in np.flatnonzero(n).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], names=["id", "n"])

    truth = nodes.select("label", "dim", "id", "emb").mapInArrow(task, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return materialize(truth, "truth")


def _audit(nodes: DataFrame, linked_: DataFrame) -> float | None:
    """Mean share, over audited vectors that have links, of their true links to other distinct vectors that the result has; None if no vector has any.

    Slices of AUDIT vectors in hashed order are compared with all rows until SEEN of them have links or all vectors were
    asked. Copies do not count, and each vector counts alike, so neither a common vector nor a large group hides the rest.
    """
    total = nodes.count()
    slices = max(1, math.ceil(total / AUDIT))
    with_links, found, done, step = 0, 0.0, 0, 1
    while done < slices and with_links < SEEN:
        place = F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(slices))
        asked = nodes.where((place >= done) & (place < done + step)).select("id", "label", "dim", "emb").collect()
        if asked:
            share = F.least("n", F.coalesce("distinct", F.lit(0))) / F.col("n")
            r = _true_links(nodes, asked).join(linked_, "id", "left").agg(F.count("*"), F.sum(share)).first()
            with_links, found = with_links + r[0], found + (r[1] or 0.0)
        done += step
        step = min(2 * step, MOST_SLICES)
    return found / with_links if with_links else None


def near(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for each row of vectors (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and the cosine, in double precision, is 0.98 or more. Equal vectors
    of a label are one node with a count, so copies are never expanded. recall is the audit's, null where it found no link.

    Defined cases: a null, zero or empty vector, or one with a null or non-finite component, a null label: no links, its
    own component; vectors of different lengths do not link; a null vec_id has a null component and is not kept; rows
    that repeat a vec_id share its node and component; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(vectors.sparkSession, 2048)
    rows = valid(vectors)
    per = rows.groupBy("label", "dim").agg(F.count("*").alias("_n"))
    bits = F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / LEAF)))).cast("int")
    same = materialize(rows.groupBy("label", "dim", "emb").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "vectors")
    nodes = same.join(per.select("label", "dim", bits.alias("bits")), ["label", "dim"]).withColumnRenamed("node", "id")
    nodes = materialize(nodes, "nodes")
    graph: DataFrame | None = None
    recall: float | None = 0.0
    for attempt in range(ATTEMPTS):
        graph = descend(nodes, LIST << attempt, attempt * TREES, graph)
        linked_, member = _links(nodes, graph)
        linked_ = materialize(linked_, "linked")
        recall = _audit(nodes, linked_)
        if recall is None or recall >= RECALL:
            break
    else:
        linked_, member = _links(nodes, graph, every=True)
        linked_ = materialize(linked_, "linked")
        recall = _audit(nodes, linked_)
    found = nodes.join(linked_, "id", "left").join(member, "id", "left")
    found = found.select("label", "dim", "emb", F.coalesce("component", "id").alias("_component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    mine = rows.join(found, ["label", "dim", "emb"]).groupBy("id").agg(F.min("_component").alias("_component"), F.max("_links").alias("_links"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(mine, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def op1_neighbours(spark, sf_dir):
    return near(table(spark, sf_dir, "embeddings"))


def brute(rows: list[tuple]) -> list[tuple[int, int, int, bool]]:
    """The result of every pair of rows (vec_id, embedding, label) with unique ids, one by one."""
    sound = {}
    for k, e, label in rows:
        if label is not None and e is not None and len(e) and all(v is not None and math.isfinite(v) for v in e) and any(v != 0 for v in e):
            x = np.asarray(e, dtype=np.float64)
            x = x / np.abs(x).max()
            sound[k] = (label, x / math.sqrt(float(x @ x)))
    ids = sorted(k for k, _, _ in rows)
    close = {k: [] for k in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if a in sound and b in sound and sound[a][0] == sound[b][0] and len(sound[a][1]) == len(sound[b][1]) and float(sound[a][1] @ sound[b][1]) >= SIMILARITY:
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
    return [(k, len(close[k]), root[k], k == root[k]) for k in ids]


#: Every pair of a label, then reachability. For tables whose ids are unique and not null, as the given ones.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {SIMILARITY}),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT p.a, r.r FROM reach r JOIN pairs p ON p.b = r.id),
least_ AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
links AS (SELECT a AS id, count(*) AS n FROM pairs GROUP BY a)
SELECT o.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, c.component_id, o.vec_id = c.component_id AS kept, CASE WHEN EXISTS (SELECT 1 FROM pairs) THEN 1.0::DOUBLE END AS recall
FROM embeddings o JOIN least_ c ON c.id = o.vec_id LEFT JOIN links l ON l.id = o.vec_id
"""
