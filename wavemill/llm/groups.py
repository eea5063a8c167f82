"""Graph and group helpers: streamed groups of sorted partitions, block pairs of large groups, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows, and bytes, of a group that are compared in one piece; a larger group is dealt to pairs of blocks of about this size.
BLOCK, BYTES = 512, 8 << 20


def streamed(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of a partition that is sorted by its first `keys` columns (not null), one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = last is not None and first != last
        cuts = np.flatnonzero(new).tolist()
        at = 0
        for cut in [*cuts, b.num_rows]:
            if at < cut:
                held.append(b.slice(at, cut - at))
            if cut < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            at = cut
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def grouped(rows: DataFrame, keys: list[str], kernel: Callable[[pa.Table], list[tuple] | None], schema: str) -> DataFrame:
    """Runs kernel on each group of rows by keys, streaming over sorted partitions: a task holds one group. Groups must be bounded; kernel returns rows."""
    cols = [*keys, *(c for c in rows.columns if c not in keys)]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[t] for _, t in rows.sparkSession.createDataFrame([], schema).dtypes]
    names = [x.split()[0] for x in schema.split(",")]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in streamed(batches, len(keys)):
            out += kernel(g) or []
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.select(*cols).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, schema)


def blocks(rows: DataFrame, key: list[str], id_col: str, block: int = BLOCK, pairs: bool = True, group: str | None = None, size: str | None = None, bytes_: int = BYTES) -> DataFrame:
    """Adds _i, _j (the pair of blocks) and _b (the row's own block, a long) to rows, so that what is compared comes in pieces of at most about 2 * block rows and, where `size` names a column of bytes, 2 * bytes_ bytes.

    Keys of few rows are one block, compared with itself. With pairs, each row of a larger key goes to every pair that
    holds its block; without, to its own block alone (_i = _j). With `group`, pairs within a group needn't meet: a group
    of more than half a block has blocks of its own that are never paired with each other, the others share blocks whole.
    """
    by, weight = F.count("*").alias("_g"), F.sum(size) if size else F.lit(0)
    large = rows.groupBy(*key).agg(by, weight.alias("_w"))
    many = F.ceil(F.greatest(F.col("_g") / block, F.col("_w") / bytes_)).cast("int")
    large = large.withColumn("_nb", many).where(F.col("_nb") > 1).select(*key, "_nb")
    if group is None:
        out = rows.join(large, key, "left")
        out = out.withColumn("_b", F.when(F.col("_nb").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit("block"), id_col), F.col("_nb"))).cast("long"))
        if not pairs:
            return out.withColumn("_i", F.col("_b")).withColumn("_j", F.col("_b")).drop("_nb")
        out = out.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_nb", F.lit(1)).cast("long") - 1)))
        return out.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_o", "_nb")
    few = rows.join(large, key, "left_anti").withColumns({c: F.lit(0).cast("long") for c in ("_b", "_i", "_j")})
    hot = rows.join(large, key)
    own = hot.groupBy(*key, group).agg(F.count("*").alias("_s")).where(F.col("_s") > block // 2)
    hot = hot.join(own, [*key, group], "left")
    part = F.when(F.col("_s").isNull(), F.xxhash64(F.lit("mixed"), F.pmod(F.xxhash64(F.lit("block"), group), F.col("_nb"))))
    part = part.otherwise(F.xxhash64(F.lit("own"), group, F.pmod(F.xxhash64(F.lit("block"), id_col), F.ceil(F.col("_s") / block).cast("int"))))
    hot = materialize(hot.withColumn("_b", part).withColumn("_own", F.when(F.col("_s").isNotNull(), F.col(group))).drop("_nb", "_s"), "hot-blocks")
    there = hot.select(*key, "_b", "_own").distinct()
    other = there.select(*key, F.col("_b").alias("_j"), F.col("_own").alias("_other"))
    met = there.withColumnRenamed("_b", "_i").join(other, key).where("_i <= _j and not coalesce(_own = _other, false)").select(*key, "_i", "_j")
    met = met.select(*key, F.explode(F.array_distinct(F.array("_i", "_j"))).alias("_b"), "_i", "_j")
    return few.unionByName(hot.drop("_own").join(met, [*key, "_b"]).select(*few.columns))


def linked(close: np.ndarray) -> np.ndarray:
    """Root (smallest index) of each row under the symmetric boolean matrix `close`, by breadth-first search."""
    n, root = len(close), np.full(len(close), -1)
    for s in range(n):
        if root[s] >= 0:
            continue
        front = np.zeros(n, dtype=bool)
        front[s] = True
        while front.any():
            root[front] = s
            front = close[front].any(axis=0) & (root < 0)
    return root


def components(edges: DataFrame, tag: str, most: int = 40) -> DataFrame:
    """(id, component) for every id in edges (a, b long): the smallest id that it can reach.

    Alternating large-star and small-star steps: every step keeps the edges linear in the number of nodes, partial
    aggregation makes hubs cheap, and each round is a written table. Self-loops and repeated edges do no harm.
    """
    cur = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), tag)
    mark = None
    for _ in range(most):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        cur = materialize(small, tag)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
