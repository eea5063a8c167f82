"""Line deduplication by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_bounded, materialize, table

#: Trimmed lines of fewer characters count as equal only if they are; longer ones within one inserted, deleted or replaced character.
LEAST = 16
#: Place of a row without a doc_id: after all others.
LAST = (1 << 63) - 1
#: Pieces of a line. One edit leaves all but one piece intact, so only lines that agree on the rest of a piece are expanded.
PIECES = 4
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _place(docs: DataFrame) -> list[Column]:
    """doc and d of a row: its place by id, null last, and a hash that tells texts of one id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("d")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, d, line, s): trimmed lines with any text, numbered from 0."""
    rows = docs.select(*_place(docs), F.split("text", "\n").alias("parts"))  # the hash is taken once a text, not once a line
    rows = rows.select("doc", "d", F.posexplode("parts").alias("line", "s"))
    return rows.withColumn("s", F.trim("s")).where(F.col("s").rlike(r"[^\x20\x09-\x0D]"))


def _keys(s: Column) -> Column:
    """A key for each piece that an edit could be in: what stands before and after it. Bounds depend on the length of the shorter line of a pair, in steps of 4 * PIECES, so a line that could be the longer one of a pair at a step has both sets. Only of use for lines of LEAST characters or more."""
    n = F.length(s)

    def of(step: Column) -> list[Column]:
        part = (step * 4).cast("int")
        return [F.struct(F.xxhash64(F.lit(i), step, F.substring(s, F.lit(1), part * i), F.when(F.lit(i) < PIECES - 1, F.substring(s, -(part * (PIECES - 1 - i)), part * (PIECES - 1 - i))).otherwise("")).alias("key"), (part * i).alias("head"), (part * (PIECES - 1 - i)).alias("tail")) for i in range(PIECES)]

    step = F.floor(n / (4 * PIECES)).cast("long")
    edge = (n % (4 * PIECES) == 0) & (n > LEAST)
    return F.when(edge, F.concat(F.array(*of(step)), F.array(*of(step - 1)))).otherwise(F.array(*of(step)))


def _variants(lines: DataFrame) -> DataFrame:
    """(v, role, doc, d, line) of lines (doc, d, line, s, keys): hashed variants of the piece that a key leaves open. role 0: less the character at a place, with the place (both lines of a replacement have it); 1: less any one character; 2: whole."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs, roles, docs, ds, at = [], [], [], [], []
            for doc, d, line, s, keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
                for k in keys:
                    w = code[k["head"] : len(code) - k["tail"]]
                    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(w), _B)]), dtype=np.uint64)
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(w * power[:-1], dtype=np.uint64)])
                    less = sums[:-1] + (sums[-1] - sums[1:]) * _INV
                    key = _mix(np.array([k["key"] & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))
                    place = _mix(less + _mix(np.arange(1, len(w) + 1, dtype=np.uint64)) + key)
                    any_ = np.unique(_mix(less * np.uint64(5) + key))
                    whole = _mix(sums[-1:] * np.uint64(5) + key)
                    vs += [place, any_, whole]
                    roles.append(np.repeat(np.array([0, 1, 2], np.int32), [len(place), len(any_), 1]))
                    n = len(place) + len(any_) + 1
                    docs.append(np.full(n, doc))
                    ds.append(np.full(n, d))
                    at.append(np.full(n, line, np.int32))
            if vs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(vs).view(np.int64)), pa.array(np.concatenate(roles)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(at))], names=["v", "role", "doc", "d", "line"])

    return lines.select("doc", "d", "line", "s", "keys").mapInArrow(task, "v bigint, role int, doc bigint, d bigint, line int")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, d, line): every occurrence of a line that an earlier line (by doc_id, hash of the text, place) equals, or equals within one edit if both have 16 characters.

    Equal lines are one row from the start, so a common line is counted by partial aggregation and never expanded.
    Distinct lines are hashed once for each piece that an edit could be in; only those whose key another distinct line
    has are expanded to their deletion variants. Lines that meet in a variant are tested by edit distance on their texts.
    """
    every = lines_of(docs).select("doc", "d", "line", F.xxhash64(F.lit(1), "s").alias("h"), F.xxhash64(F.lit(2), "s").alias("g"), _keys(F.col("s")).alias("keys"), (F.length("s") >= LEAST).alias("open"))
    one = every.groupBy("h", "g").agg(F.min(F.struct("doc", "d", "line")).alias("at"), F.first(F.transform("keys", lambda k: k["key"])).alias("ks"), F.first("open").alias("open"))
    one = materialize(one.select("h", "g", "at.doc", "at.d", "at.line", "ks", "open"), "lines")
    keyed = one.where("open").select("doc", "d", "line", F.xxhash64("doc", "d", "line").alias("z"), F.explode("ks").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("z").alias("a"), F.max("z").alias("b")).where("a <> b").select("key")
    live = keyed.join(shared.hint("merge"), "key", "left_semi").groupBy("doc", "d", "line").agg(F.collect_list("key").alias("open"))
    live = materialize(live.groupBy("doc", "d").agg(F.collect_list(F.struct("line", "open")).alias("open")), "open-lines")
    bounded_batches(docs.sparkSession)
    texts = docs.select(*_place(docs), F.split("text", "\n").alias("_all"))
    near = join_bounded(texts, live, ["doc", "d"], live.count())
    near = near.select("doc", "d", "_all", F.explode("open").alias("e"))
    near = near.select("doc", "d", "e.line", F.trim(F.element_at("_all", F.col("e.line") + 1)).alias("s"), F.col("e.open").alias("_open"))
    near = materialize(near.withColumn("keys", F.filter(_keys(F.col("s")), lambda k: F.array_contains("_open", k["key"]))).drop("_open"), "near-lines")
    spread = materialize(_variants(near), "variants")
    me = F.struct("doc", "d", "line")
    place = spread.where("role = 0")
    first = place.groupBy("v").agg(F.min(me).alias("first"), F.max(me).alias("last")).where("first <> last").select("v", "first")
    replaced = place.join(first.hint("merge"), "v").select(me.alias("x"), F.col("first").alias("y"))
    whole = spread.where("role = 2").select("v", me.alias("y"))
    shorter = spread.where("role = 1").select("v", me.alias("x")).join(whole.hint("merge"), "v").select("x", "y")
    pairs = replaced.union(shorter).where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    text = near.select(me.alias("at"), "s").distinct()  # rows that repeat have the same lines
    pairs = pairs.join(text.select(F.col("at").alias("x"), F.col("s").alias("sx")), "x").join(text.select(F.col("at").alias("y"), F.col("s").alias("sy")), "y")
    late = pairs.where(F.levenshtein("sx", "sy", 1) >= 0).select("x.doc", "x.d", "x.line").distinct().withColumn("near", F.lit(True))
    known = one.join(late, ["doc", "d", "line"], "left").select("h", "g", F.col("doc").alias("doc0"), F.col("d").alias("d0"), F.col("line").alias("line0"), "near")
    found = every.select("doc", "d", "line", "h", "g").join(known, ["h", "g"])
    return found.where(F.col("near") | (F.col("doc") != F.col("doc0")) | (F.col("d") != F.col("d0")) | (F.col("line") != F.col("line0"))).select("doc", "d", "line")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of `text`, plus n_lines and n_dropped.

    Of equal lines the earliest stays, by doc_id and place, and of lines of 16 characters or more, trimmed, also of those
    within one edit. A line is dropped whenever an earlier one is that near, whether or not the earlier one stays. Lines
    without text always stay.

    Defined cases: null text stays null with 0 lines; empty text is one line; rows without a doc_id come after all others;
    rows that repeat a doc_id are documents of their own, ordered by a hash of their texts, but rows that repeat id and
    text are one document and lose the same lines; a text with all lines dropped is empty; an empty table gives no rows;
    n_chars follows the text if there is such a column; other columns pass through whatever their names, except that
    n_lines and n_dropped are replaced. Of very long texts a line, not the text, is the unit that meets others.
    """
    gone = materialize(repeated(docs).groupBy("doc", "d").agg(F.collect_set("line").alias("gone")), "dropped")
    rows = docs.select(*_place(docs), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(gone.hint("merge"), ["doc", "d"], "left")
    parts = F.split("row.text", "\n")
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n")
    lost = F.col("gone").isNotNull()
    made = {c: F.col("row").getField(c) for c in docs.columns if c not in ("n_lines", "n_dropped")}
    made["text"] = F.when(lost, left).otherwise(made["text"])
    if "n_chars" in made:
        made["n_chars"] = F.when(lost, F.length(left)).otherwise(made["n_chars"]).cast(docs.schema["n_chars"].dataType)
    made["n_lines"] = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    made["n_dropped"] = F.when(lost, F.size("gone")).otherwise(0).cast("long")
    return rows.select(*(c.alias(n) for n, c in made.items()))


def op2_line_dedup(spark, sf_dir):
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


ORACLE = f"""
WITH every AS (SELECT doc_id AS doc, unnest(range(0, len(string_split(text, chr(10))))) AS line, trim(unnest(string_split(text, chr(10)))) AS s FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT * FROM every WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]')),
one AS (SELECT s, min((doc, line)) AS pos, length(s) AS n FROM lines GROUP BY s),
halves AS (SELECT *, unnest([n // 16, (n - 1) // 16]) AS b FROM one),
keyed AS (SELECT DISTINCT s, pos, n, b FROM halves WHERE b > 0),
pairs AS (
  SELECT x.s, y.pos AS other FROM keyed x JOIN keyed y ON x.b = y.b AND left(x.s, (8 * x.b)::BIGINT) = left(y.s, (8 * y.b)::BIGINT) AND x.pos > y.pos AND abs(x.n - y.n) <= 1 AND levenshtein(x.s, y.s) <= 1
  UNION ALL
  SELECT x.s, y.pos FROM keyed x JOIN keyed y ON x.b = y.b AND right(x.s, (8 * x.b)::BIGINT) = right(y.s, (8 * y.b)::BIGINT) AND x.pos > y.pos AND abs(x.n - y.n) <= 1 AND levenshtein(x.s, y.s) <= 1),
near AS (SELECT DISTINCT s FROM pairs),
gone AS (SELECT DISTINCT l.doc, l.line FROM lines l JOIN one o USING (s) LEFT JOIN near n USING (s) WHERE n.s IS NOT NULL OR (l.doc, l.line) <> o.pos),
kept AS (SELECT e.doc, string_agg(p, chr(10) ORDER BY e.line) AS text FROM (SELECT doc_id AS doc, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS p FROM documents) e LEFT JOIN gone g ON e.doc = g.doc AND e.line = g.line WHERE g.doc IS NULL GROUP BY e.doc),
dropped AS (SELECT doc, count(*) AS n FROM gone GROUP BY doc)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(x.n, 0)::BIGINT AS n_dropped, md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END) AS text_md5
FROM documents d LEFT JOIN dropped x ON d.doc_id = x.doc LEFT JOIN kept k ON d.doc_id = k.doc
"""
