"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_of, materialize, table

UPPER, DIGIT, STOP, SHOUT = string.ascii_uppercase.encode(), string.digits.encode(), b".,;:", b"!?"
SYMBOL = bytes(c for c in string.punctuation.encode() if c not in STOP + SHOUT + b"'\"-()")
LETTER = string.ascii_letters.encode()
NAMES = ["words", "word_length", "upper", "digit", "stop", "shout", "symbol", "bar", "distinct", "top_word", "packed", "repeated_lines", "line_words"]
#: Statistics are kept as multiples of 1/4096, so that sums over any partitioning are exact and a rerun gives the same model.
GRAIN = 4096
#: Weight of the pooled covariance, and of its diagonal, in each class covariance; rows that the pooled one counts beside the data.
POOLED, DIAGONAL, FLOOR = 0.1, 0.05, 1e-4
#: Labels are learnt where crc32(doc_id) mod FOLDS is not HELD.
FOLDS, HELD = 3, 1


def statistics(text: str | None) -> list[int]:
    """Statistics of the whole text; shares are damped by a few imaginary typical words, so that short texts stay near the usual. Null counts as empty."""
    text = text or ""
    raw, words = text.encode("utf-8"), text.split()
    size, n = len(raw), len(words)
    count = lambda kind: size - len(raw.translate(None, kind))
    share = lambda k, of, usual, weight: ((k + usual * weight) / (of + weight)) ** 0.5
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(len(x) for x in lines) - sum(len(x) for x in set(lines))
    packed = len(zlib.compress(raw, 1)) - 11 if size else 0
    wide = size - count(b" \t\r\n\v\f")
    values = [
        np.log1p(n) / 4,
        np.log((wide + 30) / (n + 6)),
        share(count(UPPER), count(LETTER), 0.02, 100),
        share(count(DIGIT), size, 0, 50),
        share(count(STOP), size, 0.015, 100),
        share(count(SHOUT), size, 0, 50),
        share(count(SYMBOL), size, 0, 50),
        share(sum(seen[w] for w in ("|", "*", "-", "•")), n, 0, 10),
        np.log((len(seen) + 10) / (n + 10)),
        share(max(seen.values(), default=0), n, 0.06, 40),
        np.log((packed + 60) / (size + 100)),
        share(again, size, 0, 50),
        np.log((n + 40) / (len(lines) + 1.0)) / 4,
    ]
    return np.rint(np.asarray(values) * GRAIN).astype(int).tolist()


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and `stats` of docs (text, *keep)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*keep, "text")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array([statistics(t) for t in b.column(len(keep)).to_pylist()], pa.list_(pa.int32()))], names=[*keep, "stats"])

    return rows.mapInArrow(task, T.StructType([rows.schema[c] for c in keep]).add("stats", T.ArrayType(T.IntegerType())))


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """Fits on all of stats (doc_id, stats) with a label (doc_id, quality): exact class counts, sums and sums of products, gathered as one row a class.

    A document whose labels disagree, or are null, teaches nothing. A class without rows leaves a model that gives the
    other class, or 0.5 if there is none.
    """
    one = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").drop("_y")
    d = len(NAMES)
    x = [F.col("stats")[i].cast("long") for i in range(d)]
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    sums = [F.count("*").alias("n"), F.array(*map(wide, x)).alias("s"), F.array(*(wide(x[i] * x[j]) for i in range(d) for j in range(i + 1))).alias("ss")]
    rows = {r["y"]: r for r in stats.join(one, "doc_id").groupBy("y").agg(*sums).collect()}
    n = {y: int(rows[y]["n"]) if y in rows else 0 for y in (0, 1)}
    if not n[0] or not n[1]:
        return {"only": 1.0 if n[1] else 0.0 if n[0] else 0.5}
    low = np.tril_indices(d)
    mean, cov = {}, {}
    for y, r in rows.items():
        s, ss = np.array([float(v) for v in r["s"]]), np.zeros((d, d))
        exact = [float(int(v) * n[y] - int(a) * int(b)) for v, a, b in zip(r["ss"], np.array(r["s"])[low[0]], np.array(r["s"])[low[1]], strict=True)]
        ss[low] = np.array(exact) / n[y] ** 2
        cov[y] = (ss + ss.T - np.diag(np.diag(ss))) / GRAIN**2
        mean[y] = s / n[y] / GRAIN
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    diagonal = np.diag(np.diag(pooled)) + FLOOR * np.eye(d)
    model = {"only": None, "prior": float(np.log(n[1] / n[0]))}
    for y in (0, 1):
        shrunk = (1 - POOLED - DIAGONAL) * cov[y] + POOLED * pooled + DIAGONAL * diagonal
        factor = np.linalg.cholesky(shrunk)  # found once; scoring multiplies by its inverse
        model[y] = (mean[y], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))
    return model


def scores(model: dict, stats: np.ndarray) -> np.ndarray:
    """0 to 1 from the difference of log densities, Mahalanobis terms by the inverse factors."""
    if model["only"] is not None:
        return np.full(len(stats), model["only"])
    x, log = stats.astype(np.float64) / GRAIN, {}
    for y in (0, 1):
        mean, inverse, half = model[y]
        log[y] = -0.5 * np.square((x - mean) @ inverse.T).sum(axis=1) - half
    z = np.clip(log[1] - log[0] + model["prior"], -500, 500)
    return 1 / (1 + np.exp(-z))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def score(stats: DataFrame, model: dict) -> DataFrame:
    """Adds score to stats (doc_id, held_out, stats)."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores(model, _matrix(b.column(2))), pa.float64())], names=["doc_id", "held_out", "score"])

    return stats.select("doc_id", "held_out", "stats").mapInArrow(task, T.StructType([stats.schema["doc_id"]]).add("held_out", "boolean").add("score", "double"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict, DataFrame]:
    """The model, and the stored statistics of docs (doc_id, held_out, stats).

    Defined cases: null text counts as empty, which has statistics like any text; texts are measured whole, whatever their
    length; rows with a null doc_id are not held out and match no label; rows that repeat a doc_id each teach with its
    label and get scores of their own, equal texts equal ones; an empty table leaves a model that gives 0.5; columns other
    than doc_id and text, whatever their names, are ignored.
    """
    held = F.coalesce(crc_of("doc_id") % FOLDS == HELD, F.lit(False))
    stats = materialize(with_statistics(docs.select("doc_id", held.alias("held_out"), "text"), ["doc_id", "held_out"]), "quality")
    return fit(stats.where(~F.col("held_out")), labels), stats


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects (score under 0.5); same columns, texts are not shuffled."""
    model, _ = train(docs, labels)
    at = docs.columns.index("text")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = scores(model, np.array([statistics(t) for t in b.column(at).to_pylist()]))
                yield b.filter(pa.array(got >= 0.5))

    return docs.mapInArrow(task, docs.schema)


def op10_quality(spark, sf_dir):
    model, stats = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(stats, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
