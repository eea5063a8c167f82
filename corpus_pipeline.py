"""The corpus pipeline: quality, repeated lines, near duplicates, mixture, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import jaccard, lines, mix, pieces, quality
from wavemill.llm.common import materialize, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go; rows, columns and texts of the others stay as they are.

    Null and empty texts are scored like any text, long ones whole; a null doc_id matches no label but is scored; equal
    rows share a fate; an empty table gives none. Columns are told apart by place, so extra ones with any name pass.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has, or nearly has, go; a document without any text left goes too.

    Texts that were null, empty or blank from the start stay, as no line of theirs was dropped; the rest is as in
    lines.dedup. Extra columns pass, but for n_lines, n_dropped, which are lost.
    """
    out = lines.dedup(docs)
    return out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest doc_id, null last, then by a hash of its text.

    Rows that repeat a doc_id are rows of their own: only those near another go, and of rows equal in doc_id and text one
    stays. Rows without a doc_id are compared like others. Texts without a word are near nothing and all stay.
    """
    gone = jaccard.join(docs).where("not first").select(F.col("doc_id").alias("_gone_id"), F.col("h").alias("_gone_h")).distinct()
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    again = worded.groupBy(F.col("doc_id").cast("long").alias("_gone_id"), F.xxhash64("text").alias("_gone_h")).agg(F.count("*").alias("_gone_n")).where("_gone_n > 1").drop("_gone_n")
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_h"))

    def held(rows: DataFrame, tag: str) -> tuple[DataFrame, int]:
        rows = materialize(rows, tag)
        n = rows.count()
        return (F.broadcast(rows) if n <= 500_000 else rows), n  # two numbers a row

    gone, _ = held(gone, "gone")
    again, n = held(again, "again")
    kept = docs.join(gone, same, "left_anti")
    if not n:
        return kept.select(*docs.columns)
    once = kept.join(again, same).dropDuplicates(["_gone_id", "_gone_h"])
    return kept.join(again, same, "left_anti").unionByName(once.select(*docs.columns)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document appears once for each pass over it, as mix.apply defines it for nulls, ties and repeats."""
    return mix.apply(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The library's ids of each whole text, and the scores of its best segmentations; null text has no ids. Each row gives one."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "ids", "scores")


STAGES = [("quality", good), ("lines", fresh_lines), ("near_duplicates", distinct), ("mix", mixed), ("pieces", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
