"""Streaming residual coding: chunks are independent, so micro-batches need no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.integer import zigzag


def residuals(samples: DataFrame) -> DataFrame:
    """(stream_id, chunk, t, z) of samples (stream_id, chunk, t, x): order-2 differences within each chunk."""
    order = Window.partitionBy("stream_id", "chunk").orderBy("t")
    e = F.col("x") - 2 * F.lag("x", 1).over(order) + F.lag("x", 2).over(order)
    return samples.withColumn("e", e).where("e is not null").select("stream_id", "chunk", "t", zigzag(F.col("e")).alias("z"))


def write_residuals(chunks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Codes a stream of whole chunks (stream_id, chunk, samples array) into Parquet. A batch overwrites its own folder, so a repeated batch after a failure writes the same files once."""

    def batch(rows: DataFrame, number: int) -> None:
        long = rows.select("stream_id", "chunk", F.posexplode("samples").alias("t", "x"))
        residuals(long).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
