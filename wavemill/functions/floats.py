"""Float32 samples, as bit patterns, on an integer grid: k / 2**scale exactly, with what is off the grid as exceptions. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern of -0.0, the largest scale and grid value.
NEGATIVE_ZERO, MOST_SCALE, MOST_GRID = 1 << 31, 31, (1 << 31) - 1


def parts(bits: Column) -> tuple[Column, Column, Column]:
    """(finite, m, e): the value is m * 2**e."""
    field, low = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
    m = F.when(field == 0, low).otherwise(low + (1 << 23))
    return field != 255, F.when(bits >= 1 << 31, -m).otherwise(m), F.when(field == 0, F.lit(-149)).otherwise(field - 150).cast("long")


def least_scale(bits: Column) -> Column:
    """The least s for which the value is an integer over 2**s; null for what is never on a grid."""
    finite, m, e = parts(bits)
    zeros = F.bit_count(m.bitwiseAND(-m) - 1)
    return F.when(finite & (bits != NEGATIVE_ZERO), F.when(m == 0, 0).otherwise(F.greatest(F.lit(0), -e - zeros)).cast("long"))


def grid_value(bits: Column, scale: Column) -> Column:
    """k with k / 2**scale exactly the value, at most 2**31 - 1 in magnitude; null where there is none."""
    finite, m, e = parts(bits)
    shift = e + scale
    down = F.least(F.greatest(-shift, F.lit(0)), F.lit(40)).cast("int")
    up = F.least(F.greatest(shift, F.lit(0)), F.lit(38)).cast("int")
    step = F.call_function("shiftleft", F.lit(1).cast("long"), down)
    k = F.when(shift >= 0, F.call_function("shiftleft", m.cast("long"), up)).otherwise(F.when(m % step == 0, F.call_function("shiftright", m.cast("long"), down)))
    k = F.when(m == 0, F.lit(0).cast("long")).otherwise(F.when(shift <= 38, k))
    return F.when(finite & (bits != NEGATIVE_ZERO) & (F.abs(k) <= MOST_GRID), k)


def pattern(k: Column, scale: Column) -> Column:
    """Bits of k / 2**scale, which fits a float32 exactly."""
    a = F.abs(k)
    top = F.length(F.bin(a)) - 1
    low = F.when(top <= 23, F.call_function("shiftleft", a, F.greatest(F.lit(0), 23 - top).cast("int"))).otherwise(F.call_function("shiftright", a, F.greatest(F.lit(0), top - 23).cast("int")))
    bits = F.when(k < 0, F.lit(1 << 31)).otherwise(F.lit(0).cast("long")) + (top - scale + 127) * (1 << 23) + low - (1 << 23)
    return F.when(k == 0, F.lit(0)).otherwise(bits).cast("long")


def to_grid(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((stream_id, channel, t, x, exception), (stream_id, scale, bits)) of samples (stream_id, channel, t, bits).

    The scale is the least that suits every value of the stream, 31 at most; exception holds the bits of what is off that
    grid, whose x is 0. bits is the container width that the grid values need.
    """
    scale = samples.groupBy("stream_id").agg(F.least(F.coalesce(F.max(least_scale(F.col("bits"))), F.lit(0)), F.lit(MOST_SCALE)).cast("long").alias("scale"))
    rows = samples.join(scale, "stream_id").withColumn("_k", grid_value(F.col("bits"), F.col("scale")))
    mapped = rows.select("stream_id", "channel", "t", F.coalesce("_k", F.lit(0)).alias("x"), F.when(F.col("_k").isNull(), F.col("bits")).alias("exception"))
    peak = F.max(F.abs("x"))
    width = F.when(peak < 1 << 7, 8).when(peak < 1 << 15, 16).when(peak < 1 << 23, 24).otherwise(32)
    return mapped, mapped.groupBy("stream_id").agg(width.alias("bits")).join(scale, "stream_id").select("stream_id", "scale", "bits")


def from_grid(mapped: DataFrame, info: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(stream_id, channel, t, bits) from grid values (stream_id, channel, t, x), their scales, and exceptions (stream_id, channel, t, bits), which overlay them."""
    laid = exceptions.select("stream_id", "channel", "t", F.col("bits").alias("_own"))
    rows = mapped.join(info.select("stream_id", "scale"), "stream_id").join(laid, ["stream_id", "channel", "t"], "left")
    return rows.select("stream_id", "channel", "t", F.coalesce("_own", pattern(F.col("x"), F.col("scale"))).alias("bits"))


def rebased(exceptions: DataFrame, first: int, frames: int) -> DataFrame:
    """The exceptions of [first, first + frames), counted from its start."""
    return exceptions.where((F.col("t") >= first) & (F.col("t") < first + frames)).withColumn("t", F.col("t") - first)
