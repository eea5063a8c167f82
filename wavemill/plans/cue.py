"""Cue sheets as tables: parsing with DataFrame functions, whole columns of sheets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A line's keyword, number and rest.
_LINE = r"^\s*([A-Za-z]+)\s+(.*?)\s*$"


def parse(sheets: DataFrame, rate: int = 44100) -> DataFrame:
    """(sheet_id, catalog, files, track, isrc, point, frame) of sheets (sheet_id, text): a row an index point, stamps of 1/75 s rounded to the nearest frame.

    A line belongs to the last TRACK line before it. Points without a track, and stamps that aren't MM:SS:FF, have nulls
    that `rejects` tells.
    """
    lines = sheets.select("sheet_id", F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), "\r?\n")).alias("n", "line"))
    key = F.upper(F.regexp_extract("line", _LINE, 1))
    rest = F.regexp_extract("line", _LINE, 2)
    lines = lines.select("sheet_id", "n", key.alias("key"), rest.alias("rest"))
    before = Window.partitionBy("sheet_id").orderBy("n")
    track = F.when(F.col("key") == "TRACK", F.regexp_extract("rest", r"^(\d{1,3})\b", 1).try_cast("int"))
    number = F.last(track, True).over(before)
    lines = lines.withColumn("track", number).withColumn("opened", F.count(F.when(F.col("key") == "TRACK", 1)).over(before))
    whole = Window.partitionBy("sheet_id")
    own = Window.partitionBy("sheet_id", "opened")
    plain = lambda c: F.regexp_replace(c, '^"|"$', "")
    lines = lines.withColumn("catalog", F.max(F.when(F.col("key") == "CATALOG", plain("rest"))).over(whole))
    lines = lines.withColumn("files", F.count(F.when(F.col("key") == "FILE", 1)).over(whole))
    lines = lines.withColumn("isrc", F.max(F.when((F.col("key") == "ISRC") & (F.col("opened") > 0), plain("rest"))).over(own))
    at = [F.regexp_extract("rest", r"^(\d+)\s+(\d+):(\d+):(\d+)$", i).try_cast("decimal(20,0)") for i in range(1, 5)]
    frame = F.floor((((at[1] * 60 + at[2]) * 75 + at[3]) * rate + 37) / 75).cast("long")
    return lines.where("key = 'INDEX'").select("sheet_id", "catalog", "files", "track", "isrc", at[0].cast("int").alias("point"), frame.alias("frame"), "n")


def rejects(sheets: DataFrame, rate: int = 44100) -> DataFrame:
    """(sheet_id, reason) of the sheets that can't describe one stream."""
    points = parse(sheets, rate)
    order = Window.partitionBy("sheet_id").orderBy("n")
    steps = points.withColumn("step", F.col("frame") - F.lag("frame").over(order)).withColumn("up", F.col("track") - F.lag("track").over(order))
    bad = steps.groupBy("sheet_id").agg(
        F.max(F.col("files") > 1).alias("files"),
        F.max(F.col("track").isNull() | F.col("frame").isNull()).alias("lines"),
        F.max(F.coalesce(F.col("step") < 0, F.lit(False))).alias("back"),
        F.max(F.coalesce(F.col("up") < 0, F.lit(False))).alias("order"),
    )
    starts = points.groupBy("sheet_id", "track").agg(F.max((F.col("point") == 1).cast("int")).alias("one")).groupBy("sheet_id").agg(F.min("one").alias("one"))
    reason = F.when(F.col("files"), "files").when(F.col("lines"), "lines").when(F.col("order"), "order").when(F.col("one") == 0, "no start").when(F.col("back"), "backwards")
    return bad.join(starts, "sheet_id").select("sheet_id", reason.alias("reason")).where("reason is not null")
