"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_bounded, materialize, table, word_count

#: Largest block in tokens, blocks of an average source, tokens of a shard, shards of a source at most.
MAX_BLOCK, BLOCKS_PER_SOURCE, SHARD_TOKENS, MAX_SHARDS = 4096, 1000, 1 << 17, 1 << 16
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, s) -> (source, s, rank, w, cap, target): shares of the whole size by weight, none above `most` times its source.

    Sources rank by code point, null last; weights repeat by rank. Sources fill in order of cap over weight: one is full
    if the share of what is left would reach its cap, and that holds for a prefix of the order, so windows are enough.
    """
    scale = lcm(*weights)
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("long")
    rows = sizes.withColumn("rank", F.row_number().over(by_rank)).withColumn("w", w).withColumn("cap", F.col("s") * most)
    fill = Window.orderBy((F.col("s") * (F.lit(scale) / F.col("w")).cast("long")).asc(), "rank")
    whole = Window.partitionBy()
    dec = lambda c: c.cast("decimal(38,0)")
    rows = (
        rows.withColumn("total", F.sum("s").over(whole))
        .withColumn("before", F.sum("cap").over(fill) - F.col("cap"))
        .withColumn("w_from", F.sum("w").over(whole) - F.sum("w").over(fill) + F.col("w"))
        .withColumn("full", dec(F.col("cap")) * F.col("w_from") <= dec(F.col("total") - F.col("before")) * F.col("w"))
    )
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole)
    share = ((F.col("total") - taken) * F.col("w")).cast("double") / open_w.cast("double")
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)).withColumn("open", F.col("total") - taken).select("source", "s", "rank", "w", "cap", "target", "total", "open")


def apportion(rows: DataFrame, within: list[str], claim: str, seats: str, cap: str, tie: str, reach: Column) -> DataFrame:
    """Adds quota: how many of the `seats` highest quotients claim/(2k+1), k < cap, a row holds.

    The divisor method rounds claim * seats / sum of claims up to a few seats, so only quotients within `reach` of that
    are ranked; those below are certain. reach must bound the drift; candidates stay linear in the number of rows.
    """
    part = Window.partitionBy(*within)
    near = F.floor(F.col(claim) * F.col(seats) / F.sum(claim).over(part) + 0.5).cast("long")
    near = F.coalesce(near, F.lit(0))
    rows = rows.withColumn("_near", near).withColumn("_reach", reach)
    rows = rows.withColumn("_low", F.least(F.col(cap), F.greatest(F.lit(0), F.col("_near") - F.col("_reach"))))
    rows = rows.withColumn("_high", F.least(F.col(cap), F.col("_near") + F.col("_reach")))
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_low").over(part))
    seat = F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)))
    order = Window.partitionBy(*within).orderBy(F.col("_q").desc(), F.col(tie))
    won = (
        rows.select(*within, tie, "_left", F.col(claim).alias("_c"), seat.alias("_k"))
        .where("_c > 0")
        .withColumn("_q", F.col("_c").cast("double") / (2 * F.col("_k") + 1))
        .withColumn("_n", F.row_number().over(order))
        .where("_n <= _left")
        .groupBy(*within, tie)
        .agg(F.count("*").alias("_won"))
    )
    return rows.join(won, [*within, tie], "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_near", "_reach", "_low", "_high", "_left", "_won")


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = SEED, keep: tuple[str, ...] = (), store: bool = True) -> DataFrame:
    """What the mix takes of each row of docs (doc_id, text, source).

    Sizes are words. A block has B words: 1/1000 of an average source, 1 to 4096. Every source is dealt by a seeded hash
    to shards of about 2**17 words (65,536 shards at most), so a hot source is never one task. Blocks go to sources by the
    highest quotients target/(2k+1), and a source's blocks to its shards by the highest quotients size/(2k+1). A shard
    lays its rows in seeded order end to end, over and over, and takes its first quota * B words, 3 times its size at
    most: `whole` full passes, then `part` words of the next.

    Defined cases: null or blank text has size 0 and takes 0; null source is a source of its own, ranked last; an empty
    table gives no rows; repeated rows count one by one; null doc_id is hashed as an empty string; other columns are
    ignored unless named in keep (keep the names of mix columns out of it).
    """
    rows = docs.select("doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")], word_count(F.col("text")).alias("size"))
    if store:  # sizes only: the scan and the count of words happen once
        rows = materialize(rows, "mix-sizes")
    sized = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("_rows"))
    src = targets(sized.drop("_rows"), weights, most)
    n, whole = F.count("*").over(Window.partitionBy()), Window.partitionBy()
    src = src.withColumn("block", F.least(F.lit(MAX_BLOCK), F.greatest(F.lit(1), F.floor(F.col("total") / (n * BLOCKS_PER_SOURCE)))).cast("long"))
    src = src.withColumn("n", n).withColumn("seats", F.floor(F.col("total") / F.col("block")).cast("long"))
    src = src.withColumn("most", F.ceil(F.col("cap") / F.col("block")).cast("long")).withColumn("_all", F.lit(0))
    drift = F.coalesce(F.floor(2 * F.col("n") * F.col("target") / F.col("open")), F.lit(0)).cast("long") + 3
    src = apportion(src, ["_all"], "target", "seats", "most", "rank", F.when(F.col("open") > 0, drift).otherwise(F.lit(3).cast("long")))
    per = F.greatest(F.lit(SHARD_TOKENS).cast("long"), F.floor(F.col("s") / MAX_SHARDS).cast("long"))
    src = src.withColumn("shards", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("s") / per).cast("long")))
    src = materialize(src.select(F.col("source").alias("_source"), F.col("rank").alias("src"), F.col("s").alias("source_size"), "target", "quota", "block", "shards"), "mix-sources")
    lot = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    number = src.count()
    dealt = rows.join(F.broadcast(src) if number <= 100_000 else src, rows["source"].eqNullSafe(src["_source"])).drop("_source")
    dealt = dealt.withColumn("_lot", lot).withColumn("shard", (F.conv(F.substring("_lot", 1, 8), 16, 10).cast("long") % F.col("shards")).cast("int"))
    parts = dealt.groupBy("src", "shard", "quota", "block", "source_size").agg(F.sum("size").alias("words"), F.count("*").alias("_rows"))
    parts = parts.withColumn("most", F.ceil(F.col("words") * most / F.col("block")).cast("long"))
    drift = F.coalesce(F.floor(2 * F.count("*").over(Window.partitionBy("src")) * F.col("words") / F.col("source_size")), F.lit(0)).cast("long") + 3
    parts = apportion(parts, ["src"], "words", "quota", "most", "shard", drift)
    parts = parts.select("src", "shard", "words", F.least(F.col("quota") * F.col("block"), F.col("words") * most).alias("take"))
    line = Window.partitionBy("src", "shard").orderBy("_lot", "doc_id", "size")
    run = dealt.drop("quota").join(parts, ["src", "shard"]).withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    passes = F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(0).cast("long")
    rest = F.col("take") - passes * F.col("words")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_end"), rest) - (F.col("_end") - F.col("size")))
    out = run.withColumn("whole", passes).withColumn("part", part).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    return out.select("doc_id", *[c for c in keep if c != "doc_id"], *(["source"] if "source" not in keep else []), "size", "source_size", "target", "taken", "whole", "part", "shard")


def apply(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = SEED) -> DataFrame:
    """The mixed corpus, with the columns of documents: a row for each full pass over a document, and one cut to its first `part` words if the last pass ends inside it (one document a shard at most). n_chars follows the text; rows taken 0 times go, as do texts without words."""
    own = plan(docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), weights, most, seed, keep=("_row",), store=False)
    copies = F.transform(F.sequence(F.lit(0), F.col("whole")), lambda k: F.when(k < F.col("whole"), F.col("size")).otherwise(F.col("part")))
    cut = own.withColumn("_n", F.explode(F.filter(copies, lambda x: x > 0)))
    whole = F.col("_row.text")
    pieces = F.split(whole, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(whole.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    short = F.array_join(F.slice(pieces, F.lit(1), F.col("_n").cast("int") + lead), "")
    part = F.col("_n") < F.col("size")
    made = {c: F.col("_row").getField(c) for c in docs.columns} | {"text": F.when(part, short).otherwise(whole)}
    if "n_chars" in made:
        made["n_chars"] = F.when(part, F.length(short)).otherwise(made["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(c.alias(n) for n, c in made.items()))


def op5_source_mix(spark, sf_dir):
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "whole", "part", "shard")


ORACLE = f"""
WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS s FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized),
weighed AS (SELECT *, ((rank - 1) % 3 + 1)::BIGINT AS w, 3 * s AS cap, sum(s) OVER ()::BIGINT AS total FROM ranked),
tried AS (SELECT a.rank, a.cap * sum(b.w) <= (a.total - coalesce(sum(b.cap) FILTER (WHERE NOT b.later), 0)) * a.w AS full_ FROM weighed a
  JOIN LATERAL (SELECT CASE WHEN (x.cap * a.w, x.rank) >= (a.cap * x.w, a.rank) THEN x.w ELSE 0 END AS w, x.cap, (x.cap * a.w, x.rank) >= (a.cap * x.w, a.rank) AS later FROM weighed x) b ON true GROUP BY a.rank, a.cap, a.total, a.w),
filled AS (SELECT w.*, t.full_ FROM weighed w JOIN tried t USING (rank)),
aimed AS (SELECT *, CASE WHEN full_ THEN cap::DOUBLE ELSE ((total - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) * w)::DOUBLE / (sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ())::DOUBLE END AS target,
  least({MAX_BLOCK}, greatest(1, total // (count(*) OVER () * {BLOCKS_PER_SOURCE})))::BIGINT AS block FROM filled),
source_seats AS (SELECT rank, target / (2 * k + 1) AS q, k FROM aimed, LATERAL (SELECT unnest(range(0, ((cap + block - 1) // block)::BIGINT)) AS k) WHERE target > 0),
won AS (SELECT rank, count(*) AS quota FROM (SELECT rank, row_number() OVER (ORDER BY q DESC, rank) AS n FROM source_seats) WHERE n <= (SELECT max(total // block) FROM aimed) GROUP BY rank),
src AS (SELECT a.*, coalesce(w.quota, 0)::BIGINT AS quota, greatest(1, ceil(s / greatest({SHARD_TOKENS}, s // {MAX_SHARDS})))::BIGINT AS shards FROM aimed a LEFT JOIN won w USING (rank)),
lots AS (SELECT *, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS lot FROM base),
dealt AS (SELECT l.*, r.rank, r.s AS source_size, r.target, r.quota, r.block, (('0x' || substr(l.lot, 1, 8))::BIGINT % r.shards)::INTEGER AS shard FROM lots l JOIN src r ON l.source IS NOT DISTINCT FROM r.source),
parts AS (SELECT rank, shard, quota, block, sum(size)::BIGINT AS words FROM dealt GROUP BY ALL),
shard_seats AS (SELECT rank, shard, quota, words::DOUBLE / (2 * k + 1) AS q FROM parts, LATERAL (SELECT unnest(range(0, ((3 * words + block - 1) // block)::BIGINT)) AS k) WHERE words > 0),
shard_won AS (SELECT rank, shard, count(*) AS got FROM (SELECT rank, shard, quota, row_number() OVER (PARTITION BY rank ORDER BY q DESC, shard) AS n FROM shard_seats) WHERE n <= quota GROUP BY rank, shard),
takes AS (SELECT p.rank, p.shard, p.words, least(coalesce(g.got, 0) * p.block, 3 * p.words)::BIGINT AS take FROM parts p LEFT JOIN shard_won g USING (rank, shard)),
line AS (SELECT d.*, t.words, t.take, (sum(size) OVER (PARTITION BY d.rank, d.shard ORDER BY lot, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS finish FROM dealt d JOIN takes t USING (rank, shard)),
passes AS (SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS whole FROM line),
cut AS (SELECT *, greatest(0, least(finish, take - whole * words) - (finish - size))::BIGINT AS part FROM passes)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken, source, whole::BIGINT AS whole, part, shard FROM cut
"""
