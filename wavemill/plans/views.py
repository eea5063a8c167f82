"""Signals derived from the driver's tables: one row a sample, in chunks of 4096 frames that are independent of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

#: Text of each view; {name} is another view or a table. Both engines read it.
VIEWS = {
    "sig": "SELECT event_id AS t, event_id div 4096 AS chunk, CAST(round(value * 100) AS BIGINT) AS x FROM {events}",
    "sig2": "SELECT event_id AS t, event_id div 4096 AS chunk, CAST(round(value * 100) AS BIGINT) AS l, CAST(user_id * 100 AS BIGINT) AS r FROM {events}",
    "sym": "SELECT event_id AS t, event_id div 4096 AS chunk, event_type AS v FROM {events}",
    "ordsig": "SELECT o_orderkey AS t, o_orderkey div 4096 AS chunk, CAST(round(o_totalprice * 100) AS BIGINT) AS x FROM {orders}",
    "lattice": "SELECT event_id AS t, event_id div 4096 AS chunk, 3 * CAST(round(value * 100) AS BIGINT) + 128 AS x FROM {events}",
    "res1": "SELECT t, chunk, x, x - lag(x, 1) OVER (PARTITION BY chunk ORDER BY t) AS e FROM {sig}",
    "zig1": "SELECT t, chunk, e, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS z, row_number() OVER (PARTITION BY chunk ORDER BY t) - 1 AS i FROM {res1} WHERE e IS NOT NULL",
    "chunks": "SELECT chunk, min(t) AS start_frame, count(*) AS frames FROM {sig} GROUP BY chunk",
    "tracks": "SELECT conv_id, track, start_frame, lead(start_frame, 1, total) OVER (PARTITION BY conv_id ORDER BY track) AS end_frame, total FROM (SELECT conv_id, turn AS track, turn * 588 * (1 + conv_id % 3) AS start_frame, count(*) OVER (PARTITION BY conv_id) * 588 * (1 + conv_id % 3) AS total FROM {conversations})",
}


def expand(text: str) -> str:
    """Text with every view put in as a subquery, down to {table} names."""
    while True:
        found = next((v for v in VIEWS if "{" + v + "}" in text), None)
        if found is None:
            return text
        text = text.replace("{" + found + "}", f"({VIEWS[found]}) AS {found}")


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = expand(text)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duckdb(text: str) -> str:
    """The same text in the other engine's spelling."""
    text = expand(text)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.replace(" div ", " // ")
