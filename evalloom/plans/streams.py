"""Streaming queries, run to the end of what is there; their SQL is that of the batch query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.session import run_dir, table
from evalloom.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _source(spark: SparkSession, d: str, parts: int = 4) -> tuple[DataFrame, str]:
    root = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartitionByRange(parts, "ts").write.parquet(f"{root}/in")
    return live.follow(spark, f"{root}/in", SCHEMA), root


def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    s, root = _source(spark, d)
    w = live.windowed_counts(s, "ts", "event_type", "value", late="60 days")
    out = live.run_to_end(w, f"windows_{uuid.uuid4().hex}", "complete", root)
    return out.select(F.unix_date(F.to_date("start")).cast("long").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    s, root = _source(spark, d)
    r = live.deduplicated(s, "ts", ["user_id", "event_type"], late="60 days")
    return live.run_to_end(r.select("content_hash"), "dedup", "append", root)


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    s, root = _source(spark, d)
    out = live.run_to_end(live.sessions(s, "ts", "user_id", gap="30 minutes", late="60 days"), "sessions", "complete", root)
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


def stream_sequential_looks(spark: SparkSession, d: str) -> DataFrame:
    s, root = _source(spark, d)
    r = live.sequential_looks(s.withColumn("d", F.col("value") - 49.5), "event_type", "d", 500)
    return live.run_to_end(r, "looks", "append", root)


QUERIES = {f.__name__: f for f in (stream_windowed_counts, stream_deduplicated, stream_sessions, stream_sequential_looks)}
SQL = {
    "stream_windowed_counts": "SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS new FROM e),
        h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS part FROM g) SELECT user_id, min(t) AS start_us, count(*) AS n FROM h GROUP BY user_id, part""",
    "stream_deduplicated": "SELECT DISTINCT sha256(user_id || '|' || event_type) AS content_hash FROM events",
}
