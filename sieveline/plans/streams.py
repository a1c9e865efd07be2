"""Windowed counts over events, as the stream operators compute them, on the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.streaming import windows as op

_STAMP = "yyyy-MM-dd HH:mm:ss"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st1_rate_limit", "SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def st1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rate_limited(_events(spark, sf_dir), "event_type", 2).select("event_id", "allowed")


@query("st1_window_counts", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.counted(_events(spark, sf_dir), "event_type").select(F.date_format("window.start", _STAMP).alias("start"), "event_type", "n")


@query("st5_sessions", "WITH g AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, TRUE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def st5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sessions(_events(spark, sf_dir), "user_id").select("user_id", "n", F.round("total", 4).alias("total"))


@query("st7_daily_budget", "SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, round(sum(value), 4) AS cost, sum(value) > 1000 AS over FROM events GROUP BY 1")
def st7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.budget(_events(spark, sf_dir), "value").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.round("cost", 4).alias("cost"), "over")
