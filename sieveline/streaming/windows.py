"""Windowed and stateful stream operators; each works on a stream and on a batch alike unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sieveline.session import ship


def counted(events: DataFrame, key: str, size: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Requests of each key in fixed windows; rows later than the watermark don't count."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("window"), key).agg(F.count("*").alias("n"))


def rate_limited(events: DataFrame, key: str, most: int, size: str = "1 hour", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Batch: which events a fixed-window limit lets through."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key, F.window(time, size)["start"]).orderBy(time, tie)
    return events.withColumn("allowed", F.row_number().over(w) <= most)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Sessions of each key: events no more than a gap apart."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def budget(events: DataFrame, cost: str, size: str = "1 day", late: str = "1 day", most: float = 1000.0, time: str = "ts") -> DataFrame:
    """Cost by window, and whether it is over the budget."""
    out = events.withWatermark(time, late).groupBy(F.window(time, size).alias("window")).agg(F.sum(cost).alias("cost"))
    return out.withColumn("over", F.col("cost") > most)


def _registry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Failures in a row of one key; three make it skipped until it succeeds again."""
    fails = state.get[0] if state.exists else 0
    for rows in batches:
        for ok in rows.sort_values(["ts", "event_id"])["ok"]:
            fails = 0 if ok else fails + 1
    state.update((fails,))
    yield pd.DataFrame({"user_id": [key[0]], "failures": [fails], "skip": [fails >= 3]})


def failure_registry(events: DataFrame) -> DataFrame:
    """Stream of (user_id, ts, event_id, ok): each key's failures in a row, after every micro-batch."""
    ship(events.sparkSession)
    return events.groupBy("user_id").applyInPandasWithState(_registry, "user_id long, failures long, skip boolean", "failures long", "update", GroupStateTimeout.NoTimeout)
