"""The URL registry as a stream: each URL's state is kept by Spark, and rows say how it changed.

``changes`` needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).  ``write`` puts each
micro-batch's rows into a folder of its own that a repeated batch replaces, so a query that restarts from its checkpoint
counts nothing twice.  ``read`` is the registry at any time: the last row of each URL, and the URLs that others named.

A micro-batch may bring its events in any order; events of a later one are later.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sieveline.operators.discovery import TERMINAL
from sieveline.operators.seeds import FAILURES, STATE, combined
from sieveline.session import ship

CHANGE = STATE + ", target string, first_seq long, first_source string, last_seq long"
_HELD = "source string, status string, checked long, final_url string, canonical_url string, reason string, status_code int, fail_count long, skip boolean"
_NAMES = [c.split()[0] for c in _HELD.split(", ")]


class UrlState(StatefulProcessor):
    """One URL's state; a row of it after each micro-batch, and one for each URL that it came to stand for in it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _HELD)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = dict(zip(_NAMES, self.held.get() if self.held.exists() else (None,) * len(_NAMES), strict=True))
        events = pd.concat(list(rows)).sort_values("seq")
        targets: dict[str, list] = {}
        for e in events.astype(object).where(events.notna(), None).to_dict("records"):
            given = {k: e[k] for k in ("source", "status", "status_code") if e[k] is not None}
            given |= {k: e[k] for k in ("final_url", "canonical_url", "reason") if e[k]}
            fails = (now["fail_count"] or 0) + 1 if e["status"] == "fetch_failed" else 0 if e["status"] == "ok" else now["fail_count"]
            over = e["status"] == "fetch_failed" and e["skip"] is None and fails >= FAILURES
            if over:
                given = {"reason": "fetch_failed_threshold"} | given
            stated = {"ok": False, **dict.fromkeys(TERMINAL, True), "fetch_failed": True if over else None}.get(e["status"])
            skip = e["skip"] if e["skip"] is not None else stated
            now |= given | {"checked": int(e["seq"]), "fail_count": fails} | ({} if skip is None else {"skip": bool(skip)})
            target = now["canonical_url"] or now["final_url"]
            if target and target != key[0]:
                targets.setdefault(target, [int(e["seq"]), e["source"], 0])[2] = int(e["seq"])
        now["status_code"] = None if now["status_code"] is None else int(now["status_code"])
        self.held.update(tuple(now[n] for n in _NAMES))
        named = [(t, *x) for t, x in targets.items()] or [(None, None, None, None)]
        yield pd.DataFrame([(key[0], *(now[n] for n in _NAMES), *t) for t in named], columns=[c.split()[0] for c in CHANGE.split(", ")]).astype({"status_code": "Int32", "fail_count": "Int64", "first_seq": "Int64", "last_seq": "Int64", "skip": "boolean"})

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """A stream of ``CHANGE`` rows for a stream of events (``operators.seeds.EVENT``)."""
    ship(events.sparkSession)
    return events.where("url is not null").groupBy("url").transformWithStateInPandas(UrlState(), CHANGE, "Update", "None")


def write(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start keeping the registry of a stream of events under ``path``; takes what there is and ends."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return changes(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The registry (``STATE``) that ``write`` has kept under ``path``."""
    rows = spark.read.schema(CHANGE + ", batch long").parquet(path)
    names = [c.split()[0] for c in STATE.split(", ")][1:]
    own = rows.groupBy("url").agg(F.max_by(F.struct(*names), "checked").alias("s")).select("url", "s.*")
    named = rows.where("target is not null").groupBy(F.col("target").alias("url")).agg(F.min(F.struct(F.col("first_seq").alias("seq"), F.col("first_source").alias("source"))).alias("first"), F.max("last_seq").alias("named"))
    return combined(own, named)
