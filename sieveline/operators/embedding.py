"""Batch embedding: distinct texts that no valid cache row has go through an injected function, once each.

The model is a function over batches (a pandas Series of texts to an iterable of vectors), so any local model or client
can stand in for it.  Texts are trimmed first; blank ones have no vector.  What was computed is written before it is
used, so a lost executor or a second reader doesn't embed a text again.

Edge cases: null and blank texts have a null vector.  Repeated texts share one call and one vector.  Cache rows older than
``ttl`` count as absent; of several of a key the newest counts.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import ship, spare, stash

CACHE = "key string, vector array<double>, saved_at timestamp"
#: Texts that the function is given at once.
BATCH = 100


def text_key(text: Column, model: str) -> Column:
    """The key of a text: its digest with the model's name."""
    return F.sha2(F.concat(F.lit(model), text), 256)


def embedded(texts: DataFrame, text: str, model: str, embed: Callable[[pd.Series], Iterable], cache: DataFrame, now: Column, ttl: str = "30 days", batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """``texts`` with their ``vector``, every row as it was, and the new rows for ``cache`` (``CACHE``)."""
    spark = texts.sparkSession
    ship(spark)
    key, vector = spare(texts.columns, "key"), spare(texts.columns, "vector")
    body = F.nullif(F.btrim(F.col(text), F.lit(" \t\r\n\f\x0b")), F.lit(""))
    valid = cache.where(F.col("saved_at") + F.expr(f"interval {ttl}") > now).groupBy("key").agg(F.max_by("vector", "saved_at").alias("vector"))
    # A text that stands in very many rows is one row before it moves.
    wanted = texts.select(body.alias("body")).where("body is not null").groupBy("body").agg(F.lit(1).alias("one")).select("body", text_key(F.col("body"), model).alias("key"))
    missing = wanted.join(valid.select("key"), "key", "left_anti")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = list(embed(part["body"].reset_index(drop=True)))
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                yield pd.DataFrame({"key": part["key"].to_numpy(), "vector": [[float(x) for x in v] for v in vectors]})

    new = stash(missing.mapInPandas(call, "key string, vector array<double>").withColumn("saved_at", now), "embedded", sweep=False)
    known = valid.unionByName(new.select("key", "vector"))
    keyed = texts.withColumn(key, text_key(body, model))
    out = keyed.join(known.select(F.col("key").alias(key), F.col("vector").alias(vector)), key, "left").select(*texts.columns, vector)
    return out, new
