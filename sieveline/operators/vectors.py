"""Vectors as array columns: similarities, search, and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.session import scratch, ship, stash


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, -1 to 1; 0 for a zero vector; different dimensions are an error."""
    whole = norm(a) * norm(b)
    value = F.when(whole > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / whole))).otherwise(0.0)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("dimensions differ")).cast("double"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def valid(vectors: DataFrame, column: str, dimension: int) -> DataFrame:
    """Rows whose vector has the dimension and only finite numbers."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where((F.size(column) == dimension) & fine)


def search(vectors: DataFrame, query: list[float], k: int = 10, least: float = 0.0, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows most like one stated query, of at least ``least``; a scan and a bounded top-k."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col(vector), asked)).where(F.col("score") >= least).orderBy(F.col("score").desc(), key).limit(k)


def _best(query: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The rows of each query's best ``k``, by score and then key."""
    order = np.lexsort((key, -score, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order], "left")
    return order[place < k]


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", key: str = "vec_id", most: int = 4096) -> DataFrame:
    """For each of a stated set of queries (``most`` at most, counted first) its k nearest rows by cosine.

    Queries are brought to unit length once and multiplied with a batch of rows at a time; a task keeps the best k of each
    query over all its batches, so at most that many rows of each task move.  Rows without a vector aren't compared, zero
    vectors are like nothing (0), and vectors of another dimension are an error.  Keys are whole numbers.
    """
    spark = vectors.sparkSession
    ship(spark)
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} queries; ask in blocks")
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    names = np.array([r[0] for r in asked], np.int64)
    shared = spark.sparkContext.broadcast((names, unit(np.array([r[1] for r in asked], float).reshape(len(asked), -1))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for lo in range(0, batch.num_rows if len(names) else 0, 1024):
                keys, column = batch.column(0).slice(lo, 1024).to_numpy(), batch.column(1).slice(lo, 1024)
                if len(set(np.diff(column.offsets.to_numpy())) - {matrix.shape[1]}):
                    raise ValueError("dimensions differ")
                score = np.clip(matrix @ unit(column.flatten().to_numpy().reshape(len(keys), -1)).T, -1.0, 1.0)
                score[names[:, None] == keys] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k, None] if k < len(keys) else np.full((len(names), 1), -np.inf)
                q, r = np.nonzero((score >= least) & (score > -np.inf))
                held = tuple(np.concatenate(x) for x in zip(held, (q, keys[r], score[q, r]), strict=True))
                best = _best(*held, k)
                held = tuple(x[best] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(names[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "key", "score"])

    some = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    local = some.mapInArrow(look, "query_id long, key long, score double")
    whole = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    kind = vectors.schema[key].dataType
    best = local.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= k)
    return best.select(F.col("query_id").cast(kind).alias("query_id"), F.col("key").cast(kind).alias(key), "score", "place")


def search_blocks(vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", key: str = "vec_id", most: int = 4096) -> DataFrame:
    """``search_many`` for any number of queries: they are cut by hash of the key into blocks of ``most`` at most, and
    each block is searched in all rows and stashed before the next, so one block at a time is broadcast.
    """
    total = queries.count()
    if total <= most:
        return search_many(vectors, queries, k, vector, key, most)
    blocks = -(-total // most)
    while True:
        cut = queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
        if (largest := cut.groupBy("_block").count().agg(F.max("count")).first()[0]) <= most:
            break
        if blocks > total:
            raise ValueError(f"{largest} queries of one block share their {key}; keys must be unique")
        blocks = blocks * 5 // 4 + 1
    with scratch(vectors.sparkSession) as keep:  # a block at a time; the parts go when they are one table
        parts = [stash(search_many(vectors, cut.where(F.col("_block") == i), k, vector, key, most), "similar") for i in range(blocks)]
        return keep(stash(reduce(DataFrame.unionByName, parts), "similar"))


def fuse(keyword: DataFrame, vector: DataFrame, key: str, keyword_weight: float = 0.4, vector_weight: float = 0.6, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (key, rank from 0) and (key, rank, raw); raw scores add a quarter of themselves."""
    a = keyword.select(F.col(key), (keyword_weight / (k + F.col("rank") + 1)).alias("_k"))
    b = vector.select(F.col(key), (vector_weight * (1 / (k + F.col("rank") + 1) + 0.25 * F.coalesce("raw", F.lit(0.0)))).alias("_v"))
    out = a.join(b, key, "full")
    origin = F.when(F.col("_v").isNull(), "keyword").when(F.col("_k").isNull(), "vector").otherwise("hybrid")
    return out.select(key, (F.coalesce("_k", F.lit(0.0)) + F.coalesce("_v", F.lit(0.0))).alias("score"), origin.alias("origin"))
