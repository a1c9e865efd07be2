"""Orders, limits, and what a reader of ranked lists does: first, last and best of each group, packing, diversity.

Windows over a whole result are only used after a top-k limit; within groups everything is a partitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.session import numbered, scratch, stash


def source_priority() -> list[Column]:
    """Order of trust: tier, then scores, then how recently it was seen; ids settle ties."""
    t = F.coalesce("tier", F.lit("tier_unknown"))
    rank = F.when(t == "tier_1_official", 0).when(t == "tier_2_ngo_watchdog", 1).when(t == "tier_4_academic", 2).when(t == "tier_3_press", 3).otherwise(4)
    return [rank, F.coalesce("ais", F.lit(0.0)).desc(), F.coalesce("iqs", F.lit(0.0)).desc(), F.col("last_seen").desc_nulls_last(), F.col("first_seen").desc_nulls_last(), F.col("id")]


def placed(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with each row's place (from 1) in its group; groups may be few and huge, so places come from ranges of
    group and order, less the first place of the group.  A null group is a group.
    """
    with scratch(df.sparkSession) as keep:  # the ranges go once their rows have their places
        rows = numbered(df, [F.col(group).asc_nulls_last(), *order], "_place")
        first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
        out = rows.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn("place", (F.col("_place") - F.col("_first") + 1).cast("long")).drop("_place", "_group", "_first")
        return keep(stash(out, "placed", sweep=False))


def page(df: DataFrame, order: list[Column | str], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """One page of an order; pages have at most ``most`` rows."""
    size = min(size, most)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_of(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def last_of(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the last row of each group; later columns of ``order`` settle ties, nulls come first."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    return last.select(*keys, "_last.*")


def best_or_keyless(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The best-scored row of each key; rows without a key all stay."""
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    return first_of(df.where(keyed), [key], [F.col(score).desc(), tie]).unionByName(df.where(~keyed))


def ends(df: DataFrame, keys: list[str], order: str, first: int, last: int) -> DataFrame:
    """The first and the last few rows of each group."""
    w = Window.partitionBy(*keys)
    both = df.withColumns({"_a": F.row_number().over(w.orderBy(order)), "_z": F.row_number().over(w.orderBy(F.col(order).desc()))})
    return both.where((F.col("_a") <= first) | (F.col("_z") <= last)).drop("_a", "_z")


def pack(df: DataFrame, keys: list[str], order: list[str], size: Column, budget: int, partial: int) -> DataFrame:
    """Rows of each group while their running size fits the budget; the row that crosses it is cut if more than ``partial`` is left."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.withColumn("_size", size).withColumn("_end", F.sum("_size").over(w)).withColumn("_left", budget - (F.col("_end") - F.col("_size")))
    crossing = (F.col("_end") > budget) & (F.col("_left") > partial)
    out = run.withColumns({"included": F.when(F.col("_end") <= budget, F.col("_size")).when(crossing, F.col("_left")), "cut": crossing})
    return out.where("included is not null").drop("_size", "_end", "_left")


def shortlist(df: DataFrame, query: str, group: str, order: list[Column | str], groups: int, limit: int, key: str, salts: int = 64) -> DataFrame:
    """All rows that ``diversify`` can return: the best ``limit`` of each query and the best of its foremost groups.

    No task takes a whole query or group: rows are first dealt by hash of ``key`` and only the best of each part go on.
    """
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    part = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    part = part.withColumn("_n", nth(query, group, "_salt")).where(F.col("_n") <= limit)
    part = part.withColumn("_lead", nth(query, group) == 1)
    part = part.withColumn("_n", nth(query, "_salt", "_lead")).where((F.col("_n") <= limit) | (F.col("_lead") & (F.col("_n") <= groups + 1)))
    return part.drop("_salt", "_n", "_lead")


def diversify(df: DataFrame, query: str, group: str, order: list[Column | str], groups: int, limit: int, key: str = "id") -> DataFrame:
    """For each query its best hit, then the best of each of up to ``groups`` groups, then the rest by order; ``key``
    spreads the rows of a query over tasks.
    """
    q = Window.partitionBy(query)
    ranked = shortlist(df, query, group, order, groups, limit, key).withColumn("_place", F.row_number().over(q.orderBy(*order)))
    ranked = ranked.withColumn("_of", F.row_number().over(Window.partitionBy(query, group).orderBy("_place")))
    leads = F.row_number().over(q.orderBy(F.col("_of") != 1, "_place"))
    kind = F.when(F.col("_place") == 1, 0).when((F.col("_of") == 1) & (F.col("_lead") <= groups), 1).otherwise(2)
    ranked = ranked.withColumn("_lead", leads).withColumn("_kind", kind)
    ranked = ranked.withColumn("position", F.row_number().over(q.orderBy("_kind", "_place")))
    return ranked.where(F.col("position") <= limit).drop("_place", "_of", "_lead", "_kind")
