"""Greedy batches in parallel: rows in order fill a batch until the next one would not fit.

Where a batch ends depends on where it began, so a loop over the rows would do it.  Here every row first learns, by binary
search on running sums, where the next batch would begin if one began at it; a batch has at most ``most_rows`` rows, so
that is in its block of rows or the next one.  Following this within a block tells where a batch that enters the block at
a row leaves it, for the few rows at which one can enter.  Joins that double the number of blocks then find the row at
which a batch really enters each block, and each block is cut from there.

Edge cases: a row that is larger than a batch may be is a batch of its own and marked.  Sizes that are null count as 0.
Rows that are equal in the order stand in any order, which another run may change.  A key's rows never share a batch with
another key's.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import numbered, scratch, ship, spare, stash

#: Rows of a block, if a batch's most rows are fewer.
BLOCK = 1 << 16


def next_starts(size: np.ndarray, key: np.ndarray, most_rows: int, most_size: int, base: int, between: int) -> np.ndarray:
    """For each row where the next batch begins if one begins there: a batch weighs base + sizes + between for each gap."""
    n = len(size)
    total = np.concatenate([[0], np.cumsum(size + between)])
    fits = np.searchsorted(total, total[:-1] + (most_size - base + between), "right") - 1
    edge = np.append(np.flatnonzero(np.diff(key)) + 1, n)
    end = edge[np.searchsorted(edge, np.arange(n), "right")]
    return np.maximum(np.minimum(np.minimum(fits, np.arange(n) + most_rows), end), np.arange(n) + 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks of rows that are sorted by block and place."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and block[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = block[a]
    if held:
        yield pa.Table.from_batches(held)


def greedy(df: DataFrame, key: Column, order: list[Column], size: Column, most_rows: int, most_size: int, base: int = 0, between: int = 0, block: int = BLOCK) -> DataFrame:
    """``df`` with batch (a number from 0, in order over all keys) and oversize (a row that no batch of others has room for)."""
    ship(df.sparkSession)
    block = max(block, most_rows)
    batch, oversize, place, owner, weight = (spare(df.columns, n) for n in ("batch", "oversize", "place", "owner", "weight"))
    with scratch(df.sparkSession) as keep:
        weighed = df.withColumns({owner: key.cast("string"), weight: F.coalesce(size, F.lit(0)).cast("long")})
        rows = stash(numbered(weighed, [F.col(owner), *order], place), "places", sweep=False)
        spots = rows.select(F.floor(F.col(place) / block).alias("block"), F.col(place).alias("place"), F.xxhash64(owner).alias("owner"), F.col(weight).alias("weight"))
        # Each block also sees the rows of the next one that a batch of its own may reach.
        seen = spots.union(spots.where((F.col("place") % block < most_rows) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1))
        dealt = seen.repartition("block").sortWithinPartitions("block", "place")

        def starts(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, int]:
            number = table.column("block")[0].as_py()
            where, who, heavy = (table.column(c).to_numpy() for c in ("place", "owner", "weight"))
            own = int(np.searchsorted(where, (number + 1) * block))
            return number, where, next_starts(heavy, who, most_rows, most_size, base, between), own

        def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(block, enter, leave, begun): a batch that begins at a row of the block, the first one that begins in the next, and how many begin between."""
            for table in _blocks(batches):
                number, where, following, own = starts(table)
                leave, begun = following.copy(), np.ones(len(where), np.int64)
                while (inside := leave[:own] < own).any():
                    step = np.flatnonzero(inside)
                    begun[step] += begun[leave[step]]
                    leave[step] = leave[leave[step]]
                some = np.arange(min(own, most_rows if number else 1))
                over = leave[some] == len(where)  # no row is left for another batch
                ends = pa.array(np.append(where, 0)[leave[some]], mask=over)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(where[some]), ends, pa.array(begun[some])], names=["block", "enter", "leave", "begun"])

        jumps = stash(dealt.mapInArrow(cross, "block long, enter long, leave long, begun long"), "jumps", sweep=False)
        blocks = jumps.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
        entered = stash(jumps.where("enter = 0").select("enter", F.lit(0).cast("long").alias("before")), "entered", sweep=False)
        reach = 1
        while reach < blocks:
            # Those that are known reach as far again; then every jump spans twice as many blocks.
            further = entered.join(jumps, "enter").select(F.col("leave").alias("enter"), (F.col("before") + F.col("begun")).alias("before"))
            entered = stash(entered.union(further.where("enter is not null")), "entered", sweep=False)
            after = jumps.select(F.col("enter").alias("leave"), F.col("leave").alias("end"), F.col("begun").alias("more"))
            jumps = stash(jumps.join(after, "leave").select("block", "enter", F.col("end").alias("leave"), (F.col("begun") + F.col("more")).alias("begun")), "jumps", sweep=False)
            reach *= 2

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _blocks(batches):
                number, where, following, own = starts(table)
                at, before = int(np.searchsorted(where, table.column("enter")[0].as_py())), table.column("before")[0].as_py()
                begins = np.zeros(own, np.int64)
                while at < own:
                    begins[at] = 1
                    at = int(following[at])
                # Rows before the first batch that begins here belong to the last one of the block before.
                yield pa.RecordBatch.from_arrays([pa.array(where[:own]), pa.array(before - 1 + np.cumsum(begins))], names=["place", "batch"])

        known = entered.select(F.floor(F.col("enter") / block).alias("block"), "enter", "before")
        told = seen.join(known, "block").repartition("block").sortWithinPartitions("block", "place").mapInArrow(cut, "place long, batch long")
        out = rows.join(told.select(F.col("place").alias(place), F.col("batch").alias(batch)), place)
        return keep(stash(out.select(*df.columns, batch, (F.col(weight) + base > most_size).alias(oversize)), "batches", sweep=False))
