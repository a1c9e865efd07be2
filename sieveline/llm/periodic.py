"""Periodic runs: stretches of words that repeat with a period, found by comparing a text with itself at every lag.

A run is a stretch of consecutive words in which words ``period`` apart are equal, that no neighbouring word extends,
whose smallest period that is, and whose length is at least ``least`` words and at least twice the period.

A lag is one vectorised comparison of the array of word ids with itself shifted; stretches of equal words that are long
enough are the runs of that lag.  Texts are scanned many at a time, the longest first, so that a lag meets only those that
are long enough for it.  A text of more than ``LONG`` words is dealt out instead: ranges of its lags, each about ``WORK``
comparisons, are rows of their own that Spark spreads over the cluster.  A stretch that also has a smaller period shows at
that lag with the same start and length (by maximality), so the smallest period of each (start, length) is kept.

Words are compared by ids of a dictionary of their bytes, not by hashes.

Edge cases: null and empty texts have no words, no runs and an empty collapsed text.  Texts with fewer words than
``least`` have no run.  Repeated rows and repeated or null ids are each described by themselves; long texts that are
equal are scanned once.  An empty table gives an empty result.  Columns of docs stay; a new one whose name is taken gets
underscores before it.  A text may be as long as a row can be: work grows with the square of its words, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import text as tx
from sieveline.session import ship, spare

#: Fewest words of a run, and fewest periods in it.
LEAST, MIN_EXP = 12, 2
#: Words from which a text's lags are dealt out, and the comparisons of one range of lags.
LONG, WORK = 1 << 14, 1 << 27
#: Bytes of text that are scanned together: few enough for their word ids to stay in a core's cache.
SCAN = 1 << 20

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def word_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, np.int32)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    solid = np.ascontiguousarray(raw[~tx.SPACE[raw]])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(solid)])
    return column.dictionary_encode().indices.to_numpy()


def scan(ids: np.ndarray, first: np.ndarray, lags: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of the runs at ascending ``lags``; text i is ids[first[i]:first[i + 1]]."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    cut = np.concatenate([[0], np.cumsum(size)])
    body = ids[np.arange(cut[-1]) + np.repeat(first[:-1][order] - cut[:-1], size)]
    live = np.searchsorted(-size, -np.maximum(MIN_EXP * lags, least), "right")
    same = np.empty(len(body), bool)
    found = [np.zeros((0, 4), np.int64)]
    for lag, texts in zip(lags.tolist(), live.tolist(), strict=True):
        if not texts:
            break
        end = cut[texts]
        need = max((MIN_EXP - 1) * lag, least - lag)
        hit = np.flatnonzero(np.equal(body[: end - lag], body[lag:end], out=same[: end - lag]))
        if len(hit) < need:
            continue
        dense = hit[: len(hit) - need + 1][hit[need - 1 :] - hit[: len(hit) - need + 1] == need - 1]
        if not len(dense):
            continue
        new = np.flatnonzero(np.diff(dense, prepend=-2) != 1)
        begin, stop = dense[new], dense[np.append(new[1:], len(dense)) - 1] + need
        # A stretch that runs on into the next text is cut at the last word that has one ``lag`` after it in its own.
        low, high = np.searchsorted(cut, begin, "right") - 1, np.searchsorted(cut, stop, "left") - 1
        each = high - low + 1
        text = np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())
        begin, stop = np.maximum(np.repeat(begin, each), cut[text]), np.minimum(np.repeat(stop, each), cut[text + 1] - lag)
        kept = stop - begin >= need
        text, begin, stop = text[kept], begin[kept], stop[kept]
        found.append(np.stack([order[text], begin - cut[text], stop - begin + lag, np.full(len(text), lag)], 1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (np.diff(rows[:, :3], axis=0) != 0).any(1))[: len(rows)]]


def collapse(raw: np.ndarray, at: np.ndarray, words: tuple[np.ndarray, ...], rows: np.ndarray) -> pa.Array:
    """Each text's words joined by one space, without those that come after a run's first period."""
    starts, ends, first = words
    n, texts = len(starts), len(at) - 1
    begin = first[:-1][rows[:, 0]] + rows[:, 1]
    depth = np.bincount(begin + rows[:, 3], minlength=n + 1) - np.bincount(begin + rows[:, 2], minlength=n + 1)
    kept = np.flatnonzero(np.cumsum(depth)[:n] == 0)
    owner = np.searchsorted(first, kept, "right") - 1
    follows = kept[np.append(owner[1:] == owner[:-1], False)[: len(kept)]] if len(kept) else kept
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts[kept]] += 1
    edge[ends[kept]] -= 1
    left = np.cumsum(edge[:-1], dtype=np.int8) > 0
    left[ends[follows]] = True
    body = raw.copy()
    body[ends[follows]] = 0x20
    offsets = np.concatenate([[0], np.cumsum(left)])[at].astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), texts, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body[left]))])
    return column.cast(pa.string())


def _listed(rows: np.ndarray, texts: int) -> pa.Array:
    """The runs of each text, by start, then period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    at = np.searchsorted(rows[:, 0], np.arange(texts + 1)).astype(np.int32)
    columns = [pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3)]
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(columns, names=["start", "length", "period"]))


def _dealt(docs: DataFrame, key: str, text: str, long: int, work: int, least: int) -> DataFrame:
    """``key`` and runs of the long texts of ``docs``; one row for each key that has some."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, at in tx.blocks(batch.column(1), 1):
                starts, ends, _ = tx.words(raw, at)
                ids = word_ids(raw, starts, ends)
                step, top = max(1, work // max(1, len(ids))), len(ids) // MIN_EXP + 1
                for low in range(1, top, step):
                    columns = [batch.column(0).slice(lo, 1), pa.array([low], pa.int64()), pa.array([min(low + step, top)], pa.int64()), tx.lists(ids, np.array([len(ids)]), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "low", "high", "ids"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, cut, body = (batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy())
            for i in range(len(low)):
                ids = body[cut[i] : cut[i + 1]]
                rows = scan(ids, np.array([0, len(ids)]), np.arange(low[i], high[i]), least)
                columns = [pa.array([batch.column(0)[i].as_py()] * len(rows), pa.string()), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "length", "period"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    ranges = once.mapInArrow(deal, "key string, low long, high long, ids array<int>").repartition(parts, "key", "low")
    every = ranges.mapInArrow(compare, "key string, start long, length long, period long")
    least_period = every.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    by_start = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    return least_period.groupBy("key").agg(F.transform(by_start, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))


def described(docs: DataFrame, text: str = "text", least: int = LEAST, long: int = LONG, work: int = WORK) -> DataFrame:
    """``docs`` with ``runs`` (start, length and period in words, by start, then period) and ``collapsed``, the text without what repeats."""
    ship(docs.sparkSession)
    runs, collapsed, key = (spare(docs.columns, n) for n in ("runs", "collapsed", "text_key"))
    names, at_text = docs.columns, docs.columns.index(text)

    def answer(batch: pa.RecordBatch, given: pa.Array | None) -> Iterator[pa.RecordBatch]:
        for lo, hi, raw, at in tx.blocks(batch.column(at_text), SCAN):
            words = tx.words(raw, at)
            if given is None:
                ids = word_ids(raw, *words[:2])
                rows = scan(ids, words[2], np.arange(1, int(np.diff(words[2]).max(initial=0)) // MIN_EXP + 1), least)
            else:
                some = given.slice(lo, hi - lo)
                flat, size = some.flatten(), np.diff(some.offsets.to_numpy())
                rows = np.stack([np.repeat(np.arange(hi - lo), size), *(flat.field(c).to_numpy() for c in ("start", "length", "period"))], 1)
            left = [c.slice(lo, hi - lo) for c in batch.columns[: len(names)]]
            yield pa.RecordBatch.from_arrays([*left, _listed(rows, hi - lo), collapse(raw, at, words, rows)], names=[f"c{i}" for i in range(len(names) + 2)])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from answer(batch, None)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from answer(batch, batch.column(len(names)))

    kinds = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), f"c{len(names)} array<{RUN}>", f"c{len(names) + 1} string"])
    # A text has at most half as many words as letters, and one word more.
    some_long = F.coalesce(F.length(text) > 2 * long, F.lit(False))
    keyed = docs.where(some_long).withColumn(key, F.sha2(text, 256))
    found = _dealt(keyed, key, text, long, work, least).select(F.col("key").alias(key), F.col("runs").alias(runs))
    joined = keyed.join(found, key, "left").select(*names, F.coalesce(runs, F.array().cast(f"array<{RUN}>")).alias(runs))
    return docs.where(~some_long).mapInArrow(short, kinds).union(joined.mapInArrow(known, kinds)).toDF(*names, runs, collapsed)


def longest(runs: str = "runs") -> F.Column:
    """The run of greatest length (ties: smallest start, then period); null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
