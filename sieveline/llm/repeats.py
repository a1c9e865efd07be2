"""Substring dedup: words covered by a window of ``window`` words that also starts elsewhere.

A window's least 8-word hash is its anchor, and equal windows have equal anchors at equal places.  The windows of a
document fall into runs that share an anchor; a run is one row of 40 bytes, and each window is in just one run.

1. Runs are counted by anchor.  An anchor that occurs once repeats nothing.
2. The others' distinct runs of words are dealt to shards by anchor.  Each shard builds an FM-index: suffix array,
   Burrows-Wheeler transform in a wavelet tree of packed bits.  Runs are streamed against it: backward search finds
   how far each place matches a second one, and reports the stretches that repeated windows cover.  A run that
   stands in several places is in the text twice, so it finds itself.
3. An anchor with more than ``HOT`` distinct runs (an eight-word phrase in very many places) isn't gathered in a shard:
   its windows are counted by hash.  Both ways report the same stretches.
4. Stretches return to all places of their run, and the words they cover go.

Runs and hot windows are told apart by 64-bit hashes together with their anchors; shards compare words.

Edge cases: null and empty texts have no words and keep none.  Texts shorter than a window keep all.  Repeated rows
are windows elsewhere like any others, so a repeated long text goes whole; ids may repeat or be null.  An empty table
gives an empty result; other columns are kept as they are by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import text as tx
from sieveline.session import discard, scratch, ship, spare, stash

GRAM = 8
HOT = 20_000
#: Words of one shard's index; a shard has one anchor's runs at least, HOT of them at most.
SHARD = 1_000_000
#: Places of a run from which on its stretches are broadcast to them, if at most FEW runs have so many.
OFTEN, FEW = 10_000, 100_000


def _spans_hash(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of words, the same wherever it stands."""
    power, inverse = tx._powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return tx.mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def runs(raw: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, first word, words, anchor, hash) of each run of windows that share an anchor."""
    starts, ends, first = tx.words(raw, at)
    hashes = tx.word_hashes(raw, starts, ends)
    count = np.maximum(np.diff(first) - window + 1, 0)
    if not count.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = tx.rolling(hashes, GRAM)
    reach = window - GRAM + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(1) + np.arange(len(grams) - reach + 1)
    doc = np.repeat(np.arange(len(count)), count)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    anchor = least[begin]
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    last = np.append(new[1:], len(doc)) - 1
    lo, hi = begin[new], begin[last] + window
    return doc[new], lo - first[doc[new]], hi - lo, grams[anchor[new]], _spans_hash(hashes, lo, hi)


class Wavelet:
    """Ranks of symbols in a sequence, by one packed bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.n = len(symbols)
        self.bits = range(max(1, int(kinds - 1).bit_length()) - 1, -1, -1)
        self.words, self.before, self.zeros = [], [], []
        now = symbols
        for b in self.bits:
            bit = ((now >> b) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + (-len(packed)) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.base = self._walk(np.arange(kinds), np.zeros(kinds, np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for b, words, before, zeros in zip(self.bits, self.words, self.before, self.zeros, strict=True):
            word = place >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where((symbol >> b) & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, place) - self.base[symbol]


class FMIndex:
    """Backward search over a text of symbols from 1; a 0 ends each of its parts."""

    def __init__(self, text: np.ndarray, kinds: int, depth: int) -> None:
        n = len(text)
        order = np.argsort(text, kind="stable")
        rank = np.concatenate([[0], np.cumsum(np.diff(text[order]) != 0)])
        ranks = np.empty(n, np.int64)
        ranks[order] = rank
        step = 1
        while step < depth and rank[-1] < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - step] = ranks[step:] + 1
            key = ranks * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            ranks[order] = rank
            step *= 2
        self.n = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])[:kinds]
        self.tree = Wavelet(text[order - 1], kinds)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with the symbol before those of each interval."""
        return self.first[symbol] + self.tree.rank(symbol, low), self.first[symbol] + self.tree.rank(symbol, high)


def repeated(words: np.ndarray, cut: np.ndarray, twice: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(part, start, end): stretches whose words are all in windows that the text has elsewhere too.

    words: hashes; part i is words[cut[i]:cut[i + 1]]; the parts marked ``twice`` stand in the text twice.  All parts are
    searched in step, each window from its end.  A search that ends early at p rules out every window up to p.  After a
    window that is found the next one asked follows it without overlap; if that isn't found, those between, last first.
    """
    kinds, symbol = np.unique(words, return_inverse=True)
    size = np.diff(cut)
    again = np.flatnonzero(twice)
    order = np.concatenate([np.arange(len(size)), again])
    length = size[order]
    at = np.cumsum(length + 1) - length - 1
    text = np.zeros(int(length.sum()) + len(length), np.int64)
    text[np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)] = symbol[np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(cut[:-1][order], length)] + 1
    index = FMIndex(text, len(kinds) + 1, 2 * window)
    part = np.flatnonzero(size >= window)
    base, end = at[part], size[part]
    start = np.zeros(len(part), np.int64)
    place = start + window - 1
    low, high = np.zeros(len(part), np.int64), np.full(len(part), index.n)
    #: mode 0 seeks a first window, 1 the one right after what is covered (up to ``done``), 2 those between, down to ``floor``.
    mode, done, resume = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    found: list[tuple[int, int, int]] = []
    while len(part):
        low, high = index.extend(text[base + place], low, high)
        more = high - low >= 2
        whole = more & (place == start)
        if whole.any():
            found += zip(part[whole].tolist(), start[whole].tolist(), (start[whole] + window).tolist(), strict=True)
        missed = ~more
        over = whole | missed
        # Found: go on right after it.  Missed right after it: try the windows between.  Missed between: the one before, down to the last that was found.
        seek, leap, creep = missed & (mode == 0), missed & (mode == 1), missed & (mode == 2)
        done = np.where(whole, start + window, done)
        resume = np.where(leap, place + 1, resume)
        start = np.select([whole, seek, leap, creep], [start + window, place + 1, np.minimum(start, end - window + 1) - 1, start - 1], start)
        mode = np.select([whole, leap], [1, 2], mode)
        back = (mode == 2) & (start <= done - window)
        start, mode = np.where(back, resume, start), np.where(back, 0, mode)
        # The last window of a part may overlap what is covered.
        short = (mode == 1) & (start + window > end)
        resume = np.where(short, end, resume)
        start, mode = np.where(short, end - window, start), np.where(short, 2, mode)
        spent = short & (start <= done - window)
        place = np.where(over | short, start + window - 1, place - 1)
        low, high = np.where(over | short, 0, low), np.where(over | short, index.n, high)
        going = (start + window <= end) & ~spent
        if not going.all():
            part, base, end, start, place, low, high, mode, done, resume = (x[going] for x in (part, base, end, start, place, low, high, mode, done, resume))
    return found


def _joined(places: DataFrame, hits: DataFrame) -> DataFrame:
    """(key, start, end) in words of whole texts: the stretches of each run at all its places.

    Runs with very many places would be one task's key, so the stretches of those go to the places instead.
    """
    many = hits.where(F.col("n") >= OFTEN).drop("n")
    keys = ["anchor", "content"]
    if 0 < many.count() <= FEW:
        flagged = places.join(F.broadcast(many), keys, "left")
        rest = flagged.where("spans is null").drop("spans").join(hits.where(F.col("n") < OFTEN).drop("n"), keys)
        both = flagged.where("spans is not null").union(rest.select(*flagged.columns))
    else:
        both = places.join(hits.drop("n"), keys)
    wide = both.select("key", F.col("start").cast("long").alias("at"), F.explode("spans").alias("span"))
    return wide.select("key", (F.col("at") + F.col("span.low")).alias("start"), (F.col("at") + F.col("span.high")).alias("end"))


def covered(texts: DataFrame, window: int = 35) -> DataFrame:
    """key and the spans (start, end of words) that repeated windows cover, of the rows of ``texts`` (key, text) that have some."""
    ship(texts.sparkSession)
    with scratch(texts.sparkSession) as keep:
        return keep(stash(_spans(texts, window), "spans"))


def _spans(texts: DataFrame, window: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, raw, at in tx.blocks(batch.column(1)):
                doc, start, size, anchor, content = runs(raw, at, window)
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo + doc]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], names=["key", "start", "size", "anchor", "content"])

    every = stash(texts.mapInArrow(scan, "key long, start int, size int, anchor long, content long"), "runs")
    # Written first, so that both sides of the join have a shuffle of their own and a very common anchor's runs can be split.
    often = stash(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    alive = stash(every.join(often, "anchor"), "alive")
    discard(every, often)
    distinct = stash(alive.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "size")).alias("rep")), "distinct")
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("n").alias("most"))
    told = distinct.join(kinds.where("kinds > 1 or most > 1"), "anchor").select("anchor", "content", "n", (F.col("kinds") > HOT).alias("hot"), "rep.*")
    words = distinct.agg(F.coalesce(F.sum("rep.size"), F.lit(0))).first()[0]
    shards = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), words // SHARD + 1)
    # A text that stands in several rows with one id is taken as often; the words are the same.
    listed = told.groupBy("key").agg(F.collect_list(F.struct("start", "size", "anchor", "n", "hot", "content")).alias("runs"))
    listed = listed.join(texts.withColumnRenamed("key", "text_key"), F.col("key") == F.col("text_key")).select("key", "runs", "text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each listed run, as the hash of each."""
        for batch in batches:
            keys = batch.column(0).to_numpy()
            asked = batch.column(1)
            flat, cut = asked.values, asked.offsets.to_numpy()
            start, size, anchor, n, hot, content = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            for lo, hi, raw, at in tx.blocks(batch.column(2)):
                first_byte, end_byte, first = tx.words(raw, at)
                hashes = tx.word_hashes(raw, first_byte, end_byte)
                one = slice(cut[lo], cut[hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))
                begin, length = first[doc] + start[one], size[one].astype(np.int64)
                place = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
                yield pa.RecordBatch.from_arrays([pa.array(anchor[one]), pa.array(content[one]), pa.array(n[one]), pa.array(hot[one]), tx.lists(hashes[place].view(np.int64), length, pa.int64())], names=["anchor", "content", "n", "hot", "words"])

    taken = stash(listed.mapInArrow(take, "anchor long, content long, n long, hot boolean, words array<long>"), "taken")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams a partition, in order of anchors, through one index after another."""

        def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = table.column("words").chunk(0)
            at = column.offsets.to_numpy()
            body = column.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
            anchor, content, n = (table.column(c).to_numpy() for c in ("anchor", "content", "n"))
            rows = np.array(repeated(body, (at - at[0]).astype(np.int64), n > 1, window), np.int64).reshape(-1, 3)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            # Stretches that overlap or meet become one.
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] > rows[:-1, 2])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(rows)) - 1 if len(rows) else first
            part = rows[first, 0]
            return pa.RecordBatch.from_arrays([pa.array(anchor[part]), pa.array(content[part]), pa.array(n[part]), pa.array(rows[first, 1]), pa.array(rows[last, 2])], names=["anchor", "content", "n", "low", "high"])

        held: list[pa.RecordBatch] = []
        words, before = 0, None
        for batch in batches:
            # Repeated rows of one text bring a run more than once; it is one run.
            names = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            fresh = np.append(before is None or (names[:1] != before).any(), (np.diff(names, axis=0) != 0).any(1))[: len(names)]
            before = names[-1:] if len(names) else before
            batch = batch.filter(pa.array(fresh))
            anchors = batch.column(0).to_numpy()
            edge = np.append(np.flatnonzero(np.diff(anchors)) + 1, len(anchors))
            size = np.append(0, np.cumsum(np.diff(batch.column(4).offsets.to_numpy())))
            lo = 0
            for hi in edge:
                if words + size[hi] - size[lo] > SHARD and hi < len(anchors):
                    held.append(batch.slice(lo, hi - lo))
                    yield shard(held)
                    held, words, lo = [], 0, hi
            if lo < len(anchors):
                held.append(batch.slice(lo))
                words += int(size[-1] - size[lo])
        if held:
            yield shard(held)

    cold = taken.where("not hot").repartition(shards, "anchor").sortWithinPartitions("anchor", "content").mapInArrow(search, "anchor long, content long, n long, low long, high long")

    hot = taken.where("hot").dropDuplicates(["anchor", "content"]).select("anchor", "content", "n", F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("low"), "words")
    hot = hot.select("anchor", "content", "n", F.col("low").cast("long").alias("low"), F.xxhash64(F.slice("words", F.col("low") + 1, window)).alias("body"))
    total = hot.groupBy("anchor", "body").agg(F.sum("n").alias("total"))
    warm = hot.join(total.where("total > 1"), ["anchor", "body"]).select("anchor", "content", "n", "low", (F.col("low") + window).alias("high"))

    hits = stash(cold.union(warm).groupBy("anchor", "content", "n").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "hits")
    return _joined(alive.select("anchor", "content", "key", "start"), hits).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with what is left of each text (words joined by one space if any went), n_words and n_removed."""
    key, spans = spare(docs.columns, "key"), spare(docs.columns, "spans")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = covered(keyed.select(F.col(key).alias("key"), "text"), window)
    joined = keyed.join(found.select(F.col("key").alias(key), F.col("spans").alias(spans)), key, "left").select(*docs.columns, spans)
    at, of = joined.columns.index("text"), len(docs.columns)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, left = [], [], []
            asked = batch.column(of)
            flat, edge = asked.values, asked.offsets.to_numpy()
            low, high = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            null = asked.is_null().to_numpy(zero_copy_only=False)
            for lo, hi, raw, where in tx.blocks(batch.column(at)):
                starts, ends, first = tx.words(raw, where)
                body = raw.tobytes()
                for d in range(hi - lo):
                    a, b = first[d], first[d + 1]
                    n = int(b - a)
                    keep = np.ones(n, bool)
                    if not null[lo + d]:
                        some = slice(edge[lo + d], edge[lo + d + 1])
                        depth = np.bincount(low[some], minlength=n + 1) - np.bincount(high[some], minlength=n + 1)
                        keep = np.cumsum(depth)[:n] == 0
                    total.append(n)
                    gone.append(int(n - keep.sum()))
                    s, e = starts[a:b][keep], ends[a:b][keep]
                    left.append(b" ".join(map(body.__getitem__, map(slice, s.tolist(), e.tolist()))))
            columns = [pa.array(left, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(batch.columns) if i != of]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[f"c{i}" for i in range(len(columns) + 2)])

    kinds = [f"c{i} {joined.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    out = joined.mapInArrow(cut, ", ".join([*kinds, f"c{len(names)} long", f"c{len(names) + 1} long"]))
    return out.toDF(*names, spare(names, "n_words"), spare(names, "n_removed"))
