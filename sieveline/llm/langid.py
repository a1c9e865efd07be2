"""Language ID: scripts narrow the candidates, then Viterbi over per-word scores labels spans of one language.

A word's score for a language sums the log-likelihoods of its byte n-grams (1 to 3, with the word's borders), hashed
to 2**16 buckets.  Languages that the sample hasn't shown in the word's
script are out, however well the rest of the word fits; scripts that no language shows rule none out.  A step from one language to
another costs ``SWITCH``, so a text falls into spans; its language is the one with the most letters.  The counts come
from a bounded sample (``SAMPLE`` documents, least hashes of their ids); only the table of buckets by language reaches
the driver.

Edge cases: a null text or one without a letter is `und` with score 0, as is every text if nothing was learned.
Equal scores go to the language first in code point order.  Texts are labelled whole and by themselves, so repeated
rows and ids, very long texts and other columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import text as tx
from sieveline.session import ship

SAMPLE = 20_000
BITS, ORDERS = 16, 3
SWITCH, DAMP, OUT = 8.0, 0.5, -np.inf
_BLOCK = 8 << 20
#: First code points of the ranges of scripts; 0 is anything else.
SCRIPTS = ((0x0041, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0), (0x0B80, 11), (0x0C00, 12), (0x0C80, 13), (0x0D00, 14), (0x0D80, 15), (0x0E00, 16), (0x0E80, 17), (0x0F00, 0), (0x10A0, 18), (0x1100, 19), (0x1200, 20), (0x13A0, 0), (0x1780, 21), (0x1800, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 22), (0x3100, 0), (0x3400, 23), (0xA000, 0), (0xAC00, 19), (0xD7B0, 0), (0xF900, 23), (0xFB00, 1), (0xFB07, 0), (0x20000, 23))
_STARTS, _KINDS = np.array(SCRIPTS).T


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _traits(flat: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of letters of each word, and the script of its first letter."""
    codes = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    letter = _letters()[codes]
    place = np.flatnonzero(letter)
    start = np.searchsorted(place, lead[cut[:-1]])
    count = np.searchsorted(place, lead[cut[1:]]) - start
    first = codes[place[np.minimum(start, len(place) - 1)]] if len(place) else np.zeros(len(cut) - 1, np.uint32)
    script = _KINDS[np.maximum(np.searchsorted(_STARTS, first, "right") - 1, 0)]
    return count, np.where(count > 0, script, 0)


def _vocabulary(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a block: which one each word is, and the bytes, with a border on each side."""
    _, one, which = np.unique(tx.word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    size = ends[one] - starts[one] + 2
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(starts[one] - 1, size)
    flat = raw[np.clip(place, 0, len(raw) - 1)].copy()
    flat[at[:-1]] = flat[at[1:] - 1] = 0x20
    return which, flat, at, one


def _grams(flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of the n-grams of each order."""
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    packed = np.zeros(len(flat), np.uint64)
    for n in range(1, ORDERS + 1):
        m = len(flat) - n + 1
        if m <= 0:
            return
        packed = (packed[:m] << np.uint64(8)) | flat[n - 1 :]
        inside = word[:m] == word[n - 1 :]
        yield word[:m][inside], (tx.mix(packed[inside] + (np.uint64(n) << np.uint64(40))) >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    """Log-likelihoods of buckets by language, and which scripts each language is written in."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.langs = langs
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
        self.table = np.log(share / share.mean(0)).T.astype(np.float32) * DAMP if langs else np.zeros((1 << BITS, 0), np.float32)
        seen = scripts >= 0.01 * np.maximum(1, scripts.sum(1, keepdims=True))
        #: scripts x languages: 0 where a language may be, OUT where not; scripts that no language shows rule none out.
        self.narrow = np.where(seen.T | ~seen.any(0)[:, None], 0, OUT).astype(np.float32)

    def label(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label and letters of each word, and each text's first word."""
        lowered = tx.lower(raw)
        starts, ends, first = tx.words(lowered, at)
        if not len(starts):
            return np.zeros(0, np.int16), np.zeros(0, np.int64), first
        which, flat, cut, _ = _vocabulary(lowered, starts, ends)
        scores = np.zeros((len(cut) - 1, len(self.langs)), np.float32)
        for word, bucket in _grams(flat, cut):
            edge = np.flatnonzero(np.diff(word, prepend=-1))
            if len(edge):
                scores[word[edge]] += np.add.reduceat(self.table[bucket], edge, axis=0)
        letters, script = _traits(flat, cut)
        scores += self.narrow[script]
        scores[letters == 0] = 0
        return tx.viterbi_spans(scores[which], first, SWITCH), letters[which], first


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the texts of ``docs`` (doc_id, text, lang) with a language, at most ``sample`` of them."""
    ship(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    some = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, raw, at in tx.blocks(batch.column(1)):
                raw = tx.lower(raw)
                starts, ends, first = tx.words(raw, at)
                if not len(starts):
                    continue
                names, code = np.unique(np.array(langs[lo:hi], object).astype(str), return_inverse=True)
                which, flat, cut, _ = _vocabulary(raw, starts, ends)
                lang = np.repeat(code, np.diff(first))
                often = np.bincount(lang * (len(cut) - 1) + which, minlength=len(names) * (len(cut) - 1)).reshape(len(names), -1)
                _, script = _traits(flat, cut)
                for k, name in enumerate(names):
                    table = total.setdefault(str(name), np.zeros((1 << BITS) + 32))
                    for word, bucket in _grams(flat, cut):
                        table[: 1 << BITS] += np.bincount(bucket, often[k][word], 1 << BITS)
                    table[1 << BITS :] += np.bincount(script, often[k], 32)
        for name, table in total.items():
            hit = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(table[hit])], names=["lang", "bucket", "n"])

    rows = known.join(F.broadcast(some), ["doc_id", "lang"]).select("lang", "text").mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.zeros((len(langs), (1 << BITS) + 32))
    table[np.searchsorted(np.array(langs, object), rows["lang"].to_numpy(object)) if langs else [], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    scripts = table[:, 1 << BITS :].copy()
    scripts[:, 0] = 0
    return Model(langs, table[:, : 1 << BITS], scripts)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in its spans) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            found, shares = [], []
            for lo, hi, raw, at in tx.blocks(batch.column(1), _BLOCK):
                n, k = hi - lo, max(1, len(model.langs))
                votes = np.zeros((n, k))
                if model.langs:
                    label, letters, first = model.label(raw, at)
                    doc = np.repeat(np.arange(n), np.diff(first))
                    votes = np.bincount(doc * k + label, letters, n * k).reshape(n, k)
                total = votes.sum(1)
                found.append(np.where(total > 0, votes.argmax(1), len(model.langs)))
                shares.append(votes.max(1) / np.maximum(total, 1))
            best = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.concatenate(shares) if shares else np.zeros(0))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end (words, end exclusive), lang: the spans of one language of every text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, raw, at in tx.blocks(batch.column(1), _BLOCK):
                if not model.langs:
                    continue
                label, _, first = model.label(raw, at)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                edge = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
                end = np.append(edge[1:], len(label))[: len(edge)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][doc[edge]], pa.int64()), pa.array(edge - first[doc[edge]], pa.int64()), pa.array(end - first[doc[edge]], pa.int64()), pa.array(np.array(model.langs, object)[label[edge]], pa.string())], names=["doc_id", "start", "end", "lang"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, lang string")
