"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words and their first 4, 6 and 8 bytes, hashed to 2**20 buckets.  A bounded sample of labelled
documents (``SAMPLE`` rows, least hashes of their ids) gives each bucket's likelihood ratio between the labels; the
``CHOSEN`` buckets with the largest ratios above ``LEAST`` enter the machine.  Its score is a bias, a weight for each
term in the document, and a product of factors for each pair of terms, so that insult and group together weigh more
than both alone.  It is fitted by Adam on the sample's sparse rows, on the driver; every text of the corpus is scored
whole, in tasks.

Edge cases: null and empty texts score by the bias alone.  Labels that are null, or without a document, teach nothing;
of several labels of a document the largest counts.  Without any label of one kind every score is the share of toxic
ones (0 without labels).  Rows are scored by themselves, so repeated rows and ids, very long texts and other columns
change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import text as tx
from sieveline.session import ship

BITS = 20
SAMPLE, CHOSEN, LEAST = 20_000, 4096, 16.0
FACTORS, ROUNDS, RATE, DECAY = 4, 150, 0.05, 1e-3
PREFIXES = (4, 6, 8)


def term_buckets(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every term, one kind of term at a time."""
    raw = tx.lower(raw)
    starts, ends, first = tx.words(raw, at)
    # Punctuation that closes a word isn't part of its term.
    mark = (ends - starts > 1) & np.isin(raw[np.maximum(ends - 1, 0)], np.frombuffer(b".,;:!?", np.uint8)) if len(ends) else np.zeros(0, bool)
    ends = ends - mark
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    yield doc, (tx.word_hashes(raw, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    for k in PREFIXES:
        long = ends - starts > k
        h = tx.word_hashes(raw, starts[long], starts[long] + k)
        yield doc[long], (tx.mix(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)


class Machine:
    """score = sigmoid(bias + sum of weights + half of (square of the factors' sum - sum of their squares))."""

    def __init__(self, buckets: np.ndarray, bias: float) -> None:
        self.place = np.full(1 << BITS, -1, np.int16)
        self.place[buckets] = np.arange(len(buckets))
        self.bias = bias
        self.weight = np.zeros(len(buckets))
        self.factor = np.random.default_rng(5).normal(0, 0.02, (len(buckets), FACTORS))

    def raw(self, row: np.ndarray, term: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and each row's sum of factors, for distinct (row, term) pairs."""
        total = self.bias + np.bincount(row, self.weight[term], rows)
        sums = np.stack([np.bincount(row, self.factor[term, f], rows) for f in range(FACTORS)], 1)
        squares = np.bincount(row, (self.factor[term] ** 2).sum(1), rows)
        return total + 0.5 * ((sums**2).sum(1) - squares), sums

    def fit(self, row: np.ndarray, term: np.ndarray, label: np.ndarray) -> Machine:
        rows, terms = len(label), len(self.weight)
        params = [np.array([self.bias]), self.weight, self.factor]
        slope = [np.zeros_like(p) for p in params]
        scale = [np.zeros_like(p) for p in params]
        for t in range(1, ROUNDS + 1):
            z, sums = self.raw(row, term, rows)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / rows
            e = error[row]
            grads = [np.array([error.sum()]), np.bincount(term, e, terms) + DECAY / 10 * self.weight / max(1, terms) ** 0.5, np.stack([np.bincount(term, e * (sums[row, f] - self.factor[term, f]), terms) for f in range(FACTORS)], 1) + DECAY * self.factor / max(1, terms) ** 0.5]
            for p, m, v, g in zip(params, slope, scale, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            self.bias = float(params[0][0])
        return self

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of whole texts, 0 to 1."""
        n = len(at) - 1
        keys = []
        for doc, bucket in term_buckets(raw, at):
            place = self.place[bucket]
            hit = place >= 0
            keys.append(doc[hit] * len(self.weight) + place[hit])
        pairs = np.unique(np.concatenate(keys)) if len(self.weight) else np.zeros(0, np.int64)
        z, _ = self.raw(pairs // max(1, len(self.weight)), pairs % max(1, len(self.weight)), n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine from ``labels`` (doc_id, label) and their texts in ``docs``, at most ``sample`` of them."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, hi, raw, at in tx.blocks(batch.column(1)):
                keys = np.unique(np.concatenate([(d << BITS) + b for d, b in term_buckets(raw, at)]))
                cut = np.searchsorted(keys, np.arange(hi - lo + 1) << BITS)
                found += [keys[a:b] & ((1 << BITS) - 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), tx.lists(flat.astype(np.int32), np.array([len(x) for x in found], np.int64), pa.int32())], names=["y", "terms"])

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("y", "text")
    rows = one.mapInArrow(terms, "y int, terms array<int>").withColumn("row", F.monotonically_increasing_id()).persist()
    try:
        n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        share = toxic / n if n else 0.0
        bias = float(np.log(share / (1 - share))) if 0 < toxic < n else (30.0 if n and toxic == n else -30.0)
        if not 0 < toxic < n:
            return Machine(np.zeros(0, np.int64), bias)
        a, b = F.col("a"), F.col("c") - F.col("a")
        cell = lambda k, exact: F.when(k > 0, k * F.log(k / exact)).otherwise(0.0)
        ratio = 2 * sum((cell(k, c * m / n) for k, c, m in ((a, F.col("c"), toxic), (b, F.col("c"), n - toxic), (toxic - a, n - F.col("c"), toxic), (n - toxic - b, n - F.col("c"), n - toxic))), F.lit(0.0))
        counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("y").alias("a")).where("c >= 3")
        chosen = counts.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST).orderBy(F.col("ratio").desc(), "term").limit(CHOSEN)
        buckets = np.array(sorted(r.term for r in chosen.select("term").collect()), np.int64)
        machine = Machine(buckets, bias)
        known_terms = F.array(*[F.lit(int(x)) for x in buckets]) if len(buckets) else F.array().cast("array<int>")
        got = rows.select("row", "y", F.array_intersect("terms", known_terms).alias("terms")).orderBy("row").collect()
    finally:
        rows.unpersist()
    y = np.array([r.y for r in got], float)
    row = np.repeat(np.arange(len(got)), [len(r.terms) for r in got])
    term = machine.place[np.array([t for r in got for t in r.terms], np.int64)].astype(np.int64)
    return machine.fit(row, term, y)


def scored(docs: DataFrame, machine: Machine, at: str = "text") -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(raw, at) for _, _, raw, at in tx.blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), at).mapInArrow(run, "doc_id long, score double")


def held_out(mod: int, rest: int) -> F.Column:
    """Whether crc32 of the doc_id as text leaves ``rest``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def keep_clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` without those that the machine rejects (score of 0.5 or more)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(raw, at) for _, _, raw, at in tx.blocks(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) < 0.5))

    return docs.mapInArrow(run, docs.schema)
