"""Document fingerprints from prefix polynomial hashes.

Prefix arrays of a polynomial hash modulo primes give the hash of any span of a text in constant time: equality of
spans, and by binary search the longest common extension of two places.  A text's fingerprint keeps, for each of 64
equal ranges of span hashes, the least one (16 bits of it), over all spans of ``SPAN`` code points.  The likeness
of two fingerprints is the share of ranges that agree among those that either has.

Edge cases: null counts as empty text.  Texts shorter than a span are one span.  Documents with the same doc_id
follow each other by text; null ids come first; the last document's next is the first, a single document's next is
itself.  Very long texts are hashed whole, in blocks.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import ship

SPAN = 24
RANGES = 64
#: Two primes below 2**31 and a base for each.
PRIMES = ((2147483647, 1103515245), (2147483629, 362437069))
_BLOCK = 1 << 20
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the k-th base and of its inverse, up to n at least."""
    if k not in _TABLES or len(_TABLES[k][0]) < n:
        prime, base = PRIMES[k]
        made = []
        for b in (base, pow(base, -1, prime)):
            out, step = np.ones(1, np.uint64), b
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
                step = step * step % prime
            made.append(out)
        _TABLES[k] = (made[0], made[1])
    return _TABLES[k]


class PrefixHash:
    """Prefix hashes of code points, in blocks; answers span equality and longest common extensions.

    The sums start afresh in each block, so the tables of powers have a block's length whatever the text's.
    """

    def __init__(self, codes: np.ndarray, moduli: int = 2) -> None:
        self.n = len(codes)
        self.sums: list[list[np.ndarray]] = []
        for k in range(moduli):
            prime = np.uint64(PRIMES[k][0])
            blocks = []
            for lo in range(0, max(self.n, 1), _BLOCK):
                part = codes[lo : lo + _BLOCK].astype(np.uint64) + np.uint64(1)
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * _powers(k, len(part) + 1)[0][: len(part)] % prime, out=total[1:])
                blocks.append((total % prime).astype(np.uint32))
            self.sums.append(blocks)

    def span(self, start: np.ndarray, length: np.ndarray | int, k: int = 0) -> np.ndarray:
        """Hash of the spans at ``start`` in the first block, the same wherever a span stands."""
        prime = np.uint64(PRIMES[k][0])
        total = self.sums[k][0].astype(np.uint64)
        return (total[start + length] + prime - total[start]) % prime * _powers(k, len(total))[1][start] % prime

    def _one(self, at: int, length: int, k: int) -> int:
        """Hash of one span that lies in one block."""
        block, at = divmod(at, _BLOCK)
        total, prime = self.sums[k][block], PRIMES[k][0]
        return (int(total[at + length]) - int(total[at])) * int(_powers(k, len(total))[1][at]) % prime

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether the spans at i here and at j there are equal (up to both hashes)."""
        done = 0
        while done < length:
            step = min(length - done, _BLOCK - (i + done) % _BLOCK, _BLOCK - (j + done) % _BLOCK)
            if any(self._one(i + done, step, k) != other._one(j + done, step, k) for k in range(len(self.sums))):
                return False
            done += step
        return True

    def extension(self, i: int, other: PrefixHash, j: int, most: int | None = None) -> int:
        """Length of the longest common extension of place i here and place j there, ``most`` at most.

        Doubling finds a span that differs, binary search where in it.
        """
        limit = min(self.n - i, other.n - j) if most is None else min(self.n - i, other.n - j, most)
        low, step = 0, 1
        while low < limit and self.same(i + low, other, j + low, min(step, limit - low)):
            low += min(step, limit - low)
            step *= 2
        high = min(limit, low + step) - (low < limit)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if self.same(i + low, other, j + low, half - low) else (low, half - 1)
        return low


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32)


def span_hashes(codes: np.ndarray, hashed: PrefixHash | None = None) -> np.ndarray:
    """A 32-bit hash of the span at each place, in blocks; one of the whole text if it is shorter than a span."""
    if len(codes) < SPAN:
        whole = PrefixHash(codes, 1).span(np.zeros(1, np.int64), len(codes))
        return _scramble(whole + np.uint64((len(codes) + 1) << 32))
    hashed = hashed or PrefixHash(codes, 1)
    prime, inverse = np.uint64(PRIMES[0][0]), _powers(0, min(len(codes), _BLOCK) + 1)[1]
    within = lambda total: _scramble((total[SPAN:] + prime - total[:-SPAN]) % prime * inverse[: len(total) - SPAN] % prime)
    parts = []
    for i, block in enumerate(hashed.sums[0]):
        if i:
            # The spans that begin in the block before and end in this one.
            across = PrefixHash(codes[i * _BLOCK - SPAN + 1 : i * _BLOCK + SPAN - 1], 1).sums[0][0].astype(np.uint64)
            if len(across) > SPAN:
                parts.append(within(across))
        if len(block) > SPAN:
            parts.append(within(block.astype(np.uint64)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


_STARTS = (np.arange(RANGES, dtype=np.uint64) << np.uint64(26)).astype(np.uint32)
_NONE = np.uint32(0xFFFFFFFF)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each range; all ones where there is none."""
    ordered = np.sort(hashes)
    at = np.append(np.searchsorted(ordered, _STARTS), len(ordered))
    out = np.full(RANGES, _NONE)
    some = at[1:] > at[:-1]
    out[some] = ordered[at[:-1][some]]
    return out


def written(least: np.ndarray) -> str:
    """64 times four hex digits; ffff stands for no span in that range."""
    short = (least & np.uint32(0xFFFF)).astype(np.uint16)
    short = np.where(least == _NONE, np.uint16(0xFFFF), np.where(short == 0xFFFF, np.uint16(0xFFFE), short))
    return short.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of ranges that agree among those that either fingerprint has; 1 if neither has any."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    either = (x != 0xFFFF) | (y != 0xFFFF)
    return float(((x == y) & either).sum() / either.sum()) if either.any() else 1.0


def fingerprint(text: str) -> str:
    return written(minima(span_hashes(codes_of(text))))


class _Text:
    """A text with what both neighbours need of it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.codes = codes_of(text)
        self.prefix = PrefixHash(self.codes)
        self.hashes = span_hashes(self.codes, self.prefix)
        self.mark = written(minima(self.hashes))


def _edited(one: _Text, two: _Text) -> tuple[str, str]:
    """The edited text, and its fingerprint from the span hashes of its two parts and of the spans across."""
    n = len(one.codes)
    kept, new = n - n // 2, min(n // 2, len(two.codes))
    text = one.text[:kept] + two.text[:new]
    if kept + new < SPAN:
        return text, fingerprint(text)
    parts = []
    if kept >= SPAN:
        parts.append(minima(one.hashes[: kept - SPAN + 1]))
    if new >= SPAN:
        parts.append(minima(two.hashes[: new - SPAN + 1]))
    across = np.concatenate([one.codes[max(0, kept - SPAN + 1) : kept], two.codes[: min(new, SPAN - 1)]])
    if len(across) >= SPAN:
        parts.append(minima(span_hashes(across)))
    return text, written(np.minimum.reduce(parts))


def _extensions(one: _Text, two: _Text) -> tuple[int, int]:
    """Code points that a text shares from its start with its edited text, and with the next document.

    The edited text differs first where the replaced half and the next document's start do.
    """
    n = len(one.codes)
    kept = n - n // 2
    return kept + one.prefix.extension(kept, two.prefix, 0, n // 2), one.prefix.extension(0, two.prefix, 0)


def _chained(docs: DataFrame) -> DataFrame:
    """Rows of (bucket, ghost, doc_id, text), in order within each partition, each followed by its next document.

    Ranges of ids make the buckets.  A bucket ends with a ghost, the first row of the next one; so no row of text is
    moved more than once but for one for each partition.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = -(1 << 63)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(low)))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"))
    cuts = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    # Two short scans, over every wide-th border and over the borders from there on, instead of one over them all.
    wide = max(1, math.isqrt(len(cuts)))
    borders, far = (F.array(*[F.lit(c) for c in x]) for x in (cuts or [low], cuts[wide - 1 :: wide] or [low]))
    passed = lambda found: F.size(F.filter(found, lambda c: c <= F.col("key")))
    coarse = passed(far) * wide if len(cuts) >= wide and cuts else F.lit(0)
    bucket = coarse + passed(F.slice(borders, coarse + 1, wide)) if cuts else F.lit(0)
    heads = sorted((r.bucket, r.key) for r in keys.withColumn("bucket", bucket).groupBy("bucket").agg(F.min("key").alias("key")).collect())
    rows = base.withColumn("bucket", bucket).withColumn("ghost", F.lit(0))
    if heads:
        before = {key: heads[i - 1][0] for i, (_, key) in enumerate(heads)}
        table = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        first = base.where(F.col("key").isin([*before])).groupBy("key").agg(F.min(F.struct("text", "doc_id")).alias("first"))
        ghosts = first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text"), "key", table[F.col("key")].alias("bucket"), F.lit(1).alias("ghost"))
        rows = rows.unionByName(ghosts)
    return rows.repartitionById(n + 1, F.col("bucket")).sortWithinPartitions("bucket", "ghost", "key", "text").select("bucket", "ghost", "doc_id", "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text has the last floor(n/2) code points replaced by as many first ones of the next document.  same_edited
    and same_next: code points up to the first difference from the edited text and from the next document, which are the
    longest common extensions of their starts.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            out = []
            for bucket, ghost, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                here = _Text(text)
                if last and last[0] == bucket:
                    one = last[3]
                    edited, mark = _edited(one, here)
                    out.append((last[2], len(one.codes), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), one.mark, mark, likeness(one.mark, mark), likeness(one.mark, here.mark), *_extensions(one, here)))
                last = (bucket, ghost, doc_id, here)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    return _chained(docs).mapInArrow(run, _OUT)
