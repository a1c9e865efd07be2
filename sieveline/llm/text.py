"""Numpy helpers over Arrow text columns: words, hashes and lockstep Viterbi, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a block of its own.
BLOCK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of Latin-1 in lower case."""
    out = LOWER[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    out[after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]] += 0x20
    return out


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK * 2)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))[:-1]]) for b in (_BASE, _INVERSE)]
    return _POWERS


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole texts, about ``limit`` bytes at a time."""
    raw, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of non-space, and the first word of each text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = at[at < len(raw)]
    first[edge] = solid[edge]
    edge = at[at > 0] - 1
    last[edge] = solid[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial modulo 2**64."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 2 * BLOCK, "right")))
        base = starts[i]
        part = raw[base : ends[j - 1]]
        power, inverse = _powers(len(part) + 1)
        prefix = np.empty(len(part) + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(_LETTER[part] * power[: len(part)], out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (texts' borders are the caller's concern)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= np.uint64(0x9FB21C651E98DF25)
        total += hashes[k : k + n]
    return mix(total + np.uint64(width))


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def viterbi(scores: np.ndarray, at: np.ndarray, change: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Best label of each row for sequences ``at[i]:at[i+1]``; all sequences advance together, one row at a time.

    scores: rows x labels; change: labels x labels, added for a step from one label to the next.
    """
    rows, labels = scores.shape
    out = np.zeros(rows, np.int16)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return out
    first, size = at[:-1][order], size[order]
    back = np.zeros((rows, labels), np.int8 if labels < 128 else np.int16)
    best = scores[first] + (0 if start is None else start)
    final = np.zeros(len(order), np.int64)
    longest = int(size[0])
    live_at = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    for t in range(1, longest):
        live = live_at[t]
        if live < len(best):
            final[live : len(best)] = best[live:].argmax(1)
            best = best[:live]
        step = best[:, :, None] + change
        came = step.argmax(1)
        here = first[:live] + t
        back[here] = came
        best = np.take_along_axis(step, came[:, None, :], 1)[:, 0] + scores[here]
    final[: len(best)] = best.argmax(1)
    label = final
    for t in range(longest - 1, -1, -1):
        live = live_at[t]
        here = first[:live] + t
        out[here] = label[:live]
        if t:
            label[:live] = back[here, label[:live]]
    return out


def viterbi_spans(scores: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """As ``viterbi`` where staying is free and any change costs ``switch``: only the best label need be left."""
    rows, labels = scores.shape
    out = np.zeros(rows, np.int8)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return out
    first, size = at[:-1][order], size[order]
    back = np.empty((rows, labels), np.int8)
    own = np.arange(labels, dtype=np.int8)
    best = scores[first]
    final = np.zeros(len(order), np.int64)
    longest = int(size[0])
    live_at = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    for t in range(1, longest):
        live = live_at[t]
        if live < len(best):
            final[live : len(best)] = best[live:].argmax(1)
            best = best[:live]
        top = best.argmax(1)
        left = (best[np.arange(live), top] - switch)[:, None]
        here = first[:live] + t
        back[here] = np.where(best >= left, own, top[:, None])
        best = np.maximum(best, left) + scores[here]
    final[: len(best)] = best.argmax(1)
    label = final
    for t in range(longest - 1, -1, -1):
        live = live_at[t]
        here = first[:live] + t
        out[here] = label[:live]
        if t:
            label[:live] = back[here, label[:live]]
    return out
