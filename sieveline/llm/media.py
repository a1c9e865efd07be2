"""Media columns: texts' bytes as 8-bit audio, read back, resampled, and described by log-mel frames.

Storage is a column of WAV files of 8-bit samples, lossless for any bytes.  Features come from that column: polyphase
resampling by 3/4, overlapped Hann frames, log-mel filterbank, and segments by hysteresis of frame energy (on above one
level, off below a lower one).  Windows of frames are Arrow fixed-shape tensors with their time spans; a document's
are one Arrow stream in a binary column, which keeps the tensor type that Spark's own columns lack.

Edge cases: null counts as empty text, whose payload is 64 zero bytes.  Very long payloads are resampled and framed in
blocks.  Each row is by itself, so equal texts have equal values and repeated rows, repeated or null ids and other
columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import ship

RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
FRAME, HOP, MELS, WINDOW = 256, 128, 24, 64
#: Decibels above the median frame energy at which a segment starts, and below which it ends.
ON, OFF = 1.0, 0.25
#: Frames, and resampled samples, that are worked on at once.
_FRAMES, _BLOCK = 4096, 3 << 18


def payload_of(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def store(payload: bytes) -> bytes:
    """A WAV file with the payload as its 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _phases() -> list[np.ndarray]:
    """The low-pass filter's taps for each of the UP phases, latest sample first."""
    n = UP * TAPS
    at = np.arange(n) - (n - 1) / 2
    taps = np.sinc(at / max(UP, DOWN)) * np.hamming(n)
    return [taps[r::UP] / taps[r::UP].sum() for r in range(UP)]


def _mel() -> np.ndarray:
    """Triangles at equal mel distances, as a matrix of frequencies x filters."""
    top = RATE * UP / DOWN / 2
    marks = 700 * (np.expm1(np.linspace(0, np.log1p(top / 700), MELS + 2)))
    f = np.fft.rfftfreq(FRAME, DOWN / (RATE * UP))[:, None]
    low, mid, high = marks[:-2], marks[1:-1], marks[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))


_PHASES, _MEL, _HANN = _phases(), _mel(), np.hanning(FRAME)


def resample(samples: np.ndarray) -> np.ndarray:
    """UP/DOWN times as many samples (numbers, or bytes with silence at 128): each output takes its phase's taps of the inputs before it.

    Blocks of inputs overlap by the filter's length, so only one of them is held as wide numbers.
    """
    n = -(-len(samples) * UP // DOWN)
    out = np.empty(n, np.float32)
    step = _BLOCK // UP * UP
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        begin, end = lo // UP * DOWN - TAPS + 1, (hi - 1) * DOWN // UP + 1
        wide = np.zeros(end - begin + DOWN)
        part = samples[max(0, begin) : end]
        wide[max(0, -begin) : max(0, -begin) + len(part)] = (part.astype(np.float64) - 128) / 128 if part.dtype == np.uint8 else part
        for r in range(min(UP, hi - lo)):
            count = -(-(hi - lo - r) // UP)
            seen = np.lib.stride_tricks.sliding_window_view(wide[(r * DOWN) // UP :], TAPS)[::DOWN][:count]
            out[lo + r : hi : UP] = seen @ _PHASES[(r * DOWN) % UP][::-1]
    return out


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames x filters of log energies, and each frame's energy in decibels."""
    count = max(1, -(-(len(signal) - FRAME) // HOP) + 1)
    wide = np.zeros((count - 1) * HOP + FRAME, np.float32)
    wide[: len(signal)] = signal[: len(wide)]
    frames = np.lib.stride_tricks.sliding_window_view(wide, FRAME)[::HOP]
    mels, energy = np.empty((count, MELS), np.float32), np.empty(count)
    for lo in range(0, count, _FRAMES):
        power = np.abs(np.fft.rfft(frames[lo : lo + _FRAMES] * _HANN, axis=1)) ** 2
        mels[lo : lo + _FRAMES] = np.log10(power @ _MEL + 1e-6)
        energy[lo : lo + _FRAMES] = 10 * np.log10(power.sum(1) + 1e-6)
    return mels, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """(start, end) frames of segments: on at ON above the median, off below OFF above it."""
    level = np.median(energy)
    sign = np.where(energy >= level + ON, 1, np.where(energy < level + OFF, 0, -1))
    at = np.maximum.accumulate(np.where(sign >= 0, np.arange(len(sign)), -1))
    on = np.where(at >= 0, sign[at], 0)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and the segments' (start, end) in seconds."""
    mels, energy = log_mel(resample(np.frombuffer(payload, np.uint8)))
    return mels, segments(energy) * (HOP * DOWN / (RATE * UP))


def windows(mels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows x WINDOW x MELS, the last filled up with zeros, and their (start, end) in seconds."""
    count = -(-len(mels) // WINDOW)
    out = np.zeros((count, WINDOW, MELS), np.float32)
    out.reshape(-1, MELS)[: len(mels)] = mels
    second = HOP * DOWN / (RATE * UP)
    start = np.arange(count) * WINDOW
    return out, np.stack([start, np.minimum(start + WINDOW, len(mels))], 1) * second


def tensor_type() -> pa.DataType:
    """The Arrow type of a window: a fixed-shape tensor."""
    return pa.fixed_shape_tensor(pa.float32(), [WINDOW, MELS])


_SPAN = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
_STORED = pa.schema([("log_mel", tensor_type()), ("t_start", pa.float64()), ("t_end", pa.float64()), ("segments", _SPAN)])


def pack(mels: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow stream of one row for each window: tensor, time span, and the segments that overlap it."""
    tensors, times = windows(mels)
    near = [[{"start": a, "end": b} for a, b in spans[(spans[:, 0] < t) & (spans[:, 1] > s)].tolist()] for s, t in times.tolist()]
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(tensors), pa.array(times[:, 0]), pa.array(times[:, 1]), pa.array(near, _SPAN)], schema=_STORED)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _STORED) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack(packed: bytes) -> pa.Table:
    """The rows of a packed document, log_mel as a column of fixed-shape tensors."""
    return pa.ipc.open_stream(packed).read_all()


def digest(packed: pa.Table) -> str:
    """Windows x frames x filters, distinct segments, and a hash of tensors, time spans and segments, rounded."""
    tensors = packed.column("log_mel").combine_chunks().to_numpy_ndarray()
    times = np.stack([packed.column(c).to_numpy() for c in ("t_start", "t_end")], 1)
    inside = packed.column("segments").combine_chunks().flatten()
    spans = np.unique(np.stack([inside.field(0).to_numpy(), inside.field(1).to_numpy()], 1), axis=0)
    body = b"".join(np.round(x.astype(np.float64), d).astype("<f4").tobytes() for x, d in ((tensors, 2), (times, 3), (spans, 3)))
    return f"{'x'.join(map(str, tensors.shape))}:{len(spans)}:{times.max():.3f}:{hashlib.sha256(body).hexdigest()[:32]}"


#: Rows of one batch that a task hands on; a window takes 6 KB.
_ROWS = 256


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and the texts' bytes as WAV files in the column media."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                data = [(x or "").encode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([store(payload_of(x)) for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def with_tensors(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with the column tensors: each file's windows, packed."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                packed = [pack(*features(load(x) if x is not None else payload_of(b""))) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed, pa.binary())], names=["doc_id", "n_bytes", "media", "tensors"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, tensors binary")


_TABLE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(docs: DataFrame) -> DataFrame:
    """Size, hashes and feature digest of each text as stored media; payload and tensors are read back from their columns."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media, packed in zip(batch.column(2), batch.column(3), strict=True):
                media, payload = media.as_py(), load(media.as_py())
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), digest(unpack(packed.as_py()))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in _TABLE.split(", ")])

    return with_tensors(stored(docs)).mapInArrow(run, _TABLE)


def audio_features(media: DataFrame) -> DataFrame:
    """One row for each window of ``media`` (doc_id, n_bytes, media): its place, time span, values and segments.

    Spark's columns have no tensors, so the values are WINDOW x MELS floats in rows; ``with_tensors`` keeps the type.
    """
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = unpack(packed.as_py())
                n = len(rows)
                flat = rows.column("log_mel").combine_chunks().storage.cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), *(rows.column(c).combine_chunks() for c in ("t_start", "t_end")), flat, rows.column("segments").combine_chunks()], names=["doc_id", "window", "t_start", "t_end", "log_mel", "segments"])

    return with_tensors(media).select("doc_id", "tensors").mapInArrow(run, "doc_id long, window int, t_start double, t_end double, log_mel array<float>, segments array<struct<start: double, end: double>>")
