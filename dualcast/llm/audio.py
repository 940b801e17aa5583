"""Media columns: WAV files in a binary column, read by the wave module, and spectral-peak fingerprints.

A file's samples pass a short-time Fourier transform. The strongest bin of each band in a frame is a peak
when no neighbouring frame is stronger in that band. Each peak is paired with the next few, and a pair's
two bins and their distance in time make one integer, stored beside the frame where the pair begins.
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

from dualcast.llm.common import arrow_pass, cells, text_of

RATE = 16_000
BLOCK = 64
FRAME, HOP = 256, 128
#: Bins where the bands begin; bin 0 is the constant part.
BANDS = (1, 9, 25, 57)
FAN_OUT, REACH = 4, 16
_FRAMES_AT_ONCE = 4096
_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def payload(text: str) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of the block; a full last block gets no more."""
    data = text.encode("utf-8")
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def write_wav(samples: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as media:
        media.setnchannels(1)
        media.setsampwidth(1)
        media.setframerate(RATE)
        media.writeframes(samples)
    return out.getvalue()


def read_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as media:
        if media.getsampwidth() != 1 or media.getnchannels() != 1:
            raise ValueError("expected one channel of 8-bit samples")
        return media.readframes(media.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, by frame and then bin. The last frame is filled up with silence."""
    signal = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    frames = max(1, -(-(len(signal) - FRAME) // HOP) + 1)
    signal = np.pad(signal, (0, (frames - 1) * HOP + FRAME - len(signal)))
    shifted = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    height = np.empty((frames, len(BANDS)), np.float32)
    place = np.empty((frames, len(BANDS)), np.int64)
    for begin in range(0, frames, _FRAMES_AT_ONCE):
        part = slice(begin, begin + _FRAMES_AT_ONCE)
        power = np.abs(np.fft.rfft(shifted[part] * _HANN, axis=1))
        for band, (low, high) in enumerate(zip(BANDS, (*BANDS[1:], FRAME // 2 + 1))):
            best = power[:, low:high].argmax(axis=1)
            place[part, band] = low + best
            height[part, band] = power[np.arange(len(best)), low + best]
    edge = np.zeros((1, len(BANDS)), np.float32)
    before, after = np.vstack([edge, height[:-1]]), np.vstack([height[1:], edge])
    frame, band = np.nonzero((height > before) & (height >= after))
    return frame, place[frame, band]


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes (frame of the earlier peak) and hashes of the peak pairs, by time and partner."""
    frame, place = spectral_peaks(samples)
    times, hashes, order = [], [], []
    for step in range(1, FAN_OUT + 1):
        gap = frame[step:] - frame[:-step]
        near = np.flatnonzero(gap <= REACH)
        times.append(frame[near])
        hashes.append((place[near] << 13) | (place[near + step] << 5) | gap[near])
        order.append(near * FAN_OUT + step)
    by = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(times)[by].astype(np.int32), np.concatenate(hashes)[by].astype(np.int32)


def to_wav(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, ``n_bytes`` (of the text as UTF-8) and ``media`` (the WAV file), one row per row of ``df``.

    Null is the empty text, stored as one block of zeros; other columns are not read.
    """
    kind = dict(df.dtypes)[key]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = cells(batch, "text")
            sizes = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
            media = pa.array([write_wav(payload(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, media], ["key", "n_bytes", "media"])

    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return arrow_pass(rows, passes, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def media_features(df: DataFrame, key: str, media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Digests of the stored file and of the samples read back, and the fingerprint arrays.

    ``feature`` names the fingerprint: counts of pairs and a digest of both arrays. ``peak_times`` and
    ``peak_hashes`` are the arrays. A null file gives nulls; a file that wave cannot read raises.
    """
    kind = dict(df.dtypes)[key]
    names = [
        "key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "peak_times", "peak_hashes",
    ]
    schema = (
        f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, peak_times array<int>, peak_hashes array<int>"
    )

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        samples = read_wav(data)
        times, hashes = fingerprints(samples)
        digest = hashlib.sha256(times.astype("<i4").tobytes() + hashes.astype("<i4").tobytes()).hexdigest()
        return (
            len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(data),
            hashlib.sha256(data).hexdigest(), f"{len(times)}:{digest[:32]}", times, hashes,
        )

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            found = zip(*map(features, cells(batch, "media")))
            columns = [pa.array(list(c), k) for c, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    rows = df.select(F.col(key).alias("key"), F.col(n_bytes).alias("n_bytes"), F.col(media).alias("media"))
    return arrow_pass(rows, passes, schema).withColumnRenamed("key", key)
