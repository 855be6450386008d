"""Operator 6: media columns. Bytes stored as 8-bit WAV samples, and spectral-peak pair fingerprints of what is read back.

Features: the short-time Fourier transform of the samples, the peaks among neighbours in time and frequency, and pairs
of peaks close in time. A pair is coded by its two frequencies and the frames between; the code and the frame of its
first peak are stored as two arrays.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, columns_as, sliced

RATE = 8000
WINDOW, HOP = 1024, 512
#: Peaks kept per frame, pairs per peak, and frames between a pair's peaks at most.
PEAKS, FAN, REACH = 3, 3, 8
PAD = 64
_HANN = np.hanning(WINDOW).astype(np.float32)


def to_wav(data: bytes) -> bytes:
    """data, with bytes 0 up to a positive multiple of 64, as mono 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data + bytes(-len(data) % PAD or (0 if data else PAD)))
    return out.getvalue()


def samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit samples")
        return w.readframes(w.getnframes())


def peaks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequencies of spectral peaks, in order; blocks of frames at a time."""
    signal = np.frombuffer(data, np.uint8)
    n = max(1, 1 + -(-max(0, len(signal) - WINDOW) // HOP))
    times, tones = [], []
    for a in range(0, n, 256):
        b = min(n, a + 256)
        lo, hi = max(0, a - 1), min(n, b + 1)  # with the neighbours of the first and last frame
        part = signal[lo * HOP : (hi - 1) * HOP + WINDOW].astype(np.float32) - 128
        part = np.pad(part, (0, (hi - 1 - lo) * HOP + WINDOW - len(part)))
        power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, WINDOW)[::HOP] * _HANN)[:, 1:]) ** 2
        top = np.zeros_like(power, bool)
        top[:, 1:-1] = (power[:, 1:-1] > power[:, :-2]) & (power[:, 1:-1] >= power[:, 2:])
        top[1:] &= power[1:] >= power[:-1]
        top[:-1] &= power[:-1] >= power[1:]
        power = np.where(top, power, 0)[a - lo : b - lo]
        best = np.sort(np.argpartition(-power, PEAKS, axis=1)[:, :PEAKS], axis=1)
        frame, place = np.nonzero(np.take_along_axis(power, best, 1) > 0)
        times.append(frame + a)
        tones.append(best[frame, place] + 1)
    return np.concatenate(times), np.concatenate(tones)


def pairs(time: np.ndarray, tone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and codes of pairs of peaks, ordered by frame and code."""
    at, codes = [], []
    for k in range(1, FAN + 1):
        gap = time[k:] - time[:-k]
        near = gap <= REACH
        at.append(time[:-k][near])
        codes.append(tone[:-k][near] << 14 | tone[k:][near] << 4 | gap[near])
    at, codes = np.concatenate(at), np.concatenate(codes)
    order = np.lexsort((codes, at))
    return at[order].astype(np.int32), codes[order].astype(np.int32)


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each row's text in UTF-8 as a WAV file. Null text: empty, so 64 bytes 0.

    docs: doc_id (long) and text; other columns are ignored. Null and repeated doc_ids: a row each. No rows from none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for batch in sliced(batches, size=4 << 20):
            texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
            yield arrow_batch(schema, [batch.column(0), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), [to_wav(t or b"") for t in texts.to_pylist()]])

    return columns_as(docs, id="doc_id", text="text").withColumn("id", F.col("id").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))])


def fingerprints(media: DataFrame) -> DataFrame:
    """From (doc_id, n_bytes, media): digests of the file and of the samples read back, and the time-coded pairs.

    frames and codes are two arrays of one length: a pair's first frame and its code, in order. Null media: nulls. Media that
    are no mono 8-bit WAV: nulls but for the file's size and digest. Null and repeated doc_ids: a row each; equal media, equal
    values. An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for batch in sliced(batches, column=2, size=4 << 20):
            rows = []
            for name, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blob is None:
                    rows.append((name, n, *[None] * 7))
                    continue
                try:
                    data = samples(blob)
                except (wave.Error, EOFError, ValueError):
                    rows.append((name, n, None, None, None, len(blob), hashlib.sha256(blob).hexdigest(), None, None))
                    continue
                frames, codes = pairs(*peaks(data))
                rows.append((name, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(blob), hashlib.sha256(blob).hexdigest(), frames, codes))
            if rows:
                yield arrow_batch(_FEATURES, list(zip(*rows, strict=True)))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<int>, codes array<int>")
