"""Text payloads as WAV media columns with spectral-peak fingerprints.

``store`` writes each payload as an 8-bit mono WAV file into a binary column;
``fingerprint`` reads such files with the wave module, takes short-time Fourier
transforms, and pairs each frame's peaks with peaks of the next frames.  A pair
(earlier bin, later bin, frame distance) with its time is one 64-bit code, so
the fingerprint of a file is one array of time-coded numbers.
"""

from __future__ import annotations

import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import raw_text, steps

#: Payloads are padded to a positive multiple of this many bytes.
BLOCK = 64
RATE = 8000
#: Frames transformed at a time, so that a long text takes little memory.
FRAMES = 1024


def _store(batches):
    for step in steps(batches):
        data, bounds = raw_text(step.column("text"))
        whole = data.tobytes()
        sizes, media = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            sizes.append(b - a)
            payload = whole[a:b] + bytes(-(b - a) % BLOCK or (0 if b > a else BLOCK))
            out = io.BytesIO()
            with wave.open(out, "wb") as sink:
                sink.setnchannels(1)
                sink.setsampwidth(1)
                sink.setframerate(RATE)
                sink.writeframes(payload)
            media.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """Each text's UTF-8 bytes, padded with zero bytes, as a WAV file.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Result
    per row: doc_id (as given, null too), n_bytes without padding, media.  Null
    and empty texts become one block of zeros.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def peak_pairs(samples: np.ndarray, frame: int, hop: int, fan: int) -> np.ndarray:
    """Time-coded peak pairs of one signal; each frame gives its two highest local maxima.

    A maximum is higher than the bin below and not lower than the one above; a
    frame with one only gives it twice.

    Silence of frame - hop samples on either side lets the first and the last
    samples lie in as many frames as all others; a signal has two frames at least.
    The mean is taken off first, or its steps at the ends would be the peaks.
    """
    x = samples.astype(np.float32)
    if len(x):
        x -= x.mean(dtype=np.float64)
    edge = max(frame - hop, 0)
    size = max(len(x) + 2 * edge, frame + hop)
    x = np.pad(x, (edge, size - len(x) - edge + -(size - frame) % hop))
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    window = np.hanning(frame).astype(np.float32)
    bins = np.empty((len(frames), 2), np.int64)
    for at in range(0, len(frames), FRAMES):
        power = np.abs(np.fft.rfft(frames[at : at + FRAMES] * window, axis=1))[:, 1:]
        peak = np.ones(power.shape, bool)
        peak[:, 1:] = power[:, 1:] > power[:, :-1]
        peak[:, :-1] &= power[:, :-1] >= power[:, 1:]
        power = np.where(peak, power, -1)
        top, n = np.argmax(power, axis=1), np.arange(len(power))
        power[n, top] = -1
        second = np.argmax(power, axis=1)
        bins[at : at + FRAMES, 0] = top
        bins[at : at + FRAMES, 1] = np.where(power[n, second] < 0, top, second)
    rows = np.arange(len(bins))
    codes = []
    for ahead in range(1, fan + 1):
        early, late = bins[:-ahead], bins[ahead:]
        time = rows[: len(early), None, None]
        codes.append((time << 20 | early[:, :, None] << 12 | late[:, None, :] << 4 | ahead).ravel())
    return np.sort(np.concatenate(codes))


def _fingerprint(frame: int, hop: int, fan: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                payloads, sizes, tails, peaks = [], [], [], []
                for blob, size in zip(part.column("media"), part.column("n_bytes").to_pylist(), strict=True):
                    with wave.open(io.BytesIO(blob.as_py())) as source:
                        payload = source.readframes(source.getnframes())
                    payloads.append(payload)
                    sizes.append(len(payload))
                    tails.append(zlib.crc32(payload[-BLOCK:]))
                    peaks.append(peak_pairs(np.frombuffer(payload, np.uint8)[:size], frame, hop, fan))
                bounds = np.append(0, np.cumsum([len(p) for p in peaks])).astype(np.int32)
                codes = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(peaks).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), part.column("media"), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tails, pa.int64()), codes],
                    ["doc_id", "n_bytes", "media", "payload", "payload_bytes", "tail_crc32", "peaks"],
                )

    return run


def fingerprint(media: DataFrame, frame: int = 128, hop: int = 32, fan: int = 3) -> DataFrame:
    """Read WAV columns back and fingerprint them.

    ``media`` needs doc_id, n_bytes and media, as :func:`store` returns them.
    Adds payload (the samples read back), payload_bytes, tail_crc32 (of the
    last 64 payload bytes) and peaks (sorted time-coded pairs of the samples
    without padding, never empty; texts of a few bytes can have the same).
    Frames overlap by three quarters, so that shared content gives like pairs
    where it is shifted.  Null ids stay, repeated rows are read each on its own,
    other columns are ignored, and an empty table gives an empty result.  ``frame`` is at most 512 so that a bin fits a byte.
    """
    if not 2 <= frame <= 512 or not 0 < hop or not 0 < fan < 16:
        raise ValueError("2 <= frame <= 512, hop > 0 and 0 < fan < 16 are needed")
    schema = "doc_id long, n_bytes long, media binary, payload binary, payload_bytes long, tail_crc32 long, peaks array<long>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_fingerprint(frame, hop, fan), schema)
