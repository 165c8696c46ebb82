"""Media columns: audio kept as WAV bytes in a binary column, and spectral-peak pair fingerprints of it.

The wave module writes and reads the WAV bytes (mono, 8-bit samples). A short-time Fourier transform (Hann window
of FRAME samples, hop HOP) gives magnitudes; in each frame the strongest bin of each band is a peak. Every peak is
paired with the peaks of the next FAN frames in its band; a pair's code holds both bins and the frames between
them. The fingerprint is an array of codes with their time: code << 24 | frame of the earlier peak.

Defined results: a null text is an empty payload (64 zero bytes); equal texts have equal media and fingerprints;
silence has no peaks; an empty table gives an empty table; extra columns are ignored.
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

from lexspan.llm.textkit import steps
from lexspan.plans.runtime import ship

RATE, FRAME, HOP, FAN = 8000, 256, 128, 2
BANDS = [(1, 12), (12, 45), (45, 129)]
_WINDOW = np.hanning(FRAME).astype(np.float32)
#: Frames that one transform handles; bounds memory for very long media.
FRAMES_AT_ONCE = 4096


def to_wav(samples: bytes) -> bytes:
    """8-bit mono WAV bytes with these samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of 8-bit mono WAV bytes."""
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono WAV expected")
        return r.readframes(r.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strongest bin of each band in each frame (frames x bands), and whether it is a peak at all."""
    count = 1 + (len(samples) + HOP - 1) // HOP  # frames centred on 0, HOP, 2 HOP, ... with silence around
    padded = np.full((count - 1) * HOP + FRAME, 128, np.uint8)
    padded[FRAME // 2 : FRAME // 2 + len(samples)] = samples
    bins, real = np.empty((count, len(BANDS)), np.int64), np.empty((count, len(BANDS)), bool)
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    for low in range(0, count, FRAMES_AT_ONCE):
        block = frames[low : low + FRAMES_AT_ONCE].astype(np.float32) - np.float32(128)
        power = np.abs(np.fft.rfft(block * _WINDOW, axis=1))
        for k, (a, b) in enumerate(BANDS):
            part = power[:, a:b]
            at = part.argmax(axis=1)
            bins[low : low + len(block), k] = a + at
            real[low : low + len(block), k] = part[np.arange(len(block)), at] > 1e-3
    return bins, real


def peak_pairs(samples: np.ndarray) -> np.ndarray:
    """Time-coded pair fingerprints, ordered by time, then band, then distance."""
    bins, real = spectral_peaks(samples)
    found = []
    for gap in range(1, FAN + 1):
        a, b = bins[:-gap], bins[gap:]
        frame, band = np.nonzero(real[:-gap] & real[gap:])
        code = a[frame, band] << 13 | b[frame, band] << 4 | gap
        found.append(np.stack([frame, band, np.full(len(frame), gap), code << 24 | frame]))
    every = np.concatenate(found, axis=1)
    return every[3][np.lexsort(every[:3][::-1])]


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and the number of bytes before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def media_features(docs: DataFrame, text: str = "text", media: bool = False) -> DataFrame:
    """Store every whole text as WAV, read it back and fingerprint it; a narrow operator.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, peaks
    (array<long>), and the WAV bytes themselves in column media if wanted.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "peaks"] + ["media"] * media
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, peaks array<long>" + ", media binary" * media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            rows = []
            for t in texts:
                payload, n = payload_of(t)
                stored = to_wav(payload)
                back = from_wav(stored)
                peaks = peak_pairs(np.frombuffer(back, np.uint8))
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), peaks, stored))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns[: len(names) - 1], kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return docs.select(docs["doc_id"], docs[text].alias("text")).mapInArrow(run, schema)
