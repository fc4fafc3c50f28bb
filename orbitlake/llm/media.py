"""Media columns: texts as 8-bit WAV, spectra and spectral-peak fingerprints.

A payload's bytes are the samples of a mono 8-bit WAV written and read by the wave
module. Short-time Fourier transforms (periodic Hann windows of `FRAME` samples, hops of half
a window, so that each sample counts in some frame and passages at other offsets still meet) give
the loudest bin of each of `BANDS` bands a frame where it exceeds that band's mean; peaks of
neighbouring frames are paired with those up to `REACH` frames later, and each pair
(bin, later bin, distance) is a landmark with its frame as time code. Frames are
transformed in chunks of fixed size, so memory does not follow the text's length.

Null texts count as empty; equal texts give equal values.
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

from .common import slices

RATE, FRAME, HOP, BANDS, REACH, CHUNK = 8000, 256, 128, 3, 6, 4096
# The bands' bins.
EDGES = (4, 20, 52, 128)
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def padded(text: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray, hop: int = FRAME) -> tuple[np.ndarray, np.ndarray]:
    """Frames (one each `hop` samples) and bins of the spectral peaks, by frame, then band."""
    n = max(1, -(-len(samples) // hop))
    times, bins = [], []
    for a in range(0, n, CHUNK):
        m = min(CHUNK, n - a)
        part = samples[a * hop : (a + m - 1) * hop + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (m - 1) * hop + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::hop] * _WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32)
        for low, high in zip(EDGES, EDGES[1:], strict=False):
            band = power[:, low:high]
            best = band.argmax(axis=1)
            top = band[np.arange(m), best]
            loud = np.flatnonzero(top > 2 * band.mean(axis=1) + 1e-3)
            times.append(a + loud)
            bins.append(low + best[loud])
    t, b = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((b, t))
    return t[order], b[order]


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks of peak pairs and their time codes: hash = bin << 16 | later bin << 8 | frames between."""
    t, b = peaks(samples, HOP)
    codes, times = [], []
    for step in range(1, min(BANDS * (REACH + 1) - 1, max(1, len(t))) + 1):
        gap = t[step:] - t[:-step]
        ok = np.flatnonzero((gap >= 1) & (gap <= REACH))
        codes.append(b[ok].astype(np.int64) << 16 | b[ok + step].astype(np.int64) << 8 | gap[ok])
        times.append(t[ok])
    code, time = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((code, time))
    return code[order], time[order]


def feature_of(code: np.ndarray, time: np.ndarray) -> str:
    """Landmarks as a short string: their number, frames spanned and a digest."""
    digest = hashlib.sha256(code.astype("<i4").tobytes() + time.astype("<i4").tobytes()).hexdigest()[:16]
    return f"{len(code)}:{int(time[-1]) + 1 if len(time) else 0}:{digest}"


_COLUMNS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "landmarks": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "media": pa.binary()}


def _encoded(keep_media: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, rows=256):
                cols: dict[str, list] = {c: [] for c in _COLUMNS}
                for text in pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist():
                    stored = to_wav(padded(text))
                    back = from_wav(stored)
                    code, time = fingerprint(np.frombuffer(back, np.uint8))
                    values = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(code, time), code.astype(np.int32), time.astype(np.int32), stored if keep_media else None)
                    for c, v in zip(cols, values, strict=True):
                        cols[c].append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, _COLUMNS[c]) for c, v in cols.items())], names=["doc_id", *cols])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row for each row of docs: sizes and digests of what was stored and read back, `feature` (a digest of the landmarks), the landmarks with their frames (`times`), and the WAV (`media`). A map over the scan: nothing is shuffled."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        _encoded(keep_media),
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, landmarks array<int>, times array<int>, media binary",
    )


def digest(docs: DataFrame, **columns: str) -> DataFrame:
    """The same without the media."""
    return encode(docs, keep_media=False, **columns).drop("media")
