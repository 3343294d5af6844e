"""Documents as media: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

The UTF-8 bytes of a text, padded with bytes 255 to a positive multiple of BLOCK, are the 8-bit samples of a mono WAV.
Features come from the samples read back from that WAV: each of the PEAKS strongest local peaks of a frame's spectrum is
an anchor and is paired with the weaker of them in its own frame, and with the strongest peak of each of the next REACH
frames; a pair (f1, f2, distance in frames) is one integer, stored beside the time code of its first peak. Null and empty
texts are one block of padding; equal texts have equal values. Repeated rows are fingerprinted each; other columns of
docs are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import release_memory
from sparkwarden.session import ship_package

BLOCK = 576
RATE = 8000
FRAME, HOP = 192, 96
PEAKS, REACH = 3, 2
#: Power below which a local maximum is rounding noise.
FLOOR = 1.0
#: Frames transformed at once, so that a long text takes no more memory than a short one.
FRAMES_AT_ONCE = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Frequency bins of the PEAKS strongest local maxima of each frame, strongest first; 0 where there are fewer."""
    x = np.frombuffer(samples, np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.zeros((len(frames), PEAKS), np.int32)
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        part = (frames[at : at + FRAMES_AT_ONCE].astype(np.float32) - 128.0) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        tops = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > FLOOR), inner, 0)
        for k in range(PEAKS):
            best = tops.argmax(axis=1)
            rows = np.arange(len(best))
            out[at : at + len(best), k] = np.where(tops[rows, best] > 0, best + 1, 0)
            tops[rows, best] = 0
    return out


def pairs(tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and codes of the pairs of anchors, by time, distance, and strength of the anchor and its partner."""
    n = len(tops)
    times, codes, order = [], [], []
    for d in range(min(REACH, n - 1) + 1):
        for a in range(PEAKS):
            for b in (range(a + 1, PEAKS) if d == 0 else (0,)):
                first, second = tops[: n - d, a], tops[d:, b]
                at = np.flatnonzero((first > 0) & (second > 0))
                times.append(at)
                codes.append((first[at] << 12) | (second[at] << 3) | d)
                order.append(np.full(len(at), (d * PEAKS + a) * PEAKS + b))
    t, c = np.concatenate(times), np.concatenate(codes)
    by = np.lexsort((np.concatenate(order), t))
    return t[by].astype(np.int32), c[by].astype(np.int32)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per document: sizes and hashes of payload and WAV, n_frames, time_codes, pair_codes (and wav if keep_media)."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"].where(batch["text"].notna(), ""):
                stored = to_wav(payload(text))
                back = from_wav(stored)
                tops = peaks(back)
                times, codes = pairs(tops)
                rows.append((len(text.encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), len(tops), times, codes, *([stored] if keep_media else [])))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "time_codes", "pair_codes", *(["wav"] if keep_media else [])]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out
        release_memory()

    return docs.mapInPandas(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "n_frames int, time_codes array<int>, pair_codes array<int>" + (", wav binary" if keep_media else ""),
    )
