"""Media columns: bytes as WAV, short-time spectra and fingerprints of spectral-peak pairs."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import text_batches

RATE, WINDOW, HOP, UNIT = 8000, 256, 128, 64
#: Spectral bins in which one peak each is sought, and how many frames on a peak is paired.
BANDS, FAN = ((1, 8), (8, 24), (24, 56), (56, 129)), 3
BLOCK = 1 << 12

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("times", pa.list_(pa.int32())), ("marks", pa.list_(pa.int32()))])
_DDL = "doc_id long, n_bytes long, media binary, payload binary, times array<int>, marks array<int>"


def write_wav(payload: bytes) -> bytes:
    """payload as the 8-bit samples of a one-channel WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def peak_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and mark of each peak pair, by frame.

    A frame starts at each hop, and silence follows the last sample, so every sample is in a frame.
    Every frame has the loudest bin of each band that is above the frame's mean; it is paired with the
    next band's peak in the same frame (0: none, so a text of one frame has marks too) and 1 to FAN
    frames on. A mark holds both bins and the step between the frames.
    """
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    x = np.r_[x, np.zeros(-len(x) % HOP + WINDOW - HOP, np.float32)]
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    taper = np.hanning(WINDOW).astype(np.float32)
    peaks = np.zeros((len(frames), len(BANDS)), np.int32)  # 0: none
    for at in range(0, len(frames), BLOCK):
        loud = np.abs(np.fft.rfft(frames[at : at + BLOCK] * taper, axis=1))
        mean = loud[:, 1:].mean(axis=1)
        for i, (a, b) in enumerate(BANDS):
            best = loud[:, a:b].argmax(axis=1)
            peaks[at : at + BLOCK, i] = np.where(loud[np.arange(len(loud)), a + best] > mean, a + best, 0)
    times, marks = [], []
    for step in range(FAN + 1):
        first, second = peaks[: max(0, len(peaks) - step)], np.roll(peaks, -1, axis=1)[step:]
        t, i = np.nonzero((first > 0) & ((second > 0) | (step == 0)))
        times.append(t)
        marks.append(first[t, i] << 11 | second[t, i] << 3 | step)
    t, m = np.concatenate(times), np.concatenate(marks)
    order = np.lexsort((m, t))
    return t[order].astype(np.int32), m[order].astype(np.int32)


def media_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload, times, marks for each row's text.

    The text's UTF-8 bytes (null: none), filled with bytes 0 to a positive multiple of 64, are written
    as a WAV file, media; payload and the fingerprint are what a reader of that file gets. times
    and marks are equally long: the frame of each peak pair and its mark. Equal texts give equal
    values. Repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                media = write_wav(data + bytes(-len(data) % UNIT if data else UNIT))
                payload = read_wav(media)
                rows.append((doc_id, len(data), media, payload, *peak_pairs(payload)))
                size += len(media)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DDL)


def media_digest(docs: DataFrame) -> DataFrame:
    """Checksums of media_fingerprints, a row for each row of docs."""
    tail = F.expr(f"substring(payload, length(payload) - {UNIT - 1}, {UNIT})")
    return media_fingerprints(docs).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("marks"), F.lower(F.hex(F.xxhash64("times", "marks")))).alias("feature"),
    )
