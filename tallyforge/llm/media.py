"""Media columns: payloads as 8-bit WAV sound, and spectral-peak pair fingerprints of it.

A payload's bytes are the samples of a mono sound, so storing is lossless. Fingerprints follow the landmark method: a
short-time Fourier transform, peaks that are the largest of their frame and its neighbours in a band of frequencies,
and pairs of a peak with the next ones, each coded with the time at which it starts.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from tallyforge.llm.shared import numbered, place, with_python

#: Payloads are padded with PAD to a positive multiple of UNIT. Fixed by the contract.
UNIT, PAD, TAIL = 192, b" ", 16
RATE = 8000
#: Samples in a frame and between frames; bands in which a frame has a peak; peaks that one is paired with; frames at once.
FRAME, HOP, BANDS, FAN, FRAMES = 256, 128, 4, 3, 4096


def padded(data: bytes) -> bytes:
    return data + PAD * (-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono WAV."""
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV."""
    import wave

    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def peak_pairs(samples: bytes):
    """Time-coded arrays (time, code): for each pair of peaks the frame of the first, and first and second frequency and the frames
    between as one number."""
    import numpy as np

    x = np.frombuffer(samples, dtype=np.uint8)
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)), constant_values=128)
    n, window = 1 + (len(x) - FRAME) // HOP, np.hanning(FRAME).astype(np.float32)
    width = FRAME // 2 // BANDS
    tops, bins = np.empty((n, BANDS), dtype=np.float32), np.empty((n, BANDS), dtype=np.int64)
    for a in range(0, n, FRAMES):
        part = np.lib.stride_tricks.sliding_window_view(x[a * HOP : (min(n, a + FRAMES) - 1) * HOP + FRAME], FRAME)[::HOP]
        spectrum = np.abs(np.fft.rfft((part - np.float32(128)) * window, axis=1))[:, 1 : FRAME // 2 + 1].reshape(len(part), BANDS, width)
        bins[a : a + len(part)] = spectrum.argmax(axis=2)
        tops[a : a + len(part)] = spectrum.max(axis=2)
    beside = np.pad(tops, ((1, 1), (0, 0)), constant_values=-1)
    time, band = np.nonzero((tops > 0) & (tops >= beside[:-2]) & (tops > beside[2:]))
    frequency = bins[time, band] + band * width
    times, codes = [], []
    for k in range(1, FAN + 1):
        dt = time[k:] - time[:-k]
        near = dt < 64
        times.append(time[:-k][near])
        codes.append((frequency[:-k][near] << 13) | (frequency[k:][near] << 6) | dt[near])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8 length, unpadded) and media (the padded text as WAV). Null texts are empty, very long ones are stored
    whole; repeated rows are kept. Columns of docs named like a new one, in any case, are replaced."""

    def make(texts: list) -> list[pa.Array]:
        data = [(x or "").encode() for x in texts]
        return [pa.array(map(len, data), pa.int64()), pa.array([to_wav(padded(x)) for x in data], pa.binary())]

    return with_python(docs, text, StructType().add("n_bytes", LongType()).add("media", BinaryType()), make)


FEATURES = StructType().add("payload_bytes", LongType()).add("payload_sha256", StringType()).add("tail_crc32", LongType()).add("media_bytes",
    LongType()).add("media_sha256", StringType()).add("times", ArrayType(IntegerType())).add("codes", ArrayType(IntegerType()))


def features(stored: DataFrame, media: str = "media") -> DataFrame:
    """Each row without its media column but with what reading it gives: payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and the time-coded arrays times and codes. A null media gives nulls; a very long sound is transformed in
    blocks of FRAMES. Repeated rows are kept; columns named like a new one, in any case, are replaced."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def of(x: bytes | None) -> tuple:
        if x is None:
            return (None,) * len(kinds)
        payload = from_wav(x)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(x), hashlib.sha256(x).hexdigest(), *peak_pairs(payload))

    def make(sounds: list) -> list[pa.Array]:
        found = [of(x) for x in sounds]
        return [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]

    at = place(stored, media)
    rest = numbered(stored).withColumn("sound", F.col(f"c{at}")).select(*[f"c{i}" for i in range(len(stored.columns)) if i != at], "sound")
    named = rest.toDF(*[c for i, c in enumerate(stored.columns) if i != at], "sound of the row")
    read = with_python(named, "sound of the row", FEATURES, make)
    places = [i for i, c in enumerate(read.columns) if c != "sound of the row"]
    return numbered(read).select(*[f"c{i}" for i in places]).toDF(*[read.columns[i] for i in places])


def likeness(times: Column, codes: Column, other_times: Column, other_codes: Column) -> Column:
    """Of two fingerprints, the share of the smaller one's pairs that the other has with one and the same shift in time: 0 to 1, and
    1 for two without any pair. All by built-in functions."""
    mine = F.arrays_zip(times.alias("t"), codes.alias("c"))
    theirs = F.arrays_zip(other_times.alias("t"), other_codes.alias("c"))
    shifts = F.flatten(F.transform(mine, lambda a: F.transform(F.filter(theirs, lambda b: b["c"] == a["c"]), lambda b: b["t"] - a["t"])))
    most = F.array_max(F.transform(F.array_distinct(shifts), lambda d: F.size(F.filter(shifts, lambda x: x == d))))
    least = F.least(F.size(codes), F.size(other_codes))
    return F.when(least == 0, (F.size(codes) == F.size(other_codes)).cast("double")).otherwise(F.least(F.lit(1.0), F.coalesce(most, F.lit(0)) / least))
