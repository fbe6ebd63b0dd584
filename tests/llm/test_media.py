import hashlib
import io
import wave
import zlib

import numpy as np

from tallyforge.llm import media


def test_payloads_survive_and_digests_hold(spark, sf):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "z" * 70_000] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' AS media", "1 AS times")
    stored = media.store(docs)
    kept = {r.doc_id: bytes(r.media) for r in stored.select("doc_id", "media").collect()}
    for r in media.features(stored.drop("text")).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert media.padded(data) == payload and len(payload) % 192 == 0
        with wave.open(io.BytesIO(kept[r.doc_id])) as w:
            assert w.readframes(w.getnframes()) == payload and (w.getsampwidth(), w.getnchannels()) == (1, 1)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(kept[r.doc_id]), hashlib.sha256(kept[r.doc_id]).hexdigest())
        assert len(r.times) == len(r.codes)


def slow_pairs(samples):
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128
    if len(x) < media.FRAME:
        x = np.pad(x, (0, media.FRAME - len(x)))
    window, width = np.hanning(media.FRAME).astype(np.float32), media.FRAME // 2 // media.BANDS
    tops = []
    for a in range(0, len(x) - media.FRAME + 1, media.HOP):
        s = np.abs(np.fft.rfft(x[a : a + media.FRAME] * window))[1:]
        tops.append([(s[b * width : (b + 1) * width].max(), b * width + int(s[b * width : (b + 1) * width].argmax())) for b in range(media.BANDS)])
    peaks = [(t, f) for t, row in enumerate(tops) for b, (v, f) in enumerate(row) if v > 0 and (t == 0 or v >= tops[t - 1][b][0]) and (t + 1 == len(tops) or v > tops[t + 1][b][0])]
    pairs = [(t, f << 13 | g << 6 | u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 1 + media.FAN] if u - t < 64]
    return sorted(pairs)


def test_peak_pairs_equal_a_slow_transform(monkeypatch):
    rnd = np.random.default_rng(2)
    for n in (1, 192, 1920, 9600):
        data = rnd.integers(0, 256, n, dtype=np.uint8).tobytes()
        want = slow_pairs(data)
        for block in (4096, 7):  # long sounds are read in blocks
            monkeypatch.setattr(media, "FRAMES", block)
            assert list(zip(*map(list, media.peak_pairs(data)))) == want


def bursts(n, seed):
    """Tones of changing frequency, a frame of one and then one of silence."""
    rnd, out = np.random.default_rng(seed), []
    for f in rnd.integers(4, 124, n):
        out += [(128 + 100 * np.sin(2 * np.pi * f * np.arange(media.FRAME) / media.FRAME)).astype(np.uint8).tobytes(), bytes([128]) * media.FRAME]
    return b"".join(out)


def test_a_tone_has_its_frequency():
    tone = bursts(1, 1)
    f = int(np.random.default_rng(1).integers(4, 124, 1)[0])
    times, codes = media.peak_pairs(b"".join([tone] * 8))
    width = media.FRAME // 2 // media.BANDS
    band = (f - 1) // width  # bins count from frequency 1
    assert (f - 1) in {int(c) >> 13 for c in codes} and all((int(c) >> 13) // width < media.BANDS for c in codes) and band < media.BANDS


def test_likeness_finds_shifted_sounds(spark):
    sound, other = bursts(20, 5), bursts(20, 6)
    shifted = bytes([128]) * (media.HOP * 7) + sound
    rows = [(n, *[list(map(int, x)) for y in (media.peak_pairs(a), media.peak_pairs(b)) for x in y]) for n, a, b in (("same", sound, sound),
        ("shifted", sound, shifted), ("other", sound, other), ("none", bytes([128]) * 600, bytes([128]) * 600))]
    df = spark.createDataFrame(rows, "n string, t array<int>, c array<int>, ot array<int>, oc array<int>")
    got = {r.n: r.x for r in df.select("n", media.likeness(*[df[c] for c in ("t", "c", "ot", "oc")]).alias("x")).collect()}
    assert got["same"] == 1 and got["shifted"] > 0.8 and got["other"] < 0.2 and got["none"] == 1


def test_empty_table(spark):
    assert media.features(media.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
