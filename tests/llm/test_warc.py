import base64
import gzip
import hashlib
import io
import random

import pytest

from tallyforge.llm import warc


def slow(pages):
    """page rows -> sorted (page_id, bytes, digest, type, refers_to)."""
    last = {}
    for p, _, html in pages:
        k = html or ""
        if p is not None:
            last[k] = max(p, last.get(k, p))
    out = []
    for p, _, html in pages:
        data = (html or "").encode()
        m = last.get(html or "")
        again = m is not None and p != m
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", m if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)  # several archives a task
    rnd = random.Random(1)
    rows = [(i, f"http://x/{i}\r\nX: y", rnd.choice([None, "", "same", "é" * 9000, "WARC/1.1\r\n\r\n", "0\r\n\r\n" * 5000, f"own {i}"])) for i in range(60)]
    rows += [(7, "again", rows[7][2]), (None, None, "same"), (None, "u", "alone"), (3, None, "other payload")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'x' AS segment")
    got = warc.round_trip(pages, payload=True).collect()
    assert all(r.problem is None for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == slow(rows)
    texts = {(p, hashlib.sha1((h or "").encode()).digest()) for p, _, h in rows}
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, hashlib.sha1(bytes(r.payload)).digest()) in texts
    real = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(real).collect()),
        key=str) == slow([(r.page_id, r.url, r.html) for r in real.collect()])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunk_framing():
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        data = bytes(i * 7 % 256 for i in range(n))
        assert warc.dechunked(warc.chunked(data)) == data
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def lay(spark, tmp_path, records):
    path = str(tmp_path / f"{len(list(tmp_path.iterdir()))}.warc.gz")
    with open(path, "wb") as f:
        for r in records:
            f.write(gzip.compress(r))
    return spark.createDataFrame([(path,)], "path string")


def test_segments_in_any_order_and_faults(spark, tmp_path):
    data = bytes(random.Random(2).randbytes(5000))
    parts = [r for _, r in warc.records("<urn:page:1:x>", None, data, None, segment=700)]
    assert len(parts) > 5
    shuffled = parts[::-1]
    r = warc.read(lay(spark, tmp_path, shuffled)).first()
    assert (bytes(r.payload), r.problem, r.page_id) == (data, None, 1)
    r = warc.read(lay(spark, tmp_path, parts[:3] + parts[4:])).first()
    assert r.payload is None and "segments" in r.problem
    r = warc.read(lay(spark, tmp_path, parts[:-1])).first()
    assert r.payload is None and "segments" in r.problem
    whole = [r for _, r in warc.records("<urn:page:2:x>", "u", b"abc", None)]
    r = warc.read(lay(spark, tmp_path, [whole[0].replace(b"\r\nabc\r\n", b"\r\nabd\r\n")])).first()
    assert r.payload is None and r.problem == "digest differs"
    assert len(list(warc.parse(io.BytesIO(b"".join(parts))))) == len(parts)
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(whole[0][:-8])))


def test_revisits_are_checked_against_their_response(spark, tmp_path):
    made = [next(warc.records("<urn:page:1:x>", "u", b"abc", None))[1], next(warc.records("<urn:page:2:x>", "u", b"abc", "<urn:page:1:x>"))[1],
        next(warc.records("<urn:page:3:x>", "u", b"abc", "<urn:page:9:x>"))[1], next(warc.records("<urn:page:4:x>", "u", b"abd",
        "<urn:page:1:x>"))[1]]
    assert sorted(r.page_id for r in warc.unresolved(warc.read(lay(spark, tmp_path, made))).collect()) == [3, 4]
