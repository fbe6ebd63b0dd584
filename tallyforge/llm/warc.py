"""WARC archives: writing pages as records, and reading them back with segment reassembly.

A record's block is an HTTP response whose body is framed in chunks. A block over SEGMENT bytes is cut: the first segment is
the record itself, the others are continuation records, written to another archive of the same task. Reading groups the
continuations by the identifier of their origin, orders them by segment number, verifies the total length and decodes
the chunk framing. Archives are gzip, a member for each record, in a folder that all executors share; a table of their paths,
committed by Spark, says which count, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import new_folder, picked, stored

#: Bytes of a block in one record, of an HTTP chunk, of an archive before a new one begins, and of what is read at once.
SEGMENT, CHUNK, ARCHIVE, AT_ONCE = 16_384, 4096, 64 << 20, 4 << 20
#: A payload's rows are dealt to so many tasks, however many pages share it.
SALTS = 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What reading returns, besides payload.
FIELDS = "record_id string, page_id long, record_type string, refers_to long, uri string, payload_bytes long, payload_digest string, problem string"
PARTS = "origin string, segment int, total long, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in HTTP chunk framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([b"%x\r\n%b\r\n" % (len(p), p) for p in parts]) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in HTTP chunk framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n, at = int(body[at:end].split(b";")[0], 16), end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def _head(first: bytes, fields: list[tuple[str, object]]) -> bytes:
    clean = [(k, "".join(" " if c in "\r\n" else c for c in str(v))) for k, v in fields if v is not None]
    return first + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean).encode() + b"\r\n"


def records(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT) -> Iterator[tuple[bool, bytes]]:
    """(whether it is a continuation, record) for one page: a response, in segments if it is long, or a revisit without body."""
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    about = [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        block = _head(b"HTTP/1.1 200 OK", [("Content-Type", "text/html"), ("Content-Length", len(payload))])
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *common, *about, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to), ("Content-Length", len(block))]
        yield False, _head(b"WARC/1.1", fields) + block + b"\r\n\r\n"
        return
    block = _head(b"HTTP/1.1 200 OK", [("Content-Type", "text/html"), ("Transfer-Encoding", "chunked")]) + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        if n == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), *common, *about, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}:part:{n}>"), *common, ("WARC-Segment-Origin-ID",
                record_id), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)]
        yield n > 1, _head(b"WARC/1.1", [*fields, ("Content-Length", len(part))]) + part + b"\r\n\r\n"


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(record_id, uri, payload, refers_to): refers_to is null for a response. Of records with equal payloads of at least
    least_bytes, the one with the largest page_id is the response; rows without a page_id revisit it, or are all responses if
    none has one. Repeated rows of the largest page_id are all responses. Null payloads are empty, very long ones are written whole, in
    segments. Other columns of pages, whatever their names, are not used."""
    given = picked(pages, page_id=page_id, uri=url, html=html)
    rows = given.select(F.col("page_id").cast("long"), "uri", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"),
        F.count("*").alias("n")).where("n > 1").select("sha", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "sha"), F.lit(SALTS)).cast("int")).join(groups, ["sha", "salt"], "left")
    again = F.row_number().over(Window.partitionBy("sha", "salt", "page_id").orderBy("uri"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), "sha")
    dealt = dealt.withColumn("again", again)
    return dealt.select(
        F.concat(name, F.when(F.col("again") > 1, F.concat(F.lit(":"), F.col("again").cast("string"))).otherwise(""), F.lit(">")).alias("record_id"), "uri", "payload",
        F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.concat(F.lit("<urn:page:"), F.col("last").cast("string"), F.lit(":"), "sha", F.lit(">"))).alias("refers_to"),
    )


def write(planned: DataFrame, folder: str, segment: int = SEGMENT) -> DataFrame:
    """Writes (record_id, uri, payload, refers_to) as archives into the folder; returns the stored table (path, n) of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        to, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        to.create_dir(base)
        files: dict[bool, list] = {}
        done: list[tuple[str, int]] = []

        def close(kind: bool) -> None:
            path, out, n, _ = files.pop(kind)
            out.close()
            done.append((path, n))

        for b in batches:
            for rid, uri, payload, refers in zip(*[b.column(c).to_pylist() for c in ("record_id", "uri", "payload", "refers_to")]):
                for kind, record in records(rid, uri, payload, refers, segment):
                    if kind not in files:
                        path = f"{base}/{'continued-' if kind else ''}{uuid.uuid4().hex}.warc.gz"
                        files[kind] = [path, to.open_output_stream(path, compression=None), 0, 0]
                    member = gzip.compress(record, 1, mtime=0)
                    files[kind][1].write(member)
                    files[kind][2] += 1
                    files[kind][3] += len(member)
                    if files[kind][3] >= ARCHIVE:
                        close(kind)
        for kind in list(files):
            close(kind)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["path", "n"])

    return stored(planned.mapInArrow(run, "path string, n long"), "warc-archives")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed WARC stream. A record that is cut short raises."""
    while first := stream.readline():
        if first == b"\r\n":
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {first[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            fields[k.lower()] = v
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("record is cut short")
        yield fields, block


def _page(name: str | None) -> int | None:
    found = (name or "").split(":")
    return int(found[2]) if len(found) > 3 and found[2] != "null" else None


def content(block: bytes, said: str | None) -> tuple[int | None, str | None, bytes | None, str | None]:
    """(length, digest, payload, problem) of an HTTP response with a body, checked against the digest that its record states."""
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as e:
        return None, None, None, str(e)
    found = digest(payload)
    right = said in (None, found)
    return len(payload), found, payload if right else None, None if right else "digest differs"


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """archives (path) -> one row for each response and revisit, columns FIELDS and, if asked for, payload.

    A revisit's length and digest are those that it states of the full payload, and its payload is null. Records of which segments
    are missing, or whose length, framing or digest are wrong, say so in problem and have no payload.
    """
    extra = ", payload binary" if payload else ""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri",
        pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string()), *([("payload",
        pa.binary())] if payload else [])])
    parts = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])

    def rows(fields: dict[str, str], block: bytes) -> tuple:
        kind, rid, said = fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-payload-digest", "sha1:").partition(":")[2] or None
        number = fields.get("warc-segment-number")
        refers, data = None, None
        if kind == "revisit":
            http = dict(x.lower().split(": ", 1) for x in block.decode("latin-1").split("\r\n")[1:] if ": " in x)
            size, found, problem, refers = int(http["content-length"]) if "content-length" in http else None, said, None, _page(fields.get("warc-refers-to"))
        elif number:
            size, found, problem = None, said, None
        else:
            size, found, data, problem = content(block, said)
        own = (rid, _page(rid), kind, refers, fields.get("warc-target-uri"), size, found, problem, *([data] if payload else []))
        total = fields.get("warc-segment-total-length")
        return own + ((fields.get("warc-segment-origin-id", rid), int(number), int(total) if total else None, block) if number else (None,) * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        both = pa.schema([*schema, *parts])
        for b in batches:
            for path in b.column(0).to_pylist():
                at, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                found, size = [], 0
                with at.open_input_stream(base, compression=None) as raw, gzip.open(raw) as stream:
                    for fields, block in parse(stream):
                        found.append(rows(fields, block))
                        size += len(block)
                        if size > AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), both)], schema=both)
                            found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), both)], schema=both)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held = [], 0
            for i in range(b.num_rows):
                (x,) = b.slice(i, 1).to_pylist()
                segments, total, said = sorted(x.pop("segments"), key=lambda s: s["segment"]), x.pop("total"), x["payload_digest"]
                block = b"".join([s["block"] for s in segments])
                if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or len(block) != total or x["record_id"] is None:
                    size, data, problem = None, None, "segments are missing or of the wrong length"
                else:
                    size, said, data, problem = content(block, said)
                found.append({**x, "payload_bytes": size, "payload_digest": said, "problem": problem, **({"payload": data} if payload else {})})
                held += len(block) if payload else 0
                if held > AT_ONCE:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found, held = [], 0
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    files = archives.select("path").repartition(max(1, min(archives.count(), 4 * archives.sparkSession.sparkContext.defaultParallelism)))
    met = files.mapInArrow(run, f"{FIELDS}{extra}, {PARTS}")
    names = [f.name for f in schema]
    origin = {c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_id", "page_id", "record_type", "refers_to", "uri", "payload_digest")}
    cut = met.where("segment is not null").groupBy("origin").agg(*origin.values(), F.max("total").alias("total"), F.collect_list(F.struct("segment", "block")).alias("segments")).drop("origin")
    return met.where("segment is null").select(*names).unionByName(cut.mapInArrow(join, f"{FIELDS}{extra}"))


def unresolved(found: DataFrame) -> DataFrame:
    """Of records read (columns FIELDS), the revisits whose response is not there or has another digest."""
    responses = found.where("record_type = 'response' AND problem IS NULL").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return found.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left_anti").select(*found.columns)


def round_trip(pages: DataFrame, payload: bool = False, **columns) -> DataFrame:
    """Writes a record for every page into new archives in the shared folder and reads them back."""
    spark: SparkSession = pages.sparkSession
    return read(write(plan(pages, **columns), new_folder(spark, "warc")), payload)
