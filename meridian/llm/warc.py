"""WARC archives: writing, normalising monolithic gzip, and reading back by a sidecar offset index.

A monolithic archive is one gzip stream over all its records, which can only be read from its start. The
normaliser inflates such a stream once, in pieces of bounded size, and writes every record as a gzip member of its
own, with a sidecar index of (record, offset, length), so that any record can be fetched alone. The reader fetches
records by the index and checks each payload against its digest.

Archives go below the shared folder through Arrow's filesystems (local paths, hdfs, s3, gs). A task writes under a
name no other attempt uses and returns it; the table of names is stored, so that only the files of attempts
that succeeded are ever read. Of equal payloads of at least MIN_REVISIT bytes the record with the largest id is the
response, and the others are revisits without a payload.

Rows: null html is an empty payload; a null url becomes urn:page:<id>; rows that repeat the largest id are
all responses; null ids come before all others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import by_bytes, shared_dir, stored

MIN_REVISIT = 1000
PIECE = 1 << 20
#: Levels of compression: an archive that is only read once, and the lasting one.
FAST, KEPT = 1, 4
DATE = "2020-01-01T00:00:00Z"
_HEADER_END = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header but no payload."""
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url is not None else f"urn:page:{page_id}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _HEADER_END + block + _HEADER_END


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, in bounded pieces."""
    engine = zlib.decompressobj(31)
    while data := source.read(PIECE):
        while data:
            if engine.eof:
                engine = zlib.decompressobj(31)
            yield engine.decompress(data, PIECE)
            data = engine.unconsumed_tail or engine.unused_data
    while not engine.eof:
        if not (rest := engine.decompress(engine.unconsumed_tail, PIECE)):
            raise EOFError("the gzip stream ends early")
        yield rest


def normalise(source, sink, level: int = KEPT) -> Iterator[tuple[dict[str, str], int, int]]:
    """Inflates `source` once and writes each record to `sink` as its own member. Yields (headers, offset, length)."""
    pieces, held, offset, over = inflated(source), bytearray(), 0, False

    def more() -> bool:
        nonlocal over
        piece = next(pieces, None)
        if piece is None:
            over = True
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(_HEADER_END)) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise EOFError("the archive ends inside a record's header")
            return
        own = headers(bytes(held[:end]))
        left = end + 4 + int(own["content-length"]) + 4
        member, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        while left:
            if not held and not more():
                raise EOFError("the archive ends inside a record")
            took = min(left, len(held))
            length += sink.write(out) if (out := member.compress(bytes(held[:took]))) else 0
            del held[:took]
            left -= took
        length += sink.write(member.flush())
        yield own, offset, length
        offset += length


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes monolithic archives of (page_id, url, payload, digest, refers_to, revisit), one or more a
    task; returns their names."""

    def run(batches):
        sink = member = path = None
        written = 0
        for batch in batches:
            for part in by_bytes(batch, 8 << 20):
                for r in part.to_pylist():
                    if sink is None:
                        path, written = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        fs, at = _open(path)
                        sink, member = fs.open_output_stream(at, compression=None), zlib.compressobj(FAST, zlib.DEFLATED, 31)
                    data = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["revisit"])
                    sink.write(member.compress(data))
                    written += len(data)
                    if written >= 256 << 20:
                        sink.write(member.flush())
                        sink.close()
                        sink = None
                        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])
        if sink is not None:
            sink.write(member.flush())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    fs, at = _open(folder)
    fs.create_dir(at)
    return stored(pages.select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(run, "path string"))


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a member a record, beside it a sidecar .idx file; returns the index:
    (path, offset, length, record_id)."""

    def run(batches):
        for batch in batches:
            for source_path in batch.column(0).to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                fs, at = _open(path)
                source_fs, source_at = _open(source_path)
                rows: list[tuple[str, int, int]] = []
                with source_fs.open_input_stream(source_at, compression=None) as source, fs.open_output_stream(at, compression=None) as sink:
                    for own, offset, length in normalise(source, sink):
                        rows.append((own["warc-record-id"], offset, length))
                with fs.open_output_stream(f"{at}.idx", compression=None) as index:
                    index.write("".join([f"{r}\t{o}\t{n}\n" for r, o, n in rows]).encode())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([o for _, o, _ in rows], pa.int64()), pa.array([n for _, _, n in rows], pa.int64()), pa.array([r for r, _, _ in rows])], names=["path", "offset", "length", "record_id"])

    fs, at = _open(folder)
    fs.create_dir(at)
    # a task an archive: their names are so small that Spark would put them all into one
    return stored(archives.repartition(max(1, archives.count()), "path").mapInArrow(run, "path string, offset long, length long, record_id string"))


def read_archives(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every indexed record, each
    fetched by its offset; a response's payload is checked against its digest."""

    def run(batches):
        path = source = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    path = r["path"]
                    fs, at = _open(path)
                    source = fs.open_input_file(at)
                source.seek(r["offset"])
                head, _, block = zlib.decompress(source.read(r["length"]), 31).partition(_HEADER_END)
                own = headers(head)
                http, _, payload = block[: int(own["content-length"])].partition(_HEADER_END)
                digest, size = own["warc-payload-digest"].removeprefix("sha1:"), int(http.rpartition(b"Content-Length:")[2])
                revisit = own["warc-type"] == "revisit"
                if not revisit and (len(payload) != size or hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest):
                    raise ValueError(f"{r['record_id']}: its payload does not have its digest")
                out.append((int(own["x-page-id"]) if own["x-page-id"] else None, size, digest, own["warc-type"], int(own["warc-refers-to"][10:-1]) if revisit else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("path", "offset", "length", "record_id").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit): what goes into each page's record."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= MIN_REVISIT
    leaders = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1 and leader is not null").select("digest", "leader")
    # one row a digest that repeats; Spark deals a digest with very many pages to several tasks
    joined = rows.join(leaders, "digest", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("leader")) & F.col("leader").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("leader")).alias("refers_to"), revisit.alias("revisit"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to monolithic archives, normalises those, and reads the records back."""
    folder = shared_dir(pages.sparkSession)
    index = normalise_archives(archive(with_revisits(pages), f"{folder}/monolithic"), f"{folder}/records")
    return read_archives(index)
