"""WARC archives written from, and read back into, a chunked record table.

A payload is rows of (record, chunk number, bytes): the writer streams them into gzip members, the reader streams an
archive back as chunk rows whose digest so far is carried along. Neither side ever allocates a whole record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, store_of

CHUNK_BYTES = 1 << 20
READ_BYTES = 1 << 16
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
CHUNKS = "record_id string, chunk_no long, chunk binary, sha1_so_far string, last boolean, record_type string, target_uri string, refers_to_id string, header_digest string, payload_bytes long"


def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Each page with payload, its digests and refers_to: of equal payloads of min_bytes or more the largest page_id is
    the response. Groups are counted before the shuffle, so a payload that many pages share costs a row per task."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "key": F.sha2("payload", 256)})
    first = rows.filter(F.col("size") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1")
    held = rows.join(first.select(F.col("key").alias("r_key"), "response_id"), F.col("key") == F.col("r_key"), "left")
    return held.select("page_id", "url", "payload", "size", "sha1", F.when(F.col("page_id") < F.col("response_id"), F.col("response_id")).alias("refers_to"))


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: a row for each chunk_bytes of a response's payload (at least one), one for a revisit."""
    n = F.when(F.col("refers_to").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes))).cast("int")
    data = lambda k: F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), k * chunk_bytes + 1, F.lit(chunk_bytes)))
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("chunk_no"), data(k).alias("chunk")))  # cut first: no row bears the whole payload
    return records.select("page_id", "url", "size", "sha1", "refers_to", F.inline(made))


def _id(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _head(page: int | None, url: str, size: int, sha1: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    lines = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}", "WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"), f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_archives(chunks: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Streams chunk rows (in order within a partition) into one gzip archive per task, a member per record.

    Gives (archive, records). A task writes under a name of its own and renames at its end, so a task that runs again after a
    lost executor leaves no half archive among the results; only archives named in the result count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = store_of(folder)
        where.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"
        out, z, records = None, None, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "size", "sha1", "refers_to", "chunk_no", "chunk")]
            for i in range(len(batch)):
                page, url, size, sha1, refers_to, chunk_no = (c[i].as_py() for c in cols[:6])
                if chunk_no == 0:
                    if out is None:
                        out = where.open_output_stream(name + ".part")
                    if z is not None:
                        out.write(z.compress(b"\r\n\r\n") + z.flush())
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(z.compress(_head(page, url, size, sha1, refers_to)))
                    records += 1
                if (data := cols[6][i].as_buffer()) is not None:
                    out.write(z.compress(data))
        if out is not None:
            out.write(z.compress(b"\r\n\r\n") + z.flush())
            out.close()
            where.move(name + ".part", name + ".warc.gz")
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name.rsplit('/', 1)[1]}.warc.gz"], "records": pa.array([records], pa.int64())})

    return chunks.mapInArrow(run, "archive string, records long")


class _Members:
    """Bytes of an archive's gzip members, read on demand."""

    def __init__(self, stream):
        self.stream, self.z, self.held, self.raw, self.over = stream, zlib.decompressobj(31), b"", b"", False

    def more(self) -> bool:
        while not self.over:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.raw or self.stream.read(READ_BYTES)
            self.raw = b""
            if not data:
                self.over = True
                return False
            got = self.z.decompress(data, READ_BYTES * 4)
            self.raw = self.z.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("archive ends inside a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def records(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of one archive, with the payload's SHA-1 up to and including each chunk."""
    m = _Members(stream)
    while True:
        while m.held.startswith(b"\r\n") or (not m.held and m.more()):
            m.held = m.held.lstrip(b"\r\n")
        if not m.held or (head := m.until(b"\r\n\r\n")) is None:
            return
        f = _fields(head)
        left = int(f["content-length"])
        http = m.until(b"\r\n\r\n")
        left -= len(http) + 4
        size = int(_fields(http)["content-length"])
        kind, sha, no, part = f["warc-type"], hashlib.sha1(), 0, b""
        base = (kind, f.get("warc-target-uri", ""), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:"), size)
        for piece in m.take(left):
            part += piece
            while len(part) > chunk_bytes:
                sha.update(part[:chunk_bytes])
                yield (f["warc-record-id"], no, part[:chunk_bytes], sha.hexdigest(), False, *base)
                part, no = part[chunk_bytes:], no + 1
        sha.update(part)
        yield (f["warc-record-id"], no, part if kind == "response" else None, sha.hexdigest() if kind == "response" else None, True, *base)


def read_archives(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk rows of the archives named in column `archive`. with_data=False leaves the bytes out once digested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                where, path = store_of(uri)
                out, held = [], 0
                with where.open_input_stream(path, compression=None) as stream:
                    for row in records(stream):
                        if not with_data:
                            row = (*row[:2], None, *row[3:])
                        out.append(row)
                        held += len(row[2] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return archives.mapInArrow(run, CHUNKS)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder; gives (archive, records).

    Null html is an empty payload, null url an empty target. A page without page_id gets the record id `none` and is never
    the response that others name. Rows that repeat a page_id are records of their own; equal payloads under the largest
    page_id are all responses. An empty table writes no archive.
    """
    ws = Workspace(pages.sparkSession, "warc")
    return ws.table(write_archives(chunk_rows(decide(pages, min_bytes), chunk_bytes), ws.path("archives")), "written")


def page_rows(chunks: DataFrame) -> DataFrame:
    """A row per record from the chunk rows: a response's size and digest are those of the bytes read, a revisit's those in its head."""
    number = lambda c: F.regexp_extract(c, r"urn:x-page:(-?\d+)>", 1).try_cast("long")
    last = chunks.filter("last")
    return last.select(
        number("record_id").alias("page_id"), "payload_bytes", F.coalesce("sha1_so_far", "header_digest").alias("payload_digest"), "record_type", number("refers_to_id").alias("refers_to"), (F.coalesce("sha1_so_far", "header_digest") == F.col("header_digest")).alias("intact")
    )
