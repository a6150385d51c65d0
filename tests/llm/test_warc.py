import gzip
import hashlib
import io

from compare import same
from tidemark.llm import queries, warc

SCHEMA = "page_id long, url string, html string"


def test_oracle(spark, sf, duck):
    same(queries.op7_warc(spark, sf), duck.sql(queries.ORACLE["op7_warc"]))


def pages_back(spark, data, **kw):
    archives = warc.archive_pages(spark.createDataFrame(data, SCHEMA).repartition(3), **kw)
    return archives, warc.read_archives(archives)


def test_bytes_come_back_in_chunks(spark):
    big = "é\r\n\r\nWARC/1.1\r\n" * 5000
    data = [(1, "http://a", big), (2, None, None), (3, "http://c\r\nX: y", "x" * 999), (4, "u", big), (5, "u", "x" * 999)]
    archives, chunks = pages_back(spark, data, chunk_bytes=4096)
    got = chunks.collect()
    one = sorted((r for r in got if r.record_id == "<urn:x-page:4>"), key=lambda r: r.chunk_no)
    assert b"".join(bytes(r.chunk) for r in one) == big.encode()
    assert one[-1].sha1_so_far == hashlib.sha1(big.encode()).hexdigest() and one[-1].last
    rows = {r.page_id: r for r in warc.page_rows(chunks).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in rows.items()} == {1: ("revisit", 4), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None)}
    assert rows[1].payload_bytes == len(big.encode()) and rows[2].payload_bytes == 0 and all(r.intact for r in rows.values())


def test_archives_are_gzip_members_of_warc_records(spark):
    archives, _ = pages_back(spark, [(1, "http://a", "hello")])
    path = archives.filter("records > 0").first().archive.removeprefix("file://")
    text = gzip.open(path).read().decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("hello\r\n\r\n\r\n\r\n".replace("\r\n\r\n\r\n\r\n", "\r\n\r\n"))
    assert list(warc.records(io.BytesIO(open(path, "rb").read())))[0][2] == b"hello"


def test_nulls_ties_and_repeats(spark):
    same_ = "y" * 2000
    _, chunks = pages_back(spark, [(None, "u", same_), (7, "u", same_), (7, "v", same_), (6, None, same_)])
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.page_rows(chunks).collect()))
    assert got == [(0, "response", 0), (6, "revisit", 7), (7, "response", 0), (7, "response", 0)]


def test_empty(spark):
    archives, chunks = pages_back(spark, [])
    assert archives.count() == 0 and chunks.count() == 0


def test_columns_that_clash_are_not_read(spark):
    from pyspark.sql import functions as F

    extra = ["payload", "size", "sha1", "key", "refers_to", "chunk", "chunk_no", "response_id", "r_key"]
    pages = spark.createDataFrame([(1, "u", "z" * 1500), (2, "u", "z" * 1500)], SCHEMA).select("*", *[F.lit(c).alias(c) for c in extra])
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.page_rows(warc.read_archives(warc.archive_pages(pages))).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None)}


def test_a_large_payload_is_cut_before_it_is_repeated(spark):
    rows = warc.decide(spark.createDataFrame([(1, "u", "x" * 100_000)], SCHEMA))
    chunks = warc.chunk_rows(rows, 1000)
    assert "payload" not in chunks.columns and chunks.count() == 100
    assert sum(len(r.chunk) for r in chunks.collect()) == 100_000
