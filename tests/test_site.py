"""Stop rules of the paged listing, offsets of the queue."""

import json


from tidemark.sources import site
from tidemark.streaming import pipelines


def listing(spark, root, queries, **options):
    site.register(spark)
    df = spark.read.format("paged_listing").options(path=root, queries=json.dumps(queries), **options).load()
    return sorted((r.query, r.page, r.rank, r.url) for r in df.collect())


def test_stop_rules(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    a = lambda *urls: "\n".join(f"<A class=x HREF='{u}'>t</A>" for u in urls)
    pages = [("full", k, a(f"u{k}", f"v{k}", f"u{k}")) for k in range(1, 13)]  # the limit
    pages += [("gap", 1, a("g1")), ("gap", 3, a("g3"))]  # a page that cannot be had
    pages += [("dry", 1, a("d1")), ("dry", 2, "<p>none</p>"), ("dry", 3, a("d3"))]  # a page without links
    pages += [("none", 1, a("n1") + "no results found"), ("a b/c: d", 1, a("odd"))]
    spark.createDataFrame(pages, "query string, page int, html string").write.partitionBy("query", "page").text(root)
    got = listing(spark, root, ["full", "gap", "dry", "none", "a b/c: d", "unknown", "gap"], noResults="no results")
    want = [("full", k, r, f"{c}{k}") for k in range(1, 11) for r, c in ((1, "u"), (2, "v"))] + [("gap", 1, 1, "g1"), ("dry", 1, 1, "d1"), ("a b/c: d", 1, 1, "odd")]
    assert got == sorted(want)
    assert len(listing(spark, root, ["full"], maxPages=3)) == 6
    assert listing(spark, root, []) == []
    parts = site.ListingReader({"path": root, "queries": '["x", "y", "x"]'}).partitions()
    assert [p.query for p in parts] == ["x", "y"]


def test_a_restart_reads_nothing_twice(spark, tmp_path):
    root, out, state = (f"file://{tmp_path}/{x}" for x in ("queue", "out", "state"))
    site.register(spark)

    def publish(rows):
        spark.createDataFrame(rows, "segment int, body string").write.mode("append").partitionBy("segment").text(root)

    def consume():
        stream = spark.readStream.format("message_queue").option("path", root).load()
        return sorted((r.segment, r.body) for r in pipelines.run(stream, "append", out, state).collect())

    publish([(0, "a"), (0, "b"), (2, "c")])
    assert consume() == [(0, "a"), (0, "b"), (2, "c")]
    assert consume() == [(0, "a"), (0, "b"), (2, "c")]  # nothing new
    publish([(3, "d"), (5, "e")])
    assert consume() == [(0, "a"), (0, "b"), (2, "c"), (3, "d"), (5, "e")]


def test_an_empty_queue(tmp_path):
    assert site.QueueReader({"path": f"file://{tmp_path}/nothing"}).latestOffset() == {"next": 0}
