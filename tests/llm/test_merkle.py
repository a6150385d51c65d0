import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries

from compare import same

SF = "/root/testdata/sf0.01"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        lo = i // 3 * 3
        out.append((nodes[lo:i], nodes[i + 1 : lo + 3]))
        i //= 3
    return out


def plain(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for k in keys:
        by[k].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {k: grown([leaf(r, r.text) for r in by[k]]) for k in keys}
    top = grown([trees[k][-1][0] for k in keys])
    out = []
    for n, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            steps = path(trees[k], i) + path(top, n)
            even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            at = leaf(r, r.text.replace("\n", "") if even and r.text is not None else r.text)
            for a, b in steps:
                at = h(*a, at, *b)
            root = top[-1][0]
            out.append((str(r.doc_id), leaf(r, r.text), trees[k][-1][0], root, h(*[x for a, b in steps for x in a + b]), at, at == root))
    return sorted(out)


def mine(docs):
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.verify(merkle.manifest(docs, fields=["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": cut}))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())


def test_against_plain(docs):
    assert mine(docs) == plain(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_shapes(spark, n):
    df = spark.createDataFrame([(k, f"a\nb{k}", None, "s" if k % 4 else None, 3) for k in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    assert mine(df) == plain(df.collect())


def test_odd_rows(spark, empty):
    assert merkle.manifest(empty, fields=empty.columns).count() == 0
    rows = [(None, None, None, None, None), (1, "x", "en", "é", 1), (1, "x", "en", "é", 1), (1, "y\n", "en", "é", 1), (2, "", "", "", 0), (-5, "a" * 100_000, "de", "z", 1), (None, "t", None, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert mine(df) == plain(df.collect())
    many = spark.createDataFrame([(k, "t", "en", f"s{k}", 1) for k in range(40)], df.schema)  # a tree for each row
    assert mine(many) == plain(many.collect())


def test_a_leaf_that_was_changed_does_not_fit(spark):
    df = spark.createDataFrame([(k, f"text {k}", "en", "s", 1) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.verify(merkle.manifest(df, tampered={"text": F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))})).collect()
    assert [r.doc_id for r in got if not r.verified] == [7]


def test_twin_and_plan(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.op11_merkle(spark, SF)
    assert same(df, c.sql(queries.ORACLE["op11_merkle"])) == 1000
    assert "Cartesian" not in df._jdf.queryExecution().toString()
