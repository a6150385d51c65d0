"""Hard negatives by norm-bucketed exact search.

Vectors are range-partitioned and sorted by norm, largest first, and read in buckets; anchors are a written table whose files every task streams in
blocks, so neither side passes through the driver. By Cauchy-Schwarz no row of a bucket scores more than the anchor's norm times the
bucket's largest norm: a bucket is skipped for the anchors whose bound falls below the lower limit of all their windows or below the k-th score
that they have already. The search runs in waves over ever more buckets of smaller norm; after each the k-th scores of all anchors are merged and
written, so later waves emit only rows that improve on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, bound_arrow_batches, shards, store_of

BUCKET = 4096  # rows of a bucket
BLOCK = 512  # anchors that meet a bucket at once: 16 MB of scores
WAVE = 16  # each wave takes so many times more parts than all before it
LAST = np.iinfo(np.int64).max
EXACT = float(1 << 36)  # scores below this stay exact as doubles, with a bucket's row number beside them
FOUND = "arow long, slot int, id long, row long, score long"


def usable(vector: Column, label: Column) -> Column:
    """Whether a row takes part: no null and no component that is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(fine, F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as long; beyond a long's range its end."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Rows:
    """Vectors of one length with their ids, rows, labels and norms."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, dim: int):
        col = lambda c: (lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)(batch.column(c))
        self.id = col("id").fill_null(LAST).to_numpy(zero_copy_only=False)
        self.row, self.label = col("row").to_numpy(), col("label").to_numpy()
        self.q = _matrix(col("q"), dim)
        self.norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(1))
        if "low" in batch.schema.names:  # the anchors' windows: least and largest score, and k-th score so far
            self.low, self.high, self.kth = (np.stack(col(c).to_pylist()).astype(np.int64) for c in ("low", "high", "kth"))

    def __len__(self):
        return len(self.id)


def _ranked(score: np.ndarray, c: Rows, keep: np.ndarray, k: int) -> np.ndarray:
    """The first k rows that may be kept, by falling score, then id, then row."""
    at = np.flatnonzero(keep)
    return at[np.lexsort((c.row[at], c.id[at], -score[at]))[:k]]


def _meet(a: Rows, c: Rows, same: bool, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For every anchor and window the first k rows of the bucket between its limits, as (anchor, slot, row, score); few more may come.

    same: rows of the anchor's label but not itself, else rows of other labels. The bucket's rows stand in order of id and row.
    """
    top = c.norm.max(initial=0.0)
    bound = a.norm * top * (1 + 1e-9) + 1
    least = np.maximum(a.low, a.kth)
    some = (a.low <= a.high) & (bound[:, None] >= least)
    for lo in range(0, len(a), BLOCK):
        live = lo + np.flatnonzero(some[lo : lo + BLOCK].any(1))
        if not len(live):
            continue
        if bound[live].max() >= EXACT:  # beyond the doubles: one anchor after the other, as longs
            for i in live.tolist():
                score = c.q @ a.q[i]
                mask = (c.label == a.label[i]) & (c.row != a.row[i]) if same else c.label != a.label[i]
                for slot in np.flatnonzero(some[i]).tolist():
                    at = _ranked(score, c, mask & (score >= least[i, slot]) & (score <= a.high[i, slot]), k)
                    yield np.full(len(at), i), np.full(len(at), slot), at, score[at]
            continue
        s = a.q[live].astype(np.float64) @ c.q.astype(np.float64).T
        match = a.label[live][:, None] == c.label[None, :]
        if same:
            match &= a.row[live][:, None] != c.row[None, :]
        s[~match if same else match] = -np.inf
        last = len(c) - 1
        s *= len(c)
        s += np.arange(last, -1, -1)  # of equal scores the smaller id is the larger number
        for slot in range(a.low.shape[1]):
            use = np.flatnonzero(some[live, slot])
            if not len(use):
                continue
            t = s[use] if len(use) < len(live) else s
            up, down = a.high[live[use], slot], least[live[use], slot]
            hit = (t >= np.maximum(down, -EXACT)[:, None] * float(len(c))) & (t <= np.minimum(up, EXACT)[:, None] * float(len(c)) + last)
            many = np.flatnonzero(hit.sum(1) > k)
            if len(many):  # keep the k largest
                u = np.where(hit[many], t[many], -np.inf)
                edge = np.partition(u, -k, 1)[:, -k]
                hit[many] = u >= edge[:, None]
            i, j = np.nonzero(hit)
            yield live[use[i]], np.full(len(i), slot), j, np.floor(t[i, j] / len(c)).astype(np.int64)


def _blocks(files: list[str], dim: int, rows: int = 8192) -> Iterator[Rows]:
    """The anchors, in blocks, read from the shared folder."""
    for uri in files:
        store, path = store_of(uri)
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(rows):
                if len(batch):
                    yield Rows(batch, dim)


def _search(files: list[str], dim: int, same: bool, k: int):
    """A task: buckets of falling norm, gathered to some 32 MB, against every block of anchors."""
    most = max(BUCKET, (32 << 20) // (8 * dim))

    def found(a: Rows, buckets: list[Rows]) -> pa.RecordBatch | None:
        parts, n = [], 0
        for c in buckets:
            for i, slot, j, score in _meet(a, c, same, k):
                parts.append((i, slot, c.id[j], c.row[j], score))
                n += len(i)
            if n > 2 * k * a.low.size or c is buckets[-1]:
                if not n:
                    continue
                i, slot, ident, row, score = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((row, ident, -score, slot, i))
                key = (i * a.low.shape[1] + slot)[order]
                start = np.flatnonzero(np.diff(key, prepend=-1))
                nth = np.arange(len(key)) - np.repeat(start, np.diff(start, append=len(key)))
                order = order[nth < k]
                full = np.flatnonzero(nth == k - 1)
                np.maximum.at(a.kth, (key[full] // a.low.shape[1], key[full] % a.low.shape[1]), score[order[np.flatnonzero(nth[nth < k] == k - 1)]])
                parts = [(i[order], slot[order], ident[order], row[order], score[order])]
                n = len(order)
        if not n:
            return None
        i, slot, ident, row, score = parts[0]
        return pa.RecordBatch.from_arrays([pa.array(a.row[i]), pa.array(slot.astype(np.int32)), pa.array(ident, pa.int64(), mask=ident == LAST), pa.array(row), pa.array(score)], names=["arow", "slot", "id", "row", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []

        def flush():
            held.sort(key=lambda c: -c.norm.max())
            for a in _blocks(files, dim):
                out = found(a, held)
                if out is not None:
                    yield out
            held.clear()

        for batch in batches:
            for lo in range(0, len(batch), BUCKET):
                piece = batch.slice(lo, BUCKET)
                piece = piece.take(pc.sort_indices(piece, [("id", "ascending"), ("row", "ascending")]))
                held.append(Rows(piece, dim))
            if sum(map(len, held)) >= most:
                yield from flush()
        if held:
            yield from flush()

    return run


def _files(df: DataFrame) -> list[str]:
    return sorted(df.inputFiles())


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("arow", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _waves(ws: Workspace, name: str, vectors: DataFrame, anchors: DataFrame, parts: int, dim: int, same: bool, k: int) -> DataFrame:
    """The first k rows of every anchor and window, (arow, slot, id, row, score, rank). anchors: with arrays low and high."""
    none = F.lit(-(2**62)).cast("long")
    files = max(1, anchors.count() * dim * 8 >> 25)
    asked = anchors.withColumn("kth", F.transform("low", lambda x: none))
    have, lo, hi, n = None, 0, 1, 0
    while lo < parts:
        asked = ws.table(asked.coalesce(files), f"{name}-anchors{n}")
        new = vectors.filter((F.col("part") >= lo) & (F.col("part") < hi)).select("id", "row", "label", "q").mapInArrow(_search(_files(asked), dim, same, k), FOUND)
        have = ws.table(_best(new if have is None else have.drop("rank").unionByName(new), k), f"{name}-found{n}")
        lo, hi, n = hi, hi * WAVE + 1, n + 1
        if lo < parts:
            full = have.filter(F.col("rank") == k).groupBy("arow").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("have"))
            kth = F.transform("low", lambda x, i: F.coalesce(F.try_element_at("have", i), none))
            asked = anchors.join(full, anchors["row"] == full["arow"], "left").withColumn("kth", kth).drop("have", "arow")
    return have


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label, q).

    q: whole components; a score is an inner product. The anchors' positives are their first other rows of the same label; to each belong the first
    rows of another label that score low to high percent of it. Higher scores first, ties by id (null last), then by place in the
    table: rows that repeat an id are rows of their own. Vectors of different lengths do not meet; those without components take no part. Scores are
    exact as long as they fit a long. An anchor that finds nothing has no row; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    bound_arrow_batches(spark)
    ws = Workspace(spark, "hard-negatives")
    size = F.size("q")
    taken = rows.select("id", F.col("label").cast("long").alias("label"), "q", is_anchor.alias("asks"), F.monotonically_increasing_id().alias("row")).filter(size > 0)
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    parts = shards(spark)
    placed = taken.withColumn("norm", norm).repartitionByRange(parts, F.desc("norm"), "id", "row").sortWithinPartitions(F.desc("norm"), "id", "row")
    vectors = ws.table(placed.withColumn("part", F.spark_partition_id()), "vectors")
    parts = (vectors.agg(F.max("part")).first()[0] or 0) + 1
    out = None
    for dim in [r[0] for r in vectors.select(size).distinct().sort(size).collect()]:  # lengths, not rows
        own = vectors.filter(size == dim)
        anchors = own.filter("asks").select("id", "row", "label", "q")
        edge = lambda x: F.array(F.lit(x).cast("long"))
        first = _waves(ws, f"positives-{dim}", own, anchors.withColumns({"low": edge(-(2**62)), "high": edge(2**62)}), parts, dim, True, positives)
        pairs = first.select("arow", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        pairs = ws.table(pairs, f"pairs-{dim}")
        ends = pairs.groupBy("arow").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))  # `positives` entries at most
        inner = lambda f: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(f(F.get("p", i)["positive_score"]), F.lit(0).cast("long")))
        floor = lambda x, n: F.floor(x.cast("decimal(38,0)") * n / 100).cast("long")
        windows = anchors.join(ends, anchors["row"] == ends["arow"]).withColumns({"low": inner(lambda x: -floor(-x, low)), "high": inner(lambda x: floor(x, high))})
        unused = F.transform("high", lambda x, i: F.when(i < F.size("p"), x).otherwise(F.lit(-(2**62)).cast("long")))
        windows = windows.withColumn("high", unused).select("id", "row", "label", "q", "low", "high")
        hard = _waves(ws, f"negatives-{dim}", own, ws.table(windows, f"windows-{dim}"), parts, dim, False, negatives)
        got = hard.join(pairs, ["arow", "slot"]).join(anchors.select(F.col("row").alias("arow"), F.col("id").alias("anchor_id")), "arow")
        got = got.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
