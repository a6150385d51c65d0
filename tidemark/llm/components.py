"""Connected components by alternating large and small stars (Kiveris et al., 2014), as joins over written tables.

Few edges, of a number that is checked, are solved in one task; the rounds of joins are for all beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

FEW_EDGES = 100_000  # 16 bytes each


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_pydict({"node": nodes, "component": nodes[root]})


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to edges (v, smallest neighbour of u), for the neighbours that `edges` lists under u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.withColumn("m", F.least("m", "u")), "u")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component is the smallest node reached.

    Self-links name a node without joining it to others; repeated edges are one. Rounds grow with the logarithm of the
    largest component; each round is written to the shared folder. A node with very many neighbours is pre-aggregated and its
    join may be split.
    """
    if edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES:  # a check of the size, not a sample
        return ws.table(edges.select("u", "v").repartition(1).mapInArrow(_solve, "node long, component long"), name)
    own = edges.select("u").union(edges.select("v")).distinct()
    now = ws.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    before, k = None, 0
    while (mark := _print(now)) != before:
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = ws.table(large, f"{name}-large-{k}")
        small = _stars(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = ws.table(small, f"{name}-{k + 1}")
        ws.drop(f"{name}-large-{k}", f"{name}-{k}")
        k += 1
    return own.join(now.select("u", F.col("v").alias("root")), "u", "left").select(F.col("u").alias("node"), F.coalesce("root", "u").alias("component"))
