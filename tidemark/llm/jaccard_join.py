"""Near duplicates by an exact Jaccard join of word shingles: the grouped prefix join.

Shingles are ordered from rare to frequent by a sketch of fixed size. Documents whose sets have one size and one prefix form a group,
which is posted once under each token of its prefix. Group pairs are filtered by size and by the token's places in both
prefixes, expanded to their distinct sets, filtered by a bound on the intersection from a bit signature of each set, and verified by exact
intersection.

Pairs inside a cluster are not listed. In each merging round the members of a token's posting list meet two leaders from different
components, each member's best pairs are verified, and links join components. Once a round finds few links, all pairs that are left are verified: those in different components with a token that
can be the first they have in common. So no link between components is lost.

A token that very many groups post (more than PIECE by the sketch) is hot: its list is dealt over several shards, and only its leaders meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .numtext import column, grams, mix, slices, words
from .workspace import Workspace, bound_arrow_batches, dealt, flagged, shards

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 25
BLOCK_BITS = 16
GATHER_BYTES = 4 << 20
SLICE = 2 << 20
BROADCAST_IDS = 50_000  # two longs each
PIECE = 1 << 16
PARTNERS = 2
MERGE_WHILE = 0.1  # links found per node left
SIGNATURE = 1024  # bits
_SIZE = np.uint64((1 << 20) - 1)
FAR = 65535


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of consecutive texts one after the other, and for each text the number of its first. A text with fewer words is one
    shingle; one without words has none."""
    h, _, _, first = words(buf, offsets, lower=True)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(start[-1]), np.uint64)
    g = grams(h, size)
    at = np.arange(len(out)) + np.repeat(first[:-1] - start[:-1], count)
    long = np.repeat(n >= size, count)
    out[long] = g[at[long]]
    for k in np.flatnonzero((n > 0) & (n < size)):
        out[start[k]] = grams(h[first[k] : first[k + 1]], int(n[k]))[0]
    return out, start


def narrow(a: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of 64-bit numbers."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def widen(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view("<u8").reshape(-1)


def sketch(docs: DataFrame) -> np.ndarray:
    """About how often shingles occur, in 2**SKETCH_BITS cells of one byte (eighths of a power of two): a table of fixed size.
    It only orders tokens; cells that several shingles share cost time, not results."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.uint8)  # a task's counts up to 255
        for _, buf, offsets in slices(batches, "text", SLICE):
            cell, n = np.unique(shingle_hashes(buf, offsets)[0] >> np.uint64(64 - SKETCH_BITS), return_counts=True)
            table[cell] = np.minimum(table[cell] + n, 255)
        number, data = [], []
        for k, part in enumerate(table.reshape(-1, 1 << BLOCK_BITS)):
            at = np.flatnonzero(part)
            if len(at):
                sparse = len(at) < (1 << BLOCK_BITS) // 8
                body = at.astype("<u2").tobytes() + part[at].tobytes() if sparse else part.tobytes()
                number.append(k)
                data.append((b"s" if sparse else b"d") + zlib.compress(body, 1))
        if number:
            yield pa.RecordBatch.from_pydict({"block": pa.array(number, pa.int32()), "cells": pa.array(data, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for data in table.column("cells").to_pylist():
            body = zlib.decompress(data[1:])
            if data[:1] == b"d":
                total += np.frombuffer(body, "<u1")
            else:
                n = len(body) // 3
                total[np.frombuffer(body, "<u2", n)] += np.frombuffer(body, "<u1", n, 2 * n)
        level = np.minimum(255, 8 * np.log2(1 + total)).astype("<u1")
        return pa.table({"block": table.column("block").slice(0, 1), "cells": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for r in docs.mapInArrow(count, "block int, cells binary").groupBy("block").applyInArrow(add, "block int, cells binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["cells"], np.uint8)
    return out.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def distinct_postings(t: np.ndarray, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings in order of token and group, each once, with the first place (groups of one number can differ in it)."""
    order = np.lexsort((at, g, t))
    t, g, at = t[order], g[order], at[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    return t[first], g[first], at[first]


INDEX = "kind int, shard int, a binary, b binary, c binary"


def index(docs: DataFrame, held, n_shards: int, percent: int) -> DataFrame:
    """Rows of kind 0: ids (a), groups (b), and set keys, sizes and signatures (c) of documents; of kind 1: tokens (a), groups (b) and places in the group's order
    (c, 16 bits, larger ones saturate) of postings, by shard; of kind 2: the same of hot tokens, a token's groups dealt over shards.

    A group is its set size (20 bits, larger ones saturate) and 28 bits of its prefix's hash; groups that collide are verified like others.
    """

    top = np.uint64((1 << 48) - 1)
    mild = int(8 * np.log2(PIECE))

    def postings(kind: int, t: np.ndarray, g: np.ndarray, at: np.ndarray, shard: np.ndarray) -> list[tuple]:
        order = np.argsort(shard, kind="stable")
        t, g, at = t[order], g[order], at[order]
        edge = np.searchsorted(shard[order], np.arange(n_shards + 1))
        return [(kind, k, narrow(t[edge[k] : edge[k + 1]], 6), narrow(g[edge[k] : edge[k + 1]], 6), at[edge[k] : edge[k + 1]].tobytes()) for k in range(n_shards) if edge[k] < edge[k + 1]]

    def rows(meta: list[tuple], tok: list[np.ndarray], grp: list[np.ndarray], place: list[np.ndarray]) -> pa.RecordBatch:
        ids, group, key = (np.concatenate(x) for x in zip(*meta, strict=True))
        out = [(0, -1, ids.tobytes(), narrow(group, 6), key.tobytes())]
        if tok:
            t, g, at = distinct_postings(np.concatenate(tok), np.concatenate(grp), np.concatenate(place))
            level, t = (t >> np.uint64(56)).astype(np.int64), t & top
            shard = ((t >> np.uint64(16)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
            hot = level > mild
            out += postings(1, t[~hot], g[~hot], at[~hot], shard[~hot])
            if hot.any():
                pieces = np.uint64(1) << (1 + (level[hot] - mild) // 8).astype(np.uint64)
                out += postings(2, t[hot], g[hot], at[hot], (shard[hot] + (mix(g[hot]) & (pieces - np.uint64(1))).astype(np.int64)) % n_shards)
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["kind", "shard", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        meta, tok, grp, place, size = [], [], [], [], 0
        for batch, buf, offsets in slices(batches, "text", SLICE):
            h, start = shingle_hashes(buf, offsets)
            # Rare shingles first: the frequency level, then the hash.
            h = (order[h >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56)) | (mix(h) >> np.uint64(8))
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype("<i8")
            group, key = np.zeros(len(batch), np.uint64), np.zeros((len(batch), 3 + SIGNATURE // 64), "<u8")
            for k in range(len(batch)):
                s = np.unique(h[start[k] : start[k + 1]])
                n = len(s)
                if not n:
                    continue
                p = s[: prefix_length(n, percent)]
                mixed = mix(s)
                key[k, :3] = mixed.sum(), mix(mixed ^ np.uint64(n)).sum(), np.uint64(n)
                key[k, 3:] = np.packbits((np.bincount((mixed >> np.uint64(54)).astype(np.int64), minlength=SIGNATURE) & 1).astype(np.uint8)).view("<u8")
                group[k] = (min(np.uint64(n), _SIZE) << np.uint64(28)) | (mix(mix(p).sum() + p[-1:])[0] >> np.uint64(36))
                tok.append(p)
                grp.append(np.full(len(p), group[k]))
                place.append(np.minimum(np.arange(len(p)), FAR).astype("<u2"))
            meta.append((ids, group, key))
            size += int(offsets[-1] - offsets[0])
            if size >= GATHER_BYTES:
                yield rows(meta, tok, grp, place)
                meta, tok, grp, place, size = [], [], [], [], 0
        if meta:
            yield rows(meta, tok, grp, place)

    return docs.mapInArrow(run, INDEX)


def documents_of(rows: DataFrame) -> DataFrame:
    """(id, g, k1, k2, n, sig) of the kind 0 rows; g 0 stands for an empty set, n is the true size, sig the signature: a bit says whether an odd
    number of the set's shingles fall on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in "abc"), strict=True):
                g, key = widen(b, 6), np.frombuffer(c, "<i8").reshape(-1, 3 + SIGNATURE // 64)
                sig = pa.array([r.tobytes() for r in np.ascontiguousarray(key[:, 3:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, "<i8")), pa.array(g.astype(np.int64)), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(key[:, 2]), sig], names=["id", "g", "k1", "k2", "n", "sig"])

    return rows.filter("kind = 0").mapInArrow(run, "id long, g long, k1 long, k2 long, n long, sig binary")


def shared_postings(rows: DataFrame) -> DataFrame:
    """(t, p, g, at) for every token that several groups post; p is 0, or for hot tokens the number of the shard that holds this piece of
    the token's list, and one."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        kinds = table.column("kind").to_pylist()
        for kind in set(kinds):
            own = table.filter(pa.array([k == kind for k in kinds]))
            t, g, at = (np.concatenate([f(x) for x in own.column(c).to_pylist()]) for c, f in (("a", lambda x: widen(x, 6)), ("b", lambda x: widen(x, 6)), ("c", lambda x: np.frombuffer(x, "<u2"))))
            t, g, at = distinct_postings(t, g, at)
            if kind == 1:
                start = np.ones(len(t), bool)
                start[1:] = t[1:] != t[:-1]
                several = ~(start & np.append(start[1:], True))
                t, g, at = t[several], g[several], at[several]
            out.append((t.astype(np.int64), np.full(len(t), 0 if kind == 1 else own.column("shard")[0].as_py() + 1, np.int32), g.astype(np.int64), at.astype(np.int32)))
        return pa.table(dict(zip(("t", "p", "g", "at"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return dealt(rows.filter("kind > 0").select("kind", "shard", "a", "b", "c")).applyInArrow(run, "t long, p int, g long, at int")


def named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ids."""
    return flagged(rows, "id", ids, "id").filter("__maybe").drop("__maybe").join(ids, "id", "left_semi")


def ids_of(pairs: DataFrame, ws: Workspace, name: str) -> DataFrame:
    return ws.table(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), name)


def promising(pairs: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """The pairs that their signatures allow. Two sets differ in at least as many shingles as their signatures differ in bits; that bounds what they
    can have in common, and a pair below the bound does not link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(-1, SIGNATURE // 64) for c in ("su", "sv")]
            both = batch.column("nu").to_numpy() + batch.column("nv").to_numpy()
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum(1).astype(np.int64)
            yield batch.select(["u", "v", "cu", "cv"]).take(pa.array(np.flatnonzero((both - differ) * (100 + percent) >= 2 * percent * both)))

    side = lambda x: meta.filter("g <> 0").select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "cu", "cv", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long, cu long, cv long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, meta: DataFrame, ws: Workspace, name: str, percent: int) -> DataFrame:
    """The pairs (u, v, cu, cv) of nodes whose sets are similar enough; written. Texts of the documents that pairs name move to their pairs, and sets
    are made there: a text takes less room than the hashes of its shingles, which do not compress."""
    pairs = ws.table(pairs, f"{name}-pairs")
    signed = ws.table(named(meta.select("id", "g", "n", "sig"), ids_of(pairs, ws, f"{name}-ids")), f"{name}-signed")
    pairs = ws.table(promising(pairs, signed, percent), f"{name}-left")
    texts = ws.table(named(docs, ids_of(pairs, ws, f"{name}-ids")), f"{name}-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, at), (b, bt) = (shingle_hashes(*column(batch, c)) for c in ("ta", "tb"))
            keep = np.zeros(len(batch), bool)
            for k in range(len(batch)):
                mine, other = np.unique(a[at[k] : at[k + 1]]), np.unique(b[bt[k] : bt[k + 1]])
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep[k] = 100 * both >= percent * (len(mine) + len(other) - both)
            yield batch.select(["u", "v", "cu", "cv"]).take(pa.array(np.flatnonzero(keep)))

    both = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("ta")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("tb")), "v")
    out = ws.table(both.select("u", "v", "cu", "cv", "ta", "tb").mapInArrow(run, "u long, v long, cu long, cv long"), name)
    ws.drop(f"{name}-texts", f"{name}-left", f"{name}-signed", f"{name}-ids")
    return out


def small(df: DataFrame) -> DataFrame:
    """A table for a join: broadcast if it has few rows, beyond that both sides are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def moved(df: DataFrame, into: DataFrame) -> DataFrame:
    """With the components that links have made of those in column comp."""
    return df.join(into, "comp", "left").withColumn("comp", F.coalesce("into", "comp")).drop("into")


def may_link(a: str, b: str, percent: int) -> F.Column:
    """Whether two postings (n, at) of one token can lie in sets that link: the sizes allow it, and with the overlap that a link needs, the
    token stands in both prefixes. A link's first common token always does."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil((n + m) * percent / (100 + percent))
    place = (F.col(f"{a}.at") <= n - need) & (F.col(f"{b}.at") <= m - need)
    return ((F.least(n, m) * 100 >= F.greatest(n, m) * percent) & place) | (F.greatest(n, m) == int(_SIZE))


def meeting(left: DataFrame, turn: int, hot: bool) -> DataFrame:
    """Postings of tokens in several components, with three leaders of the token: of its first component, which is often the largest, the first
    node and one that changes with each turn; and a node of another component, which changes too."""
    hashed = F.xxhash64("node", F.lit(turn))
    mark = lambda *first: F.struct(*first, "comp", "node", "n", "at")
    lists = left.groupBy("t", "p").agg(
        F.min(mark(F.col("comp").alias("x"), F.col("node").alias("y"))).alias("a"), F.min(mark(F.col("comp").alias("x"), hashed.alias("y"))).alias("b"),
        F.max(mark(F.xxhash64("comp", F.lit(turn)).alias("x"), hashed.alias("y"))).alias("c"), F.max("comp").alias("last"),
    )
    leaders = lambda lists, *key: lists.filter("a.comp <> last").select(*key, F.array_distinct(F.transform(F.array("a", "b", "c"), lambda m: F.struct(m.comp.alias("comp"), m.node.alias("node"), m.n.alias("n"), m["at"].alias("at")))).alias("leads"))
    if not hot:
        return left.join(leaders(lists, "t", "p"), ["t", "p"])
    whole = lists.filter("p > 0").groupBy("t").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("c").alias("c"), F.max("last").alias("last"))
    out = left.filter("p = 0").join(leaders(lists.filter("p = 0"), "t", "p"), ["t", "p"])
    return out.unionByName(left.filter("p > 0").join(leaders(whole, "t"), "t"))


def best_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Up to PARTNERS pairs (u, v, cu, cv) for each node: those with the most tokens in common among the leaders it meets."""
    pair = met.select(F.struct("node", "comp", "n", "at").alias("p"), F.explode("leads").alias("l")).filter((F.col("p.comp") != F.col("l.comp")) & may_link("p", "l", percent))
    counted = pair.groupBy(F.col("p.node").alias("u"), F.col("l.node").alias("v"), F.col("p.comp").alias("cu"), F.col("l.comp").alias("cv")).agg(F.count("*").alias("c"))
    return counted.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("c"), "v"))).filter(F.col("k") <= PARTNERS).select("u", "v", "cu", "cv")


def set_sizes(docs: DataFrame) -> DataFrame:
    """(n): the number of different shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offsets in slices(batches, "text", SLICE):
            h, start = shingle_hashes(buf, offsets)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(np.unique(h[a:b])) for a, b in zip(start[:-1], start[1:], strict=True)], pa.int64())})

    return docs.select("text").mapInArrow(run, "n long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) per document: link when 100 * intersection >= percent * union of their shingle sets.

    component_id is the smallest id reachable by links, itself included. Without words or text the set is empty and the document
    its own component. Rows without an id give (null, size, null) and link nothing. Rows that repeat an id are one node: each gives a
    row, and a link of one is a link of all. Only id and text are read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    nameless = rows.filter("id is null")
    rows = rows.filter("id is not null")
    bound_arrow_batches(spark)
    held = spark.sparkContext.broadcast(sketch(rows.select("text")))  # 2**SKETCH_BITS bytes
    ws.table(index(rows, held, shards(spark), percent), "index", "kind")
    held.destroy()
    posted = spark.read.schema(INDEX).parquet(ws.path("index"))
    meta = ws.table(documents_of(posted), "documents")

    # Equal sets are one node, named by the smallest id; groups hold the nodes of one size and prefix.
    sets = ws.table(meta.filter("g <> 0").groupBy("g", "k1", "k2").agg(F.min("id").alias("node")), "nodes")
    nodes = sets.select("g", "node")
    heads = nodes.groupBy("g").agg(F.min("node").alias("head"), F.count("*").alias("m"))

    left = shared_postings(posted).join(nodes, "g").select("t", "p", F.shiftright("g", 28).alias("n"), "at", "node", F.col("node").alias("comp"))
    n = shards(spark)
    left = ws.bucketed(left.repartition(n, "t", "p"), "postings", ["t", "p"], n)
    ws.drop("index")
    hot = not left.filter("p > 0").isEmpty()
    twins = ws.table(nodes.join(heads.filter("m > 1"), "g"), "twins")
    links = verified(twins.filter("head <> node").select(F.col("head").alias("u"), F.col("node").alias("v"), F.col("head").alias("cu"), F.col("node").alias("cv")), rows, meta, ws, "links-0", percent)
    known = nodes.select("node", F.col("node").alias("comp")).distinct()
    turn, found, rounds = 0, links.count(), [0]
    while True:
        if found:
            into = small(components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")), ws, f"graph-{turn}").select(F.col("node").alias("comp"), F.col("component").alias("into")))
            known, left = ws.table(moved(known, into), f"known-{turn}"), moved(left, into)
        turn += 1
        met = meeting(left, turn, hot)
        met = ws.bucketed(met.repartition(n, "t", "p") if hot else met, f"met-{turn}", ["t", "p"], n)
        ws.drop(f"links-{turn - 1}", f"met-{turn - 1}", f"graph-{turn - 1}", "postings")
        left = met.drop("leads")
        if turn > 1 and found < MERGE_WHILE * left.agg(F.approx_count_distinct("node")).first()[0]:
            break
        links = verified(best_pairs(met, percent), rows, meta, ws, f"links-{turn}", percent)
        rounds.append(turn)
        found = links.count()
        if not found:
            break

    # What is left: every pair of nodes in different components with a token that can be the first they have in common.
    a, b = left.alias("a"), left.alias("b")
    order = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node")))
    names = [F.col(f"{s}.{c}").alias(x) for c, x in (("node", ""), ("comp", "c")) for s, x in (("a", x + "u"), ("b", x + "v"))]
    apart = (F.col("a.comp") != F.col("b.comp")) & order & may_link("a", "b", percent)
    last = a.filter("p = 0").join(b.filter("p = 0"), (F.col("a.t") == F.col("b.t")) & (F.col("a.p") == F.col("b.p")) & apart).select(names)
    if hot:
        last = last.union(a.filter("p > 0").join(b.filter("p > 0"), (F.col("a.t") == F.col("b.t")) & apart).select(names))
    twins = twins.select("g", "node").join(known, "node")
    last = last.union(twins.alias("a").join(twins.alias("b"), "g").filter("a.node < b.node and a.comp <> b.comp").select(names)).distinct()
    tested = spark.read.parquet(*[ws.path(f"links-{k}-pairs") for k in rounds]).select("u", "v")
    links = verified(last.join(tested, ["u", "v"], "left_anti"), rows, meta, ws, "links-last", percent)
    known = moved(known, small(components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")), ws, "graph-last").select(F.col("node").alias("comp"), F.col("component").alias("into"))))
    known = ws.table(known, "known")
    ws.drop("links-last", f"met-{turn}", f"links-{turn}", "twins", "graph-last", "links-last-pairs", *(f"{x}-{k}" for k in rounds for x in ("known", "graph")), *(f"links-{k}-pairs" for k in rounds))
    labelled = meta.join(sets, ["g", "k1", "k2"], "left").join(known, "node", "left").select("id", "n", F.coalesce("comp", "id").alias("comp"))
    labelled = ws.table(labelled, "labelled")
    ws.drop("documents", "nodes", "known")
    again = labelled.groupBy("id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).filter("m > 1")
    if not again.isEmpty():
        joined = components(again.filter("lo < hi").select(F.col("lo").alias("u"), F.col("hi").alias("v")), ws, "again").select(F.col("node").alias("comp"), F.col("component").alias("joined"))
        labelled = labelled.join(joined, "comp", "left").withColumn("comp", F.coalesce("joined", "comp"))
    out = labelled.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("comp").alias("component_id"))
    if nameless.isEmpty():
        return out
    none = F.lit(None).cast("long")
    return out.unionByName(set_sizes(nameless).select(none.alias(id_col), F.col("n").alias("n_shingles"), none.alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents, with all columns, that are the smallest id of their component; rows without id stay."""
    gone = near_duplicates(docs, id_col, text_col, percent).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct()
    gone = Workspace(docs.sparkSession, "keep-one").table(gone, "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"))  # names of any kind stay inside the row
    parted = flagged(rows, "own_id", gone, "gone")
    return parted.filter("not __maybe").select("row.*").unionByName(parted.filter("__maybe").join(gone, F.col("own_id") == F.col("gone"), "left_anti").select("row.*"))
