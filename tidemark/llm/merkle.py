"""A Merkle manifest of a dataset: a ternary hash tree over the rows of each source, and one over the sources' roots.

Built bottom up: every level is a written table of nodes with their children, and the next one groups each three of them. Proofs are pushed top
down: a level's nodes receive the proof suffix of the level above (a join by tree and position), and every child prepends its siblings to it.
A leaf's proof keeps the siblings on either side apart, so folding it needs no positions.

All of it is DataFrame operations. Positions in a tree come from range partitions and their sizes, so a source that holds most rows is
spread over as many tasks as any other. A level that is small takes few tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, join_groups, shards

FANOUT = 3
NODES_PER_TASK = 200_000  # a node with its children takes some 150 bytes


def sha(*parts: Column) -> Column:
    """Binary digest of concatenated texts."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def written(value: Column) -> Column:
    """A value as a leaf holds it: '-' if null, else the number of its UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _positions(ws: Workspace, rows: DataFrame, name: str, by: list[Column], tasks: int) -> DataFrame:
    """Rows with their position (from 0) in the order of `by`, which is total but for rows that are alike: range partitions, counted one by one."""
    tie = "__tie"
    parted = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(tasks, *by, F.col(tie)).withColumn("__part", F.spark_partition_id())
    parted = ws.table(parted, name)
    counts = parted.groupBy("__part").count()  # a row for each task
    before = counts.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    inside = parted.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*by, tie)) - 1)
    return inside.join(F.broadcast(before), "__part").withColumn("pos", F.col("__before") + F.col("__in")).drop("__part", tie, "__in", "__before")


def _grown(ws: Workspace, name: str, leaves: DataFrame, most: int, total: int) -> tuple[DataFrame, int]:
    """All levels above the leaves (tree, pos, size, node), as a table of (level, tree, pos, size, node, kids); the number of levels.

    size: how many nodes the tree has on that level. A tree of one node is complete and goes no further.
    """
    spark, below, level = ws.spark, leaves, 0
    while most > 1:
        up = (
            below.filter("size > 1")
            .groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), "node"))).alias("kids"), F.first("size").alias("size"))
            .select("tree", "pos", F.ceil(F.col("size") / FANOUT).cast("long").alias("size"), F.expr("transform(kids, k -> k.node)").alias("kids"))
            .withColumn("node", sha(F.array_join(F.expr("transform(kids, k -> lower(hex(k)))"), "")))
        )
        level, most, total = level + 1, -(-most // FANOUT), -(-total // FANOUT)
        below = ws.table(up.coalesce(_tasks(total)), f"{name}/level={level}")
    if not level:
        return spark.createDataFrame([], "tree long, pos long, size long, kids array<binary>, node binary, level int"), 0
    return spark.read.schema("tree long, pos long, size long, kids array<binary>, node binary, level int").parquet(ws.path(name)), level


def _tasks(nodes: int) -> int:
    return max(1, -(-nodes // NODES_PER_TASK))


#: A step of a proof: the siblings' digests before and after the path's node, as hex text without a gap.
STEP = "struct<left:binary,right:binary>"


def _pushed(ws: Workspace, name: str, levels: DataFrame, top: int, tops: DataFrame, total: int) -> DataFrame:
    """(tree, pos, proof) of all nodes of level 0 that have a parent. tops: (tree, proof): what follows after a tree's own root."""
    given = None
    for level in range(top, 0, -1):
        nodes = levels.filter(F.col("level") == level).select("tree", "pos", "size", "kids")
        heads = nodes.filter("size = 1").join(tops, "tree").select("tree", "pos", "kids", "proof")
        if given is not None:
            heads = heads.unionByName(nodes.filter("size > 1").join(given, ["tree", "pos"]).select("tree", "pos", "kids", "proof"))
        kids = heads.select("tree", F.col("pos").alias("parent"), "kids", "proof", F.explode(F.sequence(F.lit(0), F.size("kids") - 1)).alias("k"))
        none = F.lit(b"")
        left = [F.when(F.col("k") > i, F.get("kids", F.lit(i))).otherwise(none) for i in range(FANOUT - 1)]
        right = [F.when((F.col("k") < i) & (F.size("kids") > i), F.get("kids", F.lit(i))).otherwise(none) for i in range(1, FANOUT)]
        step = F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))
        down = kids.select("tree", (F.col("parent") * FANOUT + F.col("k")).alias("pos"), F.concat(F.array(step), "proof").alias("proof"))
        if level == 1:
            return down
        given = ws.table(down.coalesce(_tasks(4 * -(-total // FANOUT ** (level - 1)))), f"{name}/level={level - 1}")  # proofs take more than nodes
    return ws.spark.createDataFrame([], f"tree long, pos long, proof array<{STEP}>")


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: list[str] | None = None, tampered: dict[str, Column] | None = None) -> DataFrame:
    """A row for each input row: id_col, leaf, subroot, root, proof (steps of siblings to the left and right), tampered_leaf.

    fields: the columns that a leaf covers, in order (all if None). Leaves of a group ascend by id (null first; rows that repeat an id by leaf), each three
    consecutive nodes (the last run: fewer, even one) become their digest until one is left; groups ascend by value (null first, bytewise), their
    roots make the last tree alike. tampered_leaf: the leaf with the columns of `tampered` in place of their own (`verify` tells whether it still
    fits). An empty table gives an empty result. Columns beside those named are not read.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "merkle")
    fields = fields or rows.columns
    quoted = {c: F.col(f"`{c}`") for c in fields}
    leaf = sha(*[written(c) for c in quoted.values()])
    other = sha(*[written((tampered or {}).get(c, v)) for c, v in quoted.items()]) if tampered else leaf
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    taken = rows.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), leaf.alias("node"), F.nullif(other, leaf).alias("other"))
    taken = ws.table(taken, "hashed")  # the texts are read once; placing by range reads its rows twice
    rows_of = _positions(ws, taken, "leaves", [F.col("key"), F.col("id"), F.col("node")], shards(spark))
    placed = ws.table(rows_of, "placed")
    trees = ws.table(placed.groupBy("key").agg(F.min("pos").alias("start"), F.count("*").alias("size")), "sources")
    sizes = trees.agg(F.max("size"), F.sum("size"), F.count("*")).first()
    most, total, n_trees = (x or 0 for x in sizes)
    trees = ws.table(_positions(ws, trees, "ordered", [F.col("key")], max(1, min(shards(spark), _tasks(n_trees)))).withColumnRenamed("pos", "tree"), "trees")
    leaves = join_groups(placed, trees, "key", "size").select("id", "tree", (F.col("pos") - F.col("start")).alias("pos"), "size", "node", "other")
    leaves = ws.table(leaves, "leaves_of")
    ws.drop("hashed", "leaves", "placed", "sources", "ordered")

    levels, height = _grown(ws, "levels", leaves, most, total)
    tops = leaves.select("tree", "size", "node").unionByName(levels.select("tree", "size", "node")).filter("size = 1").select("tree", "node")
    tops = ws.table(tops.coalesce(_tasks(n_trees)), "subroots")
    over = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("size"), "node")
    upper, steps = _grown(ws, "upper", over, n_trees, n_trees)
    root = over.select("size", "node").unionByName(upper.select("size", "node")).filter("size = 1").first()
    root = F.lit(bytes(root["node"]) if root else None).cast("binary")
    none = F.expr(f"cast(array() as array<{STEP}>)")
    top = spark.range(1).select(F.col("id").alias("tree"), none.alias("proof"))
    ends = _pushed(ws, "upper_proofs", upper, steps, top, n_trees).select(F.col("pos").alias("tree"), "proof") if steps else tops.select("tree", none.alias("proof"))
    ends = ws.table(tops.join(ends, "tree").select("tree", F.col("node").alias("subroot"), root.alias("root"), "proof"), "ends")
    proofs = _pushed(ws, "proofs", levels, height, ends.select("tree", "proof"), total)
    alone = leaves.filter("size = 1").join(ends, "tree").select("id", "tree", "node", "other", "proof", "subroot", "root")
    hot = ends.join(trees.select("tree", F.col("size").alias("__n")), "tree").select("tree", "subroot", "root", "__n")
    inner = join_groups(leaves.filter("size > 1").join(proofs, ["tree", "pos"]), ws.table(hot, "tops"), "tree", "__n")
    out = alone.unionByName(inner.select(alone.columns))
    return out.select(F.col("id").alias(id_col), text_of(F.col("node")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"), "proof", text_of(F.coalesce("other", "node")).alias("tampered_leaf"))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(F.lower(F.hex(s["left"])), F.lower(F.hex(s["right"])))), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), at, F.lower(F.hex(s["right"]))), 256))


def verify(proven: DataFrame) -> DataFrame:
    """Rows of `manifest` with proof_sha256, folded_root (from tampered_leaf) and verified in place of proof and tampered_leaf."""
    root = folded(F.col("tampered_leaf"), F.col("proof"))
    return proven.withColumns({"proof_sha256": proof_digest(F.col("proof")), "folded_root": root}).withColumn("verified", F.col("folded_root") == F.col("root")).drop("proof", "tampered_leaf")


def oracle() -> str:
    """DuckDB text of the query over `documents`."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    step = "list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, xor(a, b))"
    return f"""
with recursive
odd as (select distinct doc_id, list_reduce(list_transform(split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda a, b: {step}, 4294967295::bigint) % 2 = 0 as odd from documents),
leaf as (
  select doc_id, source, {leaf("text")} as node, {leaf("cut")} as other
  from (select d.*, case when odd then text else replace(text, chr(10), '') end as cut from documents d join odd using (doc_id))
),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, node) - 1 as pos, count(*) over (partition by source) as size from leaf),
up as (
  select 0 as lvl, source, pos, size, node from placed
  union all
  select lvl + 1, source, pos // 3, (size + 2) // 3, sha256(string_agg(node, '' order by pos)) from up where size > 1 group by all
),
tops as (select source, node as subroot, lvl as height, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as size from up where size = 1),
over_ as (
  select 0 as lvl, pos, size, subroot as node from tops
  union all
  select lvl + 1, pos // 3, (size + 2) // 3, sha256(string_agg(node, '' order by pos)) from over_ where size > 1 group by all
),
steps as (
  select p.doc_id, p.source, u.lvl,
    coalesce(string_agg(u.node, '' order by u.pos) filter (u.pos < p.pos // (3 ** u.lvl)::bigint), '') as lo, coalesce(string_agg(u.node, '' order by u.pos) filter (u.pos > p.pos // (3 ** u.lvl)::bigint), '') as hi
  from placed p join up u on p.source is not distinct from u.source and u.pos // 3 = p.pos // (3 ** (u.lvl + 1))::bigint and u.size > 1 group by p.doc_id, p.source, u.lvl
  union all
  select p.doc_id, p.source, t.height + o.lvl,
    coalesce(string_agg(o.node, '' order by o.pos) filter (o.pos < t.pos // (3 ** o.lvl)::bigint), ''), coalesce(string_agg(o.node, '' order by o.pos) filter (o.pos > t.pos // (3 ** o.lvl)::bigint), '')
  from placed p join tops t on p.source is not distinct from t.source join over_ o on o.pos // 3 = t.pos // (3 ** (o.lvl + 1))::bigint and o.size > 1 group by p.doc_id, p.source, t.height, o.lvl
),
proofs as (select doc_id, list(struct_pack(lo := lo, hi := hi) order by lvl) as proof from steps group by 1),
done as (
  select p.doc_id, p.node as leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(proof, lambda s: s.lo || s.hi), ''), '')) as proof_sha256,
    list_reduce(list_transform(coalesce(proof, []), lambda s: struct_pack(x := s.lo, y := s.hi)), lambda a, s: struct_pack(x := sha256(s.x || a.x || s.y), y := ''), struct_pack(x := p.other, y := '')).x as folded_root
  from placed p join tops t on p.source is not distinct from t.source join (select node as root from over_ where size = 1) on true left join proofs using (doc_id)
)
select *, folded_root = root as verified from done"""
