"""A Merkle manifest of a table: a hash for each row, a tree of hashes for each group, a tree over the groups, and each row's proof.

Rows of a group are numbered in order: range partitions are sorted and written, and a row's number is its place in its partition, counted from the
group's first row there, after the group's rows in the partitions before. A level then is a window over (group, parent number): the full frame's list of
hashes is both the parent's preimage and, without the own one, a node's siblings; the first node of each run alone goes on as the parent. Going down, a
node's path is its own siblings before those of its parent. Windows hold at most FANOUT nodes, so a group may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

FANOUT = 16
_STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A value's part of a row's preimage: `-` if null, else its UTF-8 byte count, `:` and itself."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def row_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_hash(path: Column) -> Column:
    """One hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows, which have a group g, with idx, the place in the group by order from 0, and n, the group's number of rows; equal rows in any order, fixed once written."""
    rows = cut(rows)
    tie = rows.withColumn("tie", F.monotonically_increasing_id())
    by = ["g", *order, "tie"]
    placed = cut(tie.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie"))
    placed = placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    spans = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    group = Window.partitionBy("g")
    before = F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(group).alias("n"))
    return placed.join(spans, ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes that aren't alone in their group, with their parent's number and the hashes of all its children."""
    frame = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.where("n > 1").withColumn("parent", F.expr(f"idx div {FANOUT}")).withColumn("run", F.collect_list("h").over(frame))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (g, idx, n, h, ...) of each level, from the leaves to where every group has one; those above the leaves are written."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = _runs(out[-1]).where(f"idx % {FANOUT} = 0")
        up = first.select("g", F.col("parent").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.sha2(F.array_join("run", ""), 256).alias("h"))
        out.append(cut(up))
        most = -(-most // FANOUT)
    return out


def _with_paths(levels: list[DataFrame], ends: DataFrame | None) -> DataFrame:
    """The leaves with subroot, root and path; ends: root and path of each group's last node, else that node is the root."""
    pos = F.col("idx") % FANOUT
    own = F.struct(F.array_join(F.slice("run", F.lit(1), pos.cast("int")), "").alias("left"), F.array_join(F.slice("run", (pos + 2).cast("int"), F.lit(FANOUT)), "").alias("right"))
    above = None
    for nodes in reversed(levels):
        last = nodes.where("n = 1").withColumn("subroot", F.col("h"))
        if ends is None:
            here = last.withColumn("root", F.col("h")).withColumn("path", F.array().cast(f"array<{_STEP}>"))
        else:
            here = last.join(ends, "g")
        if above is not None:
            up = above.select("g", F.col("idx").alias("parent"), "subroot", "root", F.col("path").alias("up"))
            inner = _runs(nodes).join(up, ["g", "parent"]).withColumn("path", F.concat(F.array(own), F.col("up")))
            here = here.unionByName(inner.select(*here.columns))
        above = here
    return above


def manifest(rows: DataFrame, group: Column, order: Column, fields: list[Column], keep: dict[str, Column]) -> DataFrame:
    """(the columns of keep, leaf, subroot, root, path) for each row.

    A leaf is the hash of the row's fields. Within a group leaves lie in order (null first; ties by leaf); while a group has several nodes, each FANOUT
    consecutive ones, or what is left of them, become the hash of their digests. What remains is the group's subroot; the subroots, in order of the groups
    (null first, then bytewise), make the root likewise. path has a step for each level: the digests of the siblings left and right of the row's node.

    Nulls in any column, empty and very long values are fields like others; rows that repeat are leaves of their own; columns that aren't named take no part,
    whatever their names; an empty table gives an empty result.
    """
    g = F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string"))).alias("g")
    kept = F.struct(*(c.alias(k) for k, c in keep.items())).alias("kept")
    leaves = numbered(rows.select(g, order.alias("o"), row_hash(*fields).alias("h"), kept), "o", "h")
    levels = _levels(cut(leaves.select("g", "idx", "n", "h", "kept")))
    tops = levels[0].where("n = 1").select("g", "h")
    for nodes in levels[1:]:
        tops = tops.union(nodes.where("n = 1").select("g", "h"))
    tops = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), "name")
    ends = _with_paths(_levels(cut(tops.select("g", "idx", "n", "h", "name"))), None).select(F.col("name").alias("g"), "root", "path")
    return _with_paths(levels, cut(ends)).select("kept.*", F.col("h").alias("leaf"), "subroot", "root", "path")
