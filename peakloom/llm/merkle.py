"""Merkle manifests of tables: a root over all rows, and each row's proof.

Rows are leaves of a tree a group, in order; the groups' roots are leaves of one more tree. Levels are kept only every
few (`every`): a stored node stands for an aligned subtree of arity**every nodes of the stored level below it. Who needs
what lies between makes it again from these, in the expression that uses it, and drops it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.llm.shared import saved

#: Rows that one task sorts and numbers.
PART_ROWS = 250_000


def digest(*inputs: Column) -> Column:
    """H: the lowercase hex SHA-256 of the inputs, concatenated."""
    return F.sha2(F.concat(*inputs), 256)


def leaf(fields: list[Column]) -> Column:
    """H of a row's fields: "-" for a null, else the value's size in UTF-8 bytes, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


@dataclass
class Forest:
    """Trees by group: stored levels (tree, pos, h, depth), the lowest first; roots (tree, h)."""

    levels: list[DataFrame]
    roots: DataFrame
    arity: int
    every: int


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (tree, ...) with pos: gapless from 0 in each tree, by order, nulls first; and n, the tree's nodes.

    Rows are dealt by ranges of (tree, order, a number), so that neither a tree nor equal rows fill one task. Places
    in sorted parts and the parts' counts give the positions. Stores the sorted rows.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_ROWS + 1)
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "tree", *order, "tie")
    rows = saved(dealt.sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()).drop("tie"), "merkle-sorted")
    part = F.shiftright("at", 33)
    counts = rows.groupBy("tree", part.alias("part")).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("m"))
    # A row a part of a tree: these windows hold as many rows as a tree has parts.
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("m").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("tree").alias("t"), "part", (before - F.col("start")).alias("shift"), F.sum("m").over(tree).alias("n"))
    same = rows["tree"].eqNullSafe(counts["t"]) & (part == counts["part"])
    return rows.join(counts, same).withColumn("pos", F.col("at") + F.col("shift")).drop("t", "part", "shift", "at")


def depth(n: Column, arity: int) -> Column:
    """Levels above n nodes until one is left."""
    powers, p = [1], arity
    while p < 2**62:
        powers.append(p)
        p *= arity
    return F.size(F.filter(F.array([F.lit(x) for x in powers]), lambda x: x < n))


def folded(run: Column, arity: int) -> Column:
    """The parents of a run of neighbours that starts at a parent's first child."""
    many = F.ceil(F.size(run) / arity).cast("int")
    return F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.sha2(F.array_join(F.slice(run, i * arity + 1, F.lit(arity)), ""), 256))


def subtrees(level: DataFrame, no: int, arity: int, every: int) -> DataFrame:
    """(tree, block, depth, runs): for each aligned subtree above level `no` its nodes level by level, the top last.

    At most arity**every rows make a subtree. A tree that ends below the subtree's height ends its runs there.
    """
    width = arity**every
    block = F.floor(F.col("pos") / width).cast("long").alias("block")
    own = level.filter(F.col("depth") > no).groupBy("tree", "depth", block).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("nodes"))
    made = own.withColumn("run0", F.col("nodes.h"))
    for k in range(1, every + 1):
        below = F.col(f"run{k - 1}")
        made = made.withColumn(f"run{k}", F.when(F.col("depth") >= no + k, folded(below, arity)))
    return made


def forest(leaves: DataFrame, arity: int, every: int) -> Forest:
    """Trees over the numbered leaves (tree, h, pos, n, ...); stores a level of every few."""
    base = leaves.withColumn("depth", depth(F.col("n"), arity)).drop("n")
    levels, no = [base], 0
    ends = [base.filter("depth = 0").select("tree", "h")]
    most = leaves.agg(F.max(depth(F.col("n"), arity))).first()[0] or 0
    while no < most:
        made = subtrees(levels[-1], no, arity, every)
        top = F.coalesce(*(F.col(f"run{k}") for k in range(every, 0, -1)))[0]
        up = saved(made.select("tree", "depth", F.col("block").alias("pos"), top.alias("h")), "merkle-level")
        no += every
        ends.append(up.filter((F.col("depth") <= no)).select("tree", "h"))
        levels.append(up)
    roots = ends[0]
    for e in ends[1:]:
        roots = roots.unionByName(e)
    return Forest(levels, roots, arity, every)


def paths(trees: Forest) -> DataFrame:
    """The leaves with path: array of (l, r), what of a node's run stands left and right of it, from the leaf up.

    From the top stored level down: each subtree is made again, its nodes get their siblings in it and the path of
    the subtree's top, and only these go on to the next level.
    """
    arity, every = trees.arity, trees.every
    none = F.array().cast("array<struct<l:string,r:string>>")
    above: DataFrame | None = None
    for k in range(len(trees.levels) - 1, -1, -1):
        no, level = k * every, trees.levels[k]
        ended = level.filter(F.col("depth") <= no).withColumn("path", none)
        if k == len(trees.levels) - 1:
            above = ended
            continue
        made = subtrees(level, no, arity, every)
        tops = above.select(F.col("tree").alias("t"), F.col("pos").alias("b"), F.col("path").alias("over"))
        met = made.join(tops, made["tree"].eqNullSafe(tops["t"]) & (made["block"] == tops["b"]))

        def siblings(node: Column) -> Column:
            segment = []
            for j in range(every):
                run, q = F.col(f"run{j}"), F.floor((node["pos"] % arity**every) / arity**j).cast("int")
                first = q - q % arity
                left, right = F.slice(run, first + 1, q % arity), F.slice(run, q + 2, arity - 1 - q % arity)
                segment.append(F.when(F.col("depth") > no + j, F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))))
            return F.concat(F.filter(F.array(*segment), lambda s: s.isNotNull()), F.col("over"))

        each = met.select("tree", "depth", F.explode(F.transform("nodes", lambda node: F.struct(node["pos"].alias("pos"), siblings(node).alias("path")))).alias("node"))
        each = each.select(F.col("tree").alias("t"), F.col("node.pos").alias("p"), "node.path")
        if k:
            above = ended.select("tree", "pos", "path").unionByName(each.select(F.col("t").alias("tree"), F.col("p").alias("pos"), "path"))
        else:
            more = level.filter(F.col("depth") > 0)
            here = more.join(each, more["tree"].eqNullSafe(each["t"]) & (more["pos"] == each["p"])).drop("t", "p")
            above = ended.unionByName(here)
    return above


def climbed(h: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, h, lambda acc, s: digest(s["l"], acc, s["r"]))


def path_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def manifest(
    rows: DataFrame, *, group_col: str = "lang", id_col: str = "doc_id", fields: list[str], arity: int = 2, every: int = 4, carry: dict[str, Column] | None = None
) -> DataFrame:
    """A row of `rows` each: (id_col, group_col, leaf, subroot, root, path, and what `carry` names).

    The leaf is H of the row's fields. In a group leaves ascend by (id, leaf), null ids first; every `arity` neighbours
    make a node, the last run with what is left, until one node is left, the group's subroot. Subroots, null group
    first, then by the group's UTF-8 bytes, make the root alike. `path` holds, from the leaf to the root, the
    digests left and right of the node in its run; see `climbed`. Null fields, empty and very long texts are leaves
    like any other; repeated rows are leaves of their own; a lone leaf is its subroot; no rows give no rows.
    Stores leaves, and a level of every `every`, in the shared folder; texts are read once and don't travel.
    """
    carry = carry or {}
    at = {name: f"kept{k}" for k, name in enumerate(carry)}
    own = rows.select(
        F.col(f"`{group_col}`").alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf([F.col(f"`{f}`") for f in fields]).alias("h"), *(c.alias(at[name]) for name, c in carry.items())
    )
    lower = saved(numbered(saved(own, "merkle-leaves"), ["id", "h"]), "merkle-leaves")
    trees = forest(lower, arity, every)
    subroots = saved(trees.roots, "merkle-subroots")
    order = F.encode(F.coalesce(F.col("tree").cast("string"), F.lit("")), "UTF-8")
    upper_leaves = subroots.select(F.lit(0).alias("tree"), F.col("tree").isNotNull().alias("some"), order.alias("name"), F.col("tree").alias("group"), "h")
    upper = forest(saved(numbered(upper_leaves, ["some", "name"]), "merkle-subroots"), arity, every)
    tops = saved(paths(upper).select("group", F.col("h").alias("subroot"), F.col("path").alias("rest")), "merkle-tops")
    root = upper.roots.first()  # one row, or none
    low = paths(trees)
    # Few groups make few rows; Spark chooses by their size whether to send them.
    met = low.join(tops, low["tree"].eqNullSafe(tops["group"])).withColumn("root", F.lit(root.h if root else None).cast("string"))
    return met.select(
        F.col("id").alias(id_col), F.col("tree").alias(group_col), F.col("h").alias("leaf"), "subroot", "root", F.concat("path", "rest").alias("path"), *(F.col(k).alias(name) for name, k in at.items())
    )
