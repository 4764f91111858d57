"""Connected components of a graph of edges, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.shared import meet, saved

#: Into so many shares a hot key's rows are dealt.
SALTS = 64


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches. Alternating large and small stars.

    A hub's edges are dealt by their other ends, too.
    """
    now = saved(edges.select("a", "b"), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        joined = meet(both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))), least, ["a"], "salt")
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()

    checksum = None
    for _ in range(most_rounds):
        now = saved(star(saved(star(now, True), "edges"), False), "edges")
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (r.n, r.h) == checksum:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        checksum = (r.n, r.h)
    raise RuntimeError("the stars did not settle")


def named_components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, component_id) of nodes (node, least), linked by edges (a, b): the smallest `least` that links reach."""
    roots = saved(components(edges), "roots")
    salted = nodes.join(roots, nodes[node] == roots["node"]).select(nodes[node], "root", "least", F.pmod(F.xxhash64(nodes[node]), F.lit(SALTS)).alias("salt"))
    linked = saved(salted, "linked")
    named = meet(linked, linked.groupBy("root").agg(F.min("least").alias("component_id")), ["root"], "salt").select(node, "component_id")
    return nodes.join(named, node, "left").select(node, F.coalesce("component_id", "least").alias("component_id"))
