"""Joins that survive hot keys, and connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import discard, keep

#: A key is hot with more rows than HOT and than this share of all rows, so at most 1 / HOT_SHARE keys are hot and broadcast.
HOT, HOT_SHARE = 1000, 1e-5


def hub_join(rows: DataFrame, hubs: DataFrame, on: str, total: int) -> DataFrame:
    """The rows joined to the hubs, whose key is unique and whose n is the number of the rows that have it, total in all.

    Hot hubs, 1 / HOT_SHARE at most whatever the input is, are broadcast, so their rows stay where they are; the others meet by a
    shuffle. Rows of a null or unknown key have no partner."""
    if total <= HOT:
        return rows.join(hubs.drop("n"), on)
    floor = max(HOT, int(total * HOT_SHARE))
    light, heavy = hubs.where(F.col("n") <= floor).drop("n"), F.broadcast(hubs.where(F.col("n") > floor).drop("n"))
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(on), on, "left_anti").join(light, on))


def _state(edges: DataFrame) -> tuple[int, int]:
    """(edges, nodes that keep them from being stars: with two targets, or with one and a follower)."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    row = ends.agg(F.sum("out"), F.count(F.when((F.col("out") > 1) | (F.col("out") + F.col("in") > 1), 1))).first()
    return row[0] or 0, row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b), label being the smallest node of its component.

    A round points the larger neighbours of every node to the least one, then every node's smaller neighbours to the
    least of them; rounds end when every node points to its component's least. Both halves are a minimum per node, partly
    aggregated by every task, and a join back in which hot nodes are broadcast, so the edges of a node of any degree stay
    spread. Edges are written to the shared folder in each half, and deleted when the next round's are there. Loops and repeated edges are allowed; without edges there
    are no nodes."""
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    total, mixed = _state(edges)
    while mixed:
        # large star: both directions, to the least of a node's neighbours and itself
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = keep(hub_join(both, least, "a", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        # small star: edges point to smaller nodes only
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = hub_join(large, least, "a", 2 * total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, keep(small.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        discard(before, large)
        total, mixed = _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
