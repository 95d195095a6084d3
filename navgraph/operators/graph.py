"""Edges, degrees and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.shared import checkpointed


def in_degree(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct sources of each target. Repeats go first (map-side and by pair), so a hub's count is spread out."""
    return edges.select(src, dst).distinct().groupBy(dst).agg(F.count("*").alias("n"))


def hubs(edges: DataFrame, src: str, dst: str, top: int) -> DataFrame:
    return in_degree(edges, src, dst).orderBy(F.desc("n"), dst).limit(top)


def layers(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", max_depth: int = 0) -> DataFrame:
    """``node, layer``: the fewest edges from a seed, seeds at 0; ``max_depth`` 0 goes on to the end.

    One round for each layer: the frontier joins the edges, what was met before drops out (anti-join), and the new
    layer is kept in the shared folder, so lineage stays short and a lost executor costs one round.
    """
    edges = edges.select(F.col(src).alias("__src"), F.col(dst).alias("node")).where("__src IS NOT NULL AND node IS NOT NULL").distinct()
    frontier = checkpointed(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node IS NOT NULL").distinct().withColumn("layer", F.lit(0)))
    met, depth = frontier, 0
    while (max_depth == 0 or depth < max_depth) and frontier.take(1):
        depth += 1
        ahead = edges.join(frontier.select(F.col("node").alias("__src")), "__src").select("node").distinct()
        frontier = checkpointed(ahead.join(met.select("node"), "node", "left_anti").withColumn("layer", F.lit(depth)))
        met = checkpointed(met.unionByName(frontier)) if depth % 8 == 0 else met.unionByName(frontier)
    return met


def reachable_pairs(edges: DataFrame, src: str = "src", dst: str = "dst", max_depth: int = 0) -> DataFrame:
    """``origin, node``: every node and what it reaches, itself included; for graphs as small as class hierarchies.

    ``max_depth`` 0 goes on to the end: each round meets new pairs, and there are finitely many.
    """
    edges = checkpointed(edges.select(F.col(src).alias("__src"), F.col(dst).alias("node")).distinct())
    nodes = edges.select(F.col("__src").alias("node")).union(edges.select("node")).distinct()
    met = frontier = checkpointed(nodes.select(F.col("node").alias("origin"), "node"), plain=True)
    depth = 0
    while max_depth == 0 or depth < max_depth:
        depth += 1
        ahead = frontier.withColumnRenamed("node", "__src").join(edges, "__src").select("origin", "node").distinct()
        frontier = checkpointed(ahead.join(met, ["origin", "node"], "left_anti"), plain=True)
        if not frontier.take(1):
            break
        met = checkpointed(met.unionByName(frontier), plain=True) if depth % 8 == 0 else met.unionByName(frontier)
    return met
