"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import discard, materialize


FEW = 500_000  # edges; the least neighbours of so many are a broadcast of some 8 MB


def _large(edges: DataFrame, hint) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(hint(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")  # no more rows than edges; _small sheds the repeated ones


def _small(edges: DataFrame, hint) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(hint(least), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (u, v): root is the least node
    it can reach; roots themselves are left out.

    A round is logarithmic in path length, minima are combined before the
    shuffle, and each round's edges are a table in the shared folder.  Where
    they are counted to be few, least neighbours go to the edges, not the edges
    to them.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if tuple(seen) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        hint = F.broadcast if seen["n"] <= FEW else lambda df: df
        after = materialize(_small(_large(edges, hint), hint), "edges")
        discard(edges)
        edges = after
    raise RuntimeError("components did not settle")
