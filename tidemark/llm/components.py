"""Connected components of an edge table by alternating star contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _contract(edges: DataFrame, largest: bool) -> DataFrame:
    """One star step over edges (u > v): every neighbour (larger ones only, or smaller ones and u itself) to the least of them.

    The least neighbour comes from a partial aggregate and goes back by a join that Spark can split, so a hub's
    edges never meet in one task.
    """
    if largest:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        pairs = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        pairs = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p")).select(
            F.col("p.v").alias("u"), F.col("p.m").alias("v"))
    return pairs.where("u <> v").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of an edge (a, b) can reach, for nodes other than roots.

    Loops and repeated edges are allowed. Ends when a round changes nothing; a round is two joins over the
    edges, and rounds grow with the logarithm of the longest path.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = _contract(_contract(now, True), False).checkpoint()
