"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, written


def _least(pairs: DataFrame) -> DataFrame:
    """For each u the least of its neighbours and itself, as a written table: the join that follows reads both sides
    straight from an exchange, so that adaptive execution can split a hub."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node that can be reached.

    Edges with a null end and loops are ignored; repeated edges count once; no edges give no rows. Each round is two
    aggregations and two joins over tables written to the shared folder; nothing is collected but a count and a
    checksum. Raises if it has not settled after most_rounds (rounds grow with the logarithm of a path's length).
    """
    return settled(edges.sparkSession, "components", lambda: _components(edges, most_rounds))


def _components(edges: DataFrame, most_rounds: int) -> DataFrame:
    edges = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    for _ in range(most_rounds if before[0] else 0):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        small = large.join(_least(large), "u")  # every u is greater than its v here
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = written(small.where("u <> v").distinct(), "small")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
