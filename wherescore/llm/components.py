"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherescore.operators.joins import spread_join
from wherescore.sources.scratch import settle


def _smallest(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the smallest neighbour m of u, u itself included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return spread_join(pairs, least, ["u"], "inner")


def components(links: DataFrame) -> DataFrame:
    """Each linked node with the smallest node it can reach: node, component. ``links`` has two long columns.

    Distributed union-find by alternating star operations: every node hands its larger neighbours to its smallest one,
    then its smaller ones, until all trees are stars. Each round is two aggregations and two joins over the links and
    is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    Nulls and links of a node to itself are left out; no links give no rows.
    """
    a, b = links.columns
    edges = settle(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _smallest(large)
        edges = settle(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
