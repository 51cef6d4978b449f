"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars already: no end has two centres, and no centre is an end."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("end"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
    rest = ends.groupBy("id").agg(F.sum("end").alias("end"), F.max("centre").alias("centre")).agg(F.count_if((F.col("end") > 1) | (F.col("end") * F.col("centre") > 0)))
    return rest.first()[0] == 0


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every end of ``edges(u, v)``; component is the smallest id reachable.

    The number of rounds grows with the logarithm of the diameter, and rounds go on until
    only stars are left.  Each is a written table, groups are reduced before the shuffle,
    and the joins back to the minima are plain equi-joins, whose hot keys adaptive
    execution splits.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, k = scratch.table(edges, f"{name}-0"), 0
    while not _settled(now):
        k += 1
        then = scratch.table(_small(_large(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = then
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
