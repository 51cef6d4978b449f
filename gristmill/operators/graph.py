"""Links between records: neighbours, expansion, dangling ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, kind) for either end."""
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "kind")
    return there.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "kind"))


def related(edges: DataFrame, start: DataFrame, live: DataFrame, hops: int = 3, kinds: list[str] | None = None) -> DataFrame:
    """(node, hop, via, dangling): breadth first from ``start(node)``; of several ways to a node the smallest neighbour's counts.

    Nodes that are not live are reported and not passed through.
    """
    if kinds:
        edges = edges.filter(F.col("kind").isin(kinds))
    ways = both_ways(edges.filter("src <> dst")).select("node", "other").distinct()
    known = live.select("node").distinct().withColumn("alive", F.lit(True))
    seen = start.select("node").distinct().select("node", F.lit(0).alias("hop"), F.lit(None).cast("long").alias("via"), F.lit(False).alias("dangling"))
    edge_of = seen
    for hop in range(1, min(3, hops) + 1):
        reach = edge_of.filter("NOT dangling").select("node").join(ways, "node").groupBy(F.col("other").alias("next")).agg(F.min("node").alias("via"))
        fresh = reach.join(seen.select(F.col("node").alias("next")), "next", "left_anti")
        edge_of = fresh.join(known.withColumnRenamed("node", "next"), "next", "left").select(F.col("next").alias("node"), F.lit(hop).alias("hop"), "via", F.col("alive").isNull().alias("dangling"))
        seen = seen.unionByName(edge_of)
    return seen


def expanded(edges: DataFrame, start: DataFrame, live: DataFrame, hops: int = 3, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(node, hop, via, kind, dangling, place): breadth first over edges with an ordinal ``ord``, by the first edge that reaches a node.

    The nodes of a step are looked at in the order in which they were found, and the edges
    of each by ordinal; ``place`` sorts nodes of a hop in that order.  Nodes that are not
    live are reported and not passed through; ``limit`` keeps the first so many live ones.
    """
    if kinds:
        edges = edges.filter(F.col("kind").isin(kinds))
    edges = edges.filter("src <> dst")
    ways = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "kind", "ord").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), "kind", "ord"))
    known = live.select(F.col("node").alias("next")).distinct().withColumn("alive", F.lit(True))
    seen = start.select("node").distinct().select("node", F.lit(0).alias("hop"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("via"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("dangling"), F.lpad(F.col("node").cast("string"), 20, "0").alias("place"))
    edge_of = seen
    for hop in range(1, min(3, hops) + 1):
        found = edge_of.filter("NOT dangling").select("node", "place").join(ways, "node").select("next", "node", "kind", F.concat("place", F.lpad(F.col("ord").cast("string"), 20, "0")).alias("place"))
        first = found.groupBy("next").agg(F.min_by(F.struct("node", "kind"), "place").alias("by"), F.min("place").alias("place"))
        fresh = first.join(seen.select(F.col("node").alias("next")), "next", "left_anti").join(known, "next", "left")
        edge_of = fresh.select(F.col("next").alias("node"), F.lit(hop).alias("hop"), F.col("by.node").alias("via"), "by.kind", F.col("alive").isNull().alias("dangling"), "place")
        seen = seen.unionByName(edge_of)
    if limit is None:
        return seen
    return seen.filter("hop > 0 AND NOT dangling").orderBy("hop", "place").limit(limit)


def neighbour_counts(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of each node by kind and in all; a self-loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "kind")
    return ends.groupBy("node").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.count("*").alias("total"))


def dangling(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Edges with an end that is not live."""
    ids = live.select(F.col("node").alias("_id")).distinct()
    left = edges.join(ids, F.col("src") == F.col("_id"), "left").withColumn("_src", F.col("_id").isNotNull()).drop("_id")
    return left.join(ids, F.col("dst") == F.col("_id"), "left").filter(~F.col("_src") | F.col("_id").isNull()).drop("_id", "_src")


def pruned(edges: DataFrame, dead: DataFrame) -> DataFrame:
    """Edges that touch no dead id."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(dead.select(F.col("node").alias(end)).distinct(), end, "left_anti")
    return out.select(edges.columns)


def trusted(rows: DataFrame, key: str, refs: str, tiers: DataFrame) -> DataFrame:
    """Rows all of whose references are known and not unverified."""
    each = rows.select(key, F.explode(refs).alias("id")).join(tiers, "id", "left")
    bad = each.filter(F.col("tier").isNull() | (F.col("tier") == "unverified")).select(key).distinct()
    return rows.join(bad, key, "left_anti")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def looked_up(refs: DataFrame, index: DataFrame, key: str, label: str) -> DataFrame:
    """References with the label of the row that they name, the first of several, and whether there is none (``dangling``)."""
    first = index.groupBy(key).agg(F.min(label).alias(label), F.lit(True).alias("_there"))
    return refs.join(first, key, "left").withColumn("dangling", F.col("_there").isNull()).drop("_there")
