"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import cut


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour; partial aggregation keeps hot nodes small."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    """Edges in either direction, in one pass."""
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _large(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of the node and its neighbours."""
    all_ = _both(edges)
    m = _least(all_).select("u", F.least("u", "m").alias("m"))
    return all_.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    m = _least(edges)
    tied = edges.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(m.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, component`` (the least node) for every node of ``pairs(a, b)``, and the pairs, computed once."""
    pairs = cut(pairs)
    edges = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        edges = cut(_small(_large(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct()), pairs
