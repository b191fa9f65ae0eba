"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, go to the smallest of them. edges: (hi, lo), hi > lo."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least.withColumnRenamed("hi", "k"), F.col("hi") == F.col("k")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest node around it, itself included."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for each node that has an edge to another one: root is the smallest node of its component.

    Node ids are longs. Edges with a NULL end, and loops, count for nothing. Every round's edges are a table in the shared
    folder, so a lost executor costs one round at most. Only a row of counts comes to the driver. Rounds grow with the
    logarithm of the longest chain.
    """
    e = edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
    e = materialize(e.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("hi") != F.col("lo"))).distinct(), "cc-edges")
    while True:
        tops = e.select("hi").distinct()
        chained = e.join(tops.withColumnRenamed("hi", "k"), F.col("lo") == F.col("k"), "left_semi")
        forked = e.groupBy("hi").count().where("count > 1")
        if chained.isEmpty() and forked.isEmpty():
            break
        e = materialize(_small_star(_large_star(e)), "cc-edges")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
