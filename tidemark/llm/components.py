"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregation and an equi-join over edges, written to the shared
folder; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import _runtime


def components(edges: DataFrame, path: str) -> DataFrame:
    """edges: a, b (any comparable type). Returns node, comp: the least node of its component.

    Only nodes with an edge to another node appear.
    """
    now = _runtime.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/0")
    seen = _mark(now)
    step = 0
    while seen[0]:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("v > a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = _runtime.table(large, f"{path}/{step}l")
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = _runtime.table(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), f"{path}/{step}s")
        if (new := _mark(now)) == seen:
            break
        seen = new
    tops = now.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(tops)


def _star(both: DataFrame) -> DataFrame:
    """a, its neighbours v and m, the least of a and all of them."""
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").select("a", F.col("b").alias("v"), "m")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
