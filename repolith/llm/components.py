"""Connected components by alternating stars, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import base


def _smallest(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of every ``u``, one row each; a node of very many links meets one row."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _smallest(down)
    rest = down.join(m, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(m.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges (u, v)``; order and repeats do not matter.

    Stars are made of larger and of smaller neighbours in turn until nothing changes, which takes a number of
    rounds about logarithmic in the longest path. Each round is a table in the shared folder; only a count
    and a checksum reach the driver.
    """
    edges = base.stage(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        edges = base.stage(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
