"""What a set of nodes reaches in a directed graph per repository, at the smallest distance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.session import ensure_checkpoint_dir

#: Steps walked one by one before chains of the graph are looked for.
PLAIN_STEPS = 24
_FOUND = "repo_id STRING, origin STRING, node STRING, hop BIGINT, ran BOOLEAN"


class _Rounds:
    """Tables of an iteration in the shared folder, one folder per round."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def all_found(self) -> DataFrame:
        return self.spark.read.schema(f"{_FOUND}, round INT").parquet(f"{self.root}/found").drop("round")


def chains(steps: DataFrame, rounds: _Rounds) -> DataFrame:
    """chain, node, left of nodes on chains: the only way on from a node leads to one that nothing else leads to.

    ``left`` counts the steps to the end of the chain. Every node looks as far ahead as the node it looks at, so
    the reach doubles with each round; a table is written per round. On a ring nothing ends: once the reach is
    longer than any ring, its smallest node serves as the end.
    """
    key = ["repo_id", "a"]
    alone = steps.groupBy(*key).agg(F.count(F.lit(1)).alias("ways"), F.min("b").alias("b")).filter("ways = 1")
    single = steps.groupBy("repo_id", "b").agg(F.count(F.lit(1)).alias("ways")).filter("ways = 1")
    links = alone.join(single.select("repo_id", "b"), ["repo_id", "b"], "left_semi")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    # ``low`` is the smallest node among those passed, ``low_at`` the steps to it
    ahead = links.select("repo_id", "a", "b", one.alias("left"), F.col("a").alias("low"), zero.alias("low_at"))
    ahead = rounds.write(ahead, "chains/0")
    n, reach = ahead.count(), 1
    while True:
        further = ahead.select("repo_id", F.col("a").alias("b"), *(F.col(c).alias(f"{c}_2") for c in ("b", "left", "low", "low_at")))
        lower = F.col("low_2") < F.col("low")
        joined = ahead.join(further, ["repo_id", "b"], "left")
        goes = F.col("left_2").isNotNull()
        ahead = rounds.write(
            joined.select(
                "repo_id",
                "a",
                F.coalesce("b_2", "b").alias("b"),
                (F.col("left") + F.coalesce("left_2", zero)).alias("left"),
                F.when(goes & lower, F.col("low_2")).otherwise(F.col("low")).alias("low"),
                F.when(goes & lower, F.col("left") + F.col("low_at_2")).otherwise(F.col("low_at")).alias("low_at"),
                goes.alias("goes"),
            ),
            f"chains/{reach}",
        )
        reach *= 2
        if reach > n or ahead.filter("goes").isEmpty():
            break
        ahead = ahead.drop("goes")
    ring = ahead.join(links.select("repo_id", F.col("a").alias("b")), ["repo_id", "b"], "left_semi")
    path = ahead.join(links.select("repo_id", F.col("a").alias("b")), ["repo_id", "b"], "left_anti")
    ends = path.select("repo_id", F.col("b").alias("chain"), F.col("b").alias("node"), zero.alias("left")).distinct()
    on_path = path.select("repo_id", F.col("b").alias("chain"), F.col("a").alias("node"), "left")
    on_ring = ring.select("repo_id", F.col("low").alias("chain"), F.col("a").alias("node"), F.col("low_at").alias("left"))
    return rounds.write(on_path.unionByName(ends).unionByName(on_ring), "placed")


def reachable(start: DataFrame, steps: DataFrame, hops: int | None = None, plain_steps: int = PLAIN_STEPS) -> DataFrame:
    """repo_id, origin, node, hop: all nodes that ``start (repo_id, origin)`` reaches over ``steps (repo_id, a, b)``, but itself.

    Only what a round has found goes into the next one: it meets the steps, and what all rounds before have found is
    taken off. A round is a table of its own, so its plan has the same joins however many rounds came before.
    Cycles end by themselves. Where ``plain_steps`` are not enough, chains of nodes with one way in and one way
    out are placed by doubling, and a round then runs a chain to its end at once; a node that is found again on
    a shorter way replaces its distance. ``hops`` limits the distance; None has no limit.
    """
    rounds = _Rounds(start.sparkSession, "reach")
    steps = steps.select("repo_id", "a", "b").filter("a <> b").distinct()
    steps = rounds.write(steps.filter("a IS NOT NULL AND b IS NOT NULL"), "steps")
    first = start.select("repo_id", "origin").filter("origin IS NOT NULL").distinct()
    no, zero = F.lit(False), F.lit(0).cast("bigint")
    front = rounds.write(first.select("repo_id", "origin", F.col("origin").alias("node"), zero.alias("hop"), no.alias("ran")), "found/round=0")
    at, placed = 0, None
    while hops is None or at < hops or placed is not None:
        at += 1
        if at > plain_steps and placed is None:
            placed = chains(steps, rounds)
        found = _next(front, steps, placed)
        if hops is not None:
            found = found.filter(F.col("hop") <= hops)
        known = rounds.all_found()
        key = ["repo_id", "origin", "node"]
        if placed is None:
            new = found.join(known, key, "left_anti")
        else:
            known = known.groupBy(*key).agg(F.min("hop").alias("best"))
            new = found.join(known, key, "left").filter("best IS NULL OR hop < best").drop("best")
        front = rounds.write(new, f"found/round={at}")
        if front.isEmpty():
            break
    out = rounds.all_found().filter("node <> origin")
    return out.groupBy("repo_id", "origin", "node").agg(F.min("hop").alias("hop"))


def _next(front: DataFrame, steps: DataFrame, placed: DataFrame | None) -> DataFrame:
    """Nodes one step on from ``front``, or at all places further on the chain."""
    step_on = steps.withColumnRenamed("a", "node")
    if placed is None:
        found = front.join(step_on, ["repo_id", "node"]).select("repo_id", "origin", F.col("b").alias("node"), (F.col("hop") + 1).alias("hop"))
        return found.groupBy("repo_id", "origin", "node").agg(F.min("hop").alias("hop")).withColumn("ran", F.lit(False))
    here = front.join(placed, ["repo_id", "node"], "left")
    steps_on = here.filter("left IS NULL OR left = 0").join(step_on, ["repo_id", "node"])
    steps_on = steps_on.select("repo_id", "origin", F.col("b").alias("node"), (F.col("hop") + 1).alias("hop"), F.lit(False).alias("ran"))
    # who came by a run has been run on from already
    runs = here.filter("left > 0 AND NOT ran").select("repo_id", "origin", "chain", "hop", F.col("left").alias("from_left"))
    runs = runs.join(placed, ["repo_id", "chain"]).filter("left < from_left")
    runs = runs.select("repo_id", "origin", "node", (F.col("hop") + F.col("from_left") - F.col("left")).alias("hop"), F.lit(True).alias("ran"))
    both = steps_on.unionByName(runs).groupBy("repo_id", "origin", "node").agg(F.min(F.struct("hop", (~F.col("ran")).alias("stepped"))).alias("m"))
    return both.select("repo_id", "origin", "node", "m.hop", (~F.col("m.stepped")).alias("ran"))
