"""Decision and knowledge records."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.session import ensure_checkpoint_dir

_FIELDS = ("id", "title", "category", "status", "date", "session", "supersedes", "superseded_by")


def read_decisions(contents: DataFrame) -> DataFrame:
    """Front-matter fields of decision and knowledge documents; 'null' is null, tags an array."""
    front = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)

    def field(name: str) -> F.Column:
        value = F.btrim(F.regexp_extract(F.col("front"), rf"(?m)^{name}:[ \t]*(.*)$", 1), F.lit(' \t\r"'))
        return F.when((value != "") & (value != "null"), value)

    listed = lambda name: F.filter(
        F.transform(F.split(F.btrim(field(name), F.lit("[]")), ","), lambda x: F.trim(x)), lambda x: x != ""
    )
    return (
        contents.withColumn("front", front)
        .filter("front <> ''")
        .select("repo_id", "path", *[field(f).alias(f) for f in _FIELDS], listed("tags").alias("tags"), listed("related").alias("related"))
        .filter("id IS NOT NULL")
    )


def decision_index(decisions: DataFrame) -> DataFrame:
    """Records per id prefix and status (AGG-35)."""
    return decisions.groupBy(
        "repo_id", F.regexp_extract("id", r"^[A-Z]+", 0).alias("prefix"), "status"
    ).agg(F.count(F.lit(1)).alias("n"))


def maturity(decisions: DataFrame) -> DataFrame:
    """Knowledge level by number of sessions: up to 3, 4 to 10, more (AGG-35)."""
    return (
        decisions.groupBy("repo_id")
        .agg(F.countDistinct("session").alias("sessions"))
        .withColumn(
            "level",
            F.when(F.col("sessions") <= 3, "New hire").when(F.col("sessions") <= 10, "Contributing").otherwise("Senior"),
        )
    )


def active_decision(decisions: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Follow ``superseded_by`` to the record in force (JOIN-16).

    Pointer doubling: each round joins the pointers with themselves and so doubles the distance,
    so a chain of 1,000 takes ten joins. The pointers are checkpointed after each round, which keeps
    the plan flat and survives lost executors. Every round resolves more records while any chain is
    left, so the rounds end with the first that resolves none; ``max_depth`` ends them earlier.
    Records on a cycle get no active record.
    """
    ensure_checkpoint_dir(decisions.sparkSession)
    known = decisions.select("repo_id", "id")
    # a pointer to an unknown record ends there, so the record itself is in force
    links = decisions.join(
        known.select("repo_id", F.col("id").alias("superseded_by"), F.lit(True).alias("_known")),
        ["repo_id", "superseded_by"],
        "left",
    ).select("repo_id", "id", F.when(F.col("_known"), F.col("superseded_by")).alias("next"))
    state = links.select(
        "repo_id", "id", F.coalesce("next", "id").alias("at"), F.col("next").isNotNull().cast("bigint").alias("hops")
    )
    ends = links.filter("next IS NULL").select("repo_id", F.col("id").alias("at"), F.lit(True).alias("_end"))
    resolved, rounds = -1, 0
    while max_depth is None or rounds < max(1, math.ceil(math.log2(max_depth))):
        state = state.checkpoint()
        now = state.join(ends, ["repo_id", "at"], "left_semi").count()
        if now == resolved:
            break
        resolved, rounds = now, rounds + 1
        hop = state.select("repo_id", F.col("id").alias("at"), F.col("at").alias("further"), F.col("hops").alias("more"))
        state = state.join(hop, ["repo_id", "at"]).select(
            "repo_id", "id", F.col("further").alias("at"), (F.col("hops") + F.col("more")).alias("hops")
        )
    return state.join(ends, ["repo_id", "at"], "left").select(
        "repo_id",
        "id",
        F.when(F.col("_end"), F.col("at")).alias("active_id"),
        F.when(F.col("_end"), F.col("hops")).alias("hops"),
    )
