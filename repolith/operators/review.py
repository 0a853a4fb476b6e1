"""Checks on a change set: (repo_id, change_id, path) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_risk(changeset: DataFrame, hot: DataFrame, fan_in: DataFrame, missing: DataFrame) -> DataFrame:
    """Changed files with hot rank, importers, missing partners and a risk level (JOIN-11).

    One signal is MEDIUM, two HIGH, three CRITICAL, none LOW.
    """
    absent = missing.groupBy("repo_id", "change_id", F.col("changed").alias("path")).agg(
        F.count(F.lit(1)).alias("n_missing")
    )
    joined = (
        changeset.select("repo_id", "change_id", "path")
        .join(hot.select("repo_id", "path", F.col("rank").alias("hot_rank")), ["repo_id", "path"], "left")
        .join(fan_in.select("repo_id", F.col("file").alias("path"), "fan_in"), ["repo_id", "path"], "left")
        .join(absent, ["repo_id", "change_id", "path"], "left")
    )
    zero = F.lit(0).cast("bigint")
    importers, partners = F.coalesce("fan_in", zero), F.coalesce("n_missing", zero)
    signals = F.col("hot_rank").isNotNull().cast("int") + (importers > 0).cast("int") + (partners > 0).cast("int")
    levels = F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")])
    return joined.select(
        "repo_id",
        "change_id",
        "path",
        "hot_rank",
        importers.alias("fan_in"),
        partners.alias("n_missing"),
        F.element_at(levels, signals + 1).alias("risk"),
    )


def critical_touches(changeset: DataFrame, hot: DataFrame) -> DataFrame:
    """Changed files that are in the hot list (JOIN-11)."""
    return changeset.join(hot.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
