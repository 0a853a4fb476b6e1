"""One row per repository: the fleet summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fleet_summary(
    commits: DataFrame,
    files: DataFrame,
    freq: DataFrame,
    languages: DataFrame,
    counts: DataFrame,
    scores: DataFrame,
) -> DataFrame:
    """Commits, contributors, language, files, pairs and score per repository (AGG-38)."""
    person = F.coalesce(F.nullif(F.col("email"), F.lit("")), F.col("author"))
    people = (
        commits.groupBy("repo_id", person.alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("committed_at").alias("last"))
        .groupBy("repo_id")
        .agg(F.sum("n").alias("commits"), F.count(F.lit(1)).alias("contributors"), F.max("last").alias("last_commit"))
    )
    tracked = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    hottest = freq.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("changed_files"),
        F.min_by("path", F.struct(-F.col("change_count"), "path")).alias("hottest_file"),
    )
    primary = languages.filter("is_primary").select("repo_id", F.col("language").alias("primary_language"))
    pairs = counts.groupBy("repo_id").agg(F.count(F.lit(1)).alias("pairs"))
    out = people
    for part in (tracked, hottest, primary, pairs, scores.select("repo_id", "total", "grade")):
        out = out.join(part, "repo_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("files", "changed_files", "pairs")})
