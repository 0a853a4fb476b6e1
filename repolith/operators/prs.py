"""Pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions import columns as C


def flatten_prs(raw: DataFrame) -> DataFrame:
    """Nested pull-request records to flat rows (SRC-04): null parts become empty, reviewers distinct, one row per number."""
    empty = F.array().cast("array<string>")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    files = F.coalesce(F.transform("files", lambda f: F.coalesce(f["path"], F.lit(""))), empty)
    labels = F.coalesce(F.transform("labels", lambda x: F.coalesce(x["name"], F.lit(""))), empty)
    logins = F.coalesce(F.transform("reviews", lambda r: r["author"]["login"]), empty)
    flat = raw.select(
        "repo_id",
        "number",
        text("title").alias("title"),
        text("body").alias("description"),
        F.coalesce(F.col("author.login"), F.lit("")).alias("author"),
        F.try_to_timestamp("mergedAt").cast("timestamp_ntz").alias("merged_at"),
        text("baseRefName").alias("base_branch"),
        labels.alias("labels"),
        files.alias("files"),
        F.coalesce("additions", F.lit(0)).alias("lines_added"),
        F.coalesce("deletions", F.lit(0)).alias("lines_removed"),
        F.array_distinct(F.filter(logins, lambda r: r.isNotNull() & (r != ""))).alias("reviewers"),
        F.coalesce(F.size("comments"), F.lit(0)).cast("bigint").alias("comment_count"),
    )
    return flat.withColumns(
        {"topics": C.pr_topics("title", "labels"), "has_tests": C.has_test_file("files")}
    ).dropDuplicates(["repo_id", "number"])


def pr_tags(prs: DataFrame) -> DataFrame:
    """One row per pull request and topic (PRJ-10)."""
    return prs.select("repo_id", "number", F.explode("topics").alias("topic"))


def pr_summary(prs: DataFrame, by: str = "author") -> DataFrame:
    """Pull requests, files, lines and tests per author or topic (AGG-23)."""
    rows = prs.withColumn(by, F.explode("topics")) if by == "topic" else prs
    return rows.groupBy("repo_id", by).agg(
        F.count(F.lit(1)).alias("n_prs"),
        F.sum(F.size("files")).alias("files"),
        F.sum("lines_added").alias("added"),
        F.sum("lines_removed").alias("removed"),
        F.count_if("has_tests").alias("with_tests"),
    )
