"""Writers: versioned snapshots, run metadata, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.sources.versions import Versions


def write_snapshot(frames: dict[str, DataFrame], path: str, run_id: str) -> int:
    """State tables of one run as a new version, visible together or not at all (SNK-01).

    A later run of the same id is the one that reads find; a run that fails leaves what was there.
    """
    spark = next(iter(frames.values())).sparkSession
    return Versions(spark, path).commit(frames, run_id=run_id)


def read_snapshot(spark: SparkSession, path: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of the newest version, or of the newest of one run."""
    return Versions(spark, path).read(name, **({} if run_id is None else {"run_id": run_id}))


def run_metadata(summary: DataFrame, version: str, now: Column) -> DataFrame:
    """Version, time, head and counts per repository (SNK-02)."""
    return summary.select(
        "repo_id",
        F.lit(version).alias("version"),
        now.alias("last_updated"),
        F.col("last_commit").alias("last_analyzed"),
        F.col("commits").alias("commits_analyzed"),
        F.coalesce("primary_language", F.lit("Unknown")).alias("primary_language"),
    )


def write_meta(summary: DataFrame, path: str, version: str, now: Column) -> int:
    return Versions(summary.sparkSession, path).commit({"meta": run_metadata(summary, version, now)})


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of the last run that ended well."""
    return Versions(spark, path).read("meta")


def to_report_json(scores: DataFrame, totals: DataFrame, gaps: DataFrame, questions: DataFrame) -> DataFrame:
    """Score, breakdown, gaps and questions of a repository as one JSON text (SNK-04).

    The collected lists are short: six dimensions, nine gaps, the capped questions.
    """
    listed = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    parts = [
        scores.groupBy("repo_id").agg(listed("pos", "dimension", "score", "max").alias("breakdown")),
        gaps.groupBy("repo_id").agg(listed("pos", "dimension", "impact", "question").alias("gaps")),
        questions.groupBy("repo_id").agg(listed("pos", "category", "question").alias("questions")),
    ]
    out = totals
    for part in parts:
        out = out.join(part, "repo_id", "left")
    return out.select(
        "repo_id", F.to_json(F.struct("total", "grade", "breakdown", "gaps", "questions")).alias("report")
    )


REPORT = """total BIGINT, grade STRING, breakdown ARRAY<STRUCT<pos: BIGINT, dimension: STRING, score: BIGINT, max: BIGINT>>,
  gaps ARRAY<STRUCT<pos: BIGINT, dimension: STRING, impact: STRING, question: STRING>>,
  questions ARRAY<STRUCT<pos: BIGINT, category: STRING, question: STRING>>"""


def write_report(report: DataFrame, path: str) -> int:
    return Versions(report.sparkSession, path).commit({"report": report})


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Reports of the last run that ended well, their JSON taken apart."""
    parsed = F.from_json("report", REPORT)
    return Versions(spark, path).read("report").select("repo_id", parsed.alias("r")).select("repo_id", "r.*")
