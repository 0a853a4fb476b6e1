"""Commit-log analytics: change counts, churn, people, commit habits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv
from repolith.functions.ranking import collect_ranked, newest_first, recency, top_k


def commit_totals(changes: DataFrame) -> DataFrame:
    """Files, insertions and deletions per commit (AGG-01)."""
    return changes.groupBy("repo_id", "commit_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
    )


def project_commits(commits: DataFrame) -> DataFrame:
    """Short sha and full message beside the commit columns (PRJ-03)."""
    return commits.withColumns(
        {
            "short_sha": C.short_sha(F.col("commit_id").cast("string")),
            "message": C.commit_message("subject", "body"),
        }
    )


def file_frequency(changes: DataFrame) -> DataFrame:
    """Commits that touched each path and the date of the newest one (AGG-02, WIN-01)."""
    return changes.groupBy("repo_id", "path").agg(
        F.count(F.lit(1)).alias("change_count"), F.max("committed_at").alias("last_changed")
    )


def hot_files(changes: DataFrame, k: int = 50) -> DataFrame:
    """Most changed paths of every repository (TOP-01)."""
    return top_k(file_frequency(changes), k, ["repo_id"], [F.desc("change_count"), F.asc("path")])


def newest_commits(commits: DataFrame, newest: int | None) -> DataFrame:
    """The newest commits per repository by log order; all of them when ``newest`` is None."""
    if newest is None:
        return commits
    return top_k(commits, newest, ["repo_id"], newest_first(), rank="_seq").drop("_seq")


def _changes_of_newest(changes: DataFrame, newest: int | None) -> DataFrame:
    if newest is None:
        return changes
    heads = changes.groupBy("repo_id", "commit_id").agg(F.max("committed_at").alias("committed_at"))
    keep = newest_commits(heads, newest).select("repo_id", "commit_id")
    return changes.join(keep, ["repo_id", "commit_id"], "left_semi")


def file_churn(changes: DataFrame, newest: int | None = None) -> DataFrame:
    """Lines added plus removed per path, over the newest commits where ``newest`` says so (AGG-25)."""
    return (
        _changes_of_newest(changes, newest)
        .groupBy("repo_id", "path")
        .agg(F.sum(F.col("insertions") + F.col("deletions")).alias("churn"))
    )


def _person() -> F.Column:
    return F.coalesce(F.nullif(F.col("email"), F.lit("")), F.col("author"))


def contributors(commits: DataFrame) -> DataFrame:
    """Commits, first and last day, newest name per person (AGG-04)."""
    return (
        commits.withColumn("key", _person())
        .groupBy("repo_id", "key")
        .agg(
            F.max_by("author", recency()).alias("name"),
            F.max_by("email", recency()).alias("email"),
            F.count(F.lit(1)).alias("commits"),
            F.min("committed_at").alias("first_seen"),
            F.max("committed_at").alias("last_seen"),
        )
    )


def contributor_areas(commits: DataFrame, changes: DataFrame, k: int = 5) -> DataFrame:
    """Top first-path segments per person by touches (AGG-05).

    Touches are counted per (commit, area) before the join, so a commit with millions of paths
    crosses the network as a few rows.
    """
    touches = (
        changes.withColumn("area", F.element_at(F.split("path", "/"), 1))
        .filter("area <> ''")
        .groupBy("repo_id", "commit_id", "area")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    people = commits.select("repo_id", "commit_id", _person().alias("key"))
    per_person = (
        touches.join(people, ["repo_id", "commit_id"])
        .groupBy("repo_id", "key", "area")
        .agg(F.sum("n").alias("n"))
    )
    ranked = top_k(per_person, k, ["repo_id", "key"], [F.desc("n"), F.asc("area")])
    return ranked.groupBy("repo_id", "key").agg(collect_ranked("rank", "area").alias("areas"))


def owners(commits: DataFrame) -> DataFrame:
    """Non-merge commits per author (AGG-26)."""
    return commits.filter(~F.col("is_merge")).groupBy("repo_id", "author").agg(F.count(F.lit(1)).alias("n"))


def recurring_subjects(commits: DataFrame, newest: int | None = None) -> DataFrame:
    """How often each subject occurs, among the newest commits where ``newest`` says so (AGG-24)."""
    return newest_commits(commits, newest).groupBy("repo_id", "subject").agg(F.count(F.lit(1)).alias("n"))


def flagged_commits(commits: DataFrame, regex: str = fv.FLAGGED_SUBJECT, k: int = 20) -> DataFrame:
    """Newest commits whose subject matches, e.g. breaking changes (AGG-28)."""
    hits = commits.filter(F.col("subject").rlike(regex))
    return top_k(hits, k, ["repo_id"], newest_first()).select("repo_id", "commit_id", "subject", "rank")


def commit_batches(commits: DataFrame, size: int = 20, newest: int | None = None) -> DataFrame:
    """Review batches of non-merge commits, newest first; of the ``newest`` only if given (WIN-07).

    All commits of a repository are numbered without one window over them: commits are counted by the
    hour, the counts are summed up, and only the commits of an hour are put in order.
    """
    plain = commits.filter(~F.col("is_merge"))
    if newest is not None:
        ranked = top_k(plain, newest, ["repo_id"], newest_first())
    else:
        hours = plain.withColumn("_hour", F.date_trunc("hour", "committed_at"))
        later = Window.partitionBy("repo_id").orderBy(F.col("_hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
        counts = hours.groupBy("repo_id", "_hour").agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.select(F.col("repo_id").alias("_repo"), F.col("_hour").alias("_at"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))
        inside = F.row_number().over(Window.partitionBy("repo_id", "_hour").orderBy(*newest_first()))
        ranked = hours.withColumn("_inside", inside).join(counts, (F.col("repo_id") == F.col("_repo")) & F.col("_hour").eqNullSafe(F.col("_at")))
        ranked = ranked.withColumn("rank", F.col("_before") + F.col("_inside"))
    return ranked.select(
        "repo_id", "commit_id", F.floor((F.col("rank") - 1) / F.lit(size)).cast("bigint").alias("batch")
    )


def added_deleted(changes: DataFrame, files: DataFrame, newest: int | None = None) -> DataFrame:
    """First ('added') and last ('deleted') appearance of paths, among the ``newest`` commits if given (AGG-27).

    A path counts as deleted when it is no longer tracked.
    """
    spans = changes.groupBy("repo_id", "path").agg(
        F.min(recency()).alias("first"), F.max(recency()).alias("last")
    )
    tracked = files.select("repo_id", "path", F.lit(True).alias("tracked"))
    spans = spans.join(tracked, ["repo_id", "path"], "left")
    events = spans.select(
        "repo_id",
        "path",
        F.explode(
            F.array(
                F.struct(F.lit("added").alias("event"), F.col("first").alias("at")),
                F.struct(
                    F.when(F.col("tracked").isNull(), "deleted").alias("event"), F.col("last").alias("at")
                ),
            )
        ).alias("e"),
    ).filter("e.event IS NOT NULL")
    out = events.select(
        "repo_id",
        "path",
        F.col("e.event").alias("event"),
        F.col("e.at.commit_id").alias("commit_id"),
        F.col("e.at.committed_at").alias("committed_at"),
    )
    if newest is None:
        return out
    heads = changes.groupBy("repo_id", "commit_id").agg(F.max("committed_at").alias("committed_at"))
    keep = newest_commits(heads, newest).select("repo_id", "commit_id")
    return out.join(keep, ["repo_id", "commit_id"], "left_semi")


def file_evolution(changes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Earliest and latest commit and net growth per path (WIN-08)."""
    if paths is not None:
        changes = changes.join(paths.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    return changes.groupBy("repo_id", "path").agg(
        F.min_by("commit_id", recency()).alias("first_commit"),
        F.max_by("commit_id", recency()).alias("last_commit"),
        F.sum(F.col("insertions") - F.col("deletions")).alias("net_lines"),
    )


def _dominant(df: DataFrame, label: str, rules: list[str], total: DataFrame, examples: DataFrame) -> DataFrame:
    """Largest class per repository, its share of ``total`` and its first examples."""
    order = F.array_position(F.array(*[F.lit(r) for r in rules]), F.col(label))
    best = top_k(df.withColumn("_order", order), 1, ["repo_id"], [F.desc("n"), F.asc("_order")], rank="_r")
    return (
        best.join(total, "repo_id")
        .join(examples, ["repo_id", label], "left")
        .select(
            "repo_id",
            F.col(label).alias("pattern"),
            "n",
            (F.col("n") / F.col("total")).alias("confidence"),
            "examples",
        )
    )


def dominant_commit_style(commits: DataFrame, k: int = 3) -> DataFrame:
    """Most frequent commit style, its share, and the newest examples (AGG-07, WIN-03)."""
    styled = commits.withColumn("style", C.commit_style("subject"))
    counts = styled.groupBy("repo_id", "style").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("repo_id").agg(F.sum("n").alias("total"))
    examples = (
        top_k(styled, k, ["repo_id", "style"], newest_first())
        .groupBy("repo_id", "style")
        .agg(collect_ranked("rank", "subject").alias("examples"))
    )
    return _dominant(counts, "style", [s for s, _ in fv.COMMIT_STYLES], total, examples)


def dominant_naming(changes: DataFrame, k: int = 3) -> DataFrame:
    """Most frequent file-naming style over touches of source files (AGG-08)."""
    touched = changes.filter(C.is_naming_source("path")).withColumn("style", C.naming_style("path"))
    counts = touched.groupBy("repo_id", "style").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("repo_id").agg(F.sum("n").alias("total"))
    named = touched.filter("style IS NOT NULL")
    examples = (
        top_k(named, k, ["repo_id", "style"], [*newest_first(), F.asc("path")])
        .groupBy("repo_id", "style")
        .agg(collect_ranked("rank", "path").alias("examples"))
    )
    counts = counts.filter("style IS NOT NULL")
    return _dominant(counts, "style", [s for s, _ in fv.NAMING_STYLES], total, examples)


def commit_patterns(commits: DataFrame, newest: int | None = None, legacy: bool = False) -> DataFrame:
    """Style, merge strategy, branch names, examples and commits per pull request (AGG-18).

    The branch is the text after the owner in "from owner/branch"; ``legacy`` keeps only the
    part after the last slash.
    """
    recent = newest_commits(commits, newest)
    merge = F.col("is_merge")
    subject = F.col("subject")
    greedy = r"from \S+/(\S+)" if legacy else r"from [^\s/]+/(\S+)"
    branch = F.when(merge, F.nullif(F.regexp_extract(subject, greedy, 1), F.lit("")))
    facts = recent.groupBy("repo_id").agg(
        F.count_if(~merge).alias("n_plain"),
        F.count_if(merge & F.contains(subject, F.lit("(#")) & ~subject.startswith("Merge")).alias("squash"),
        F.count_if(merge & subject.startswith("Merge pull request")).alias("merged"),
        F.count_if(~merge & subject.rlike(fv.CONVENTIONAL_STRICT)).alias("conventional"),
        F.count_if(~merge & subject.rlike(fv.JIRA_STRICT)).alias("jira"),
        F.count_if(merge & subject.rlike(r"#\d+")).alias("n_prs"),
        F.count(branch).alias("n_branches"),
        F.bool_or(branch.startswith("dev_") | F.contains(branch, F.lit("/dev_"))).alias("dev"),
        F.bool_or(F.contains(branch, F.lit("feature/"))).alias("feature"),
    )
    branches = (
        top_k(
            recent.withColumn("branch", branch).filter("branch IS NOT NULL"), 3, ["repo_id"], newest_first()
        )
        .groupBy("repo_id")
        .agg(F.array_join(collect_ranked("rank", "branch"), ", ").alias("names"))
    )
    examples = (
        top_k(
            recent.filter(~merge & C.is_meaningful_subject("subject")), 5, ["repo_id"], newest_first()
        )
        .groupBy("repo_id")
        .agg(collect_ranked("rank", "subject").alias("examples"))
    )
    style = (
        F.when(F.col("conventional") > F.col("n_plain") * 0.5, "conventional-commits")
        .when(F.col("jira") > F.col("n_plain") * 0.3, "jira-prefixed")
        .otherwise("free-form")
    )
    strategy = (
        F.when(F.col("squash") > F.col("merged"), "squash-merge")
        .when(F.col("merged") > 0, "merge-commit")
        .otherwise("unknown")
    )
    pattern = (
        F.when(F.col("n_branches") == 0, "")
        .when(F.col("feature") & F.col("dev"), "feature/dev_<author>/<description> or feature/<description>")
        .when(F.col("feature"), "feature/<description>")
        .otherwise(F.col("names"))
    )
    return (
        facts.join(branches, "repo_id", "left")
        .join(examples, "repo_id", "left")
        .select(
            "repo_id",
            style.alias("style"),
            strategy.alias("merge_strategy"),
            pattern.alias("branch_pattern"),
            F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
            F.when(F.col("n_prs") > 0, C.js_round(F.col("n_plain") / F.col("n_prs")))
            .otherwise(F.lit(0).cast("bigint"))
            .alias("avg_commits_per_pr"),
        )
    )


def commits_since(commits: DataFrame, marks: DataFrame, stale_after: int = fv.STALE_COMMITS) -> DataFrame:
    """Non-merge commits after the last documentation update, and whether that is stale (AGG-22)."""
    # one row per commit second first: the join on repo_id then carries no raw rows
    per_time = (
        commits.filter(~F.col("is_merge"))
        .groupBy("repo_id", "committed_at")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    newer = (
        per_time.join(marks.select("repo_id", "last_updated"), "repo_id")
        .filter(F.col("committed_at") > F.col("last_updated"))
        .groupBy("repo_id")
        .agg(F.sum("n").alias("n_commits"))
    )
    counted = F.coalesce("n_commits", F.lit(0).cast("bigint"))
    return marks.join(newer, "repo_id", "left").select(
        "repo_id", counted.alias("n_commits"), (counted > stale_after).alias("stale")
    )
