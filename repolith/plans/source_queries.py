"""Queries that write the views in the formats of the readers, and read them back; sinks that fail on the way."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith import schemas
from repolith.operators import history, incremental, score, structure
from repolith.plans import facts as fleet
from repolith.plans.history_queries import FREQ_SQL
from repolith.plans.registry import Inputs, query, stamp
from repolith.plans.state_queries import (
    ALL_VIEWS, GAP_SQL, QUESTION_SQL, SCORE_SQL, SPLIT, SUMMARY_SQL, TOTAL_SQL, _answers, _halves, _questions, _summary, _tables,
)
from repolith.session import ensure_checkpoint_dir, stage
from repolith.sources import exports, sinks
from repolith.sources.logsource import COMMIT_MARK, FIELD_MARK, file_system


def _folder(i: Inputs, name: str) -> str:
    return f"{ensure_checkpoint_dir(i.spark)}/{name}-{uuid.uuid4().hex}"


def _write_by_repository(rows: DataFrame, path: str) -> str:
    """One folder of text per repository; ``value`` is a line or more.

    A repository's rows meet before they are written, so there are as many files as repositories and not one for each
    of them and each task; those of a large repository are split by size. Tasks commit their own files.
    """
    together = rows.select("repo_id", "value").hint("rebalance", F.col("repo_id"))
    together.write.partitionBy("repo_id").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return path


def _log(i: Inputs) -> str:
    """The commits as an exported log. Every fiftieth has a date that is none, every seventieth too few fields."""
    line = F.concat_ws("\t", F.col("insertions").cast("string"), F.col("deletions").cast("string"), "path")
    stats = i.v_changes.groupBy("repo_id", "commit_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("stats"))
    commits = i.v_commits.join(stats, ["repo_id", "commit_id"], "left")
    date = F.when(F.col("commit_id") % 50 == 3, "yesterday").otherwise(F.concat(stamp("committed_at"), F.lit(" +0000")))
    parents = F.when(F.col("is_merge"), "p1 p2").otherwise("p1")
    id_ = F.col("commit_id").cast("string")
    whole = F.concat_ws(FIELD_MARK, id_, "author", "email", date, "subject", "body", parents)
    header = F.when(F.col("commit_id") % 70 == 4, F.concat(id_, F.lit(FIELD_MARK), "author")).otherwise(whole)
    value = F.concat(header, F.lit(f"{COMMIT_MARK}\n\n"), F.coalesce("stats", F.lit("")))
    return _write_by_repository(commits.select("repo_id", value.alias("value")), _folder(i, "log"))


@query("log_commits", ("v_commits",), """SELECT repo_id, CAST(commit_id AS VARCHAR) AS commit_id, author, email, subject, trim(body) AS body, is_merge,
    CASE WHEN commit_id % 50 <> 3 THEN strftime(committed_at, '%Y-%m-%d %H:%M:%S') END AS committed_at FROM v_commits WHERE commit_id % 70 <> 4""")
def log_commits(i: Inputs):
    """All commits, written as logs and read in splits of a few records."""
    commits, _ = exports.read_commit_log(i.spark, _log(i), split_bytes=1 << 16)
    return commits.select("repo_id", "commit_id", "author", "email", "subject", "body", "is_merge", stamp("committed_at").alias("committed_at"))


@query("log_changes", ("v_changes",), "SELECT repo_id, CAST(commit_id AS VARCHAR) AS commit_id, path, insertions, deletions FROM v_changes WHERE commit_id % 70 <> 4")
def log_changes(i: Inputs):
    _, changes = exports.read_commit_log(i.spark, _log(i), split_bytes=1 << 16)
    return changes.select("repo_id", "commit_id", "path", "insertions", "deletions")


@query("log_changes_text", ("v_changes",), "SELECT repo_id, CAST(commit_id AS VARCHAR) AS commit_id, path, insertions, deletions FROM v_changes WHERE commit_id % 70 <> 4")
def log_changes_text(i: Inputs):
    """The same by the text reader, which looks across split borders by a window."""
    _, changes = exports.read_commit_log(i.spark, _log(i), via="text")
    return changes.select("repo_id", "commit_id", "path", "insertions", "deletions")


@query("log_corrupt", ("v_commits",), """SELECT repo_id, CASE WHEN commit_id % 70 = 4 THEN 'fields' ELSE 'date' END AS reason, COUNT(*) AS n
  FROM v_commits WHERE commit_id % 50 = 3 OR commit_id % 70 = 4 GROUP BY ALL""")
def log_corrupt(i: Inputs):
    return exports.corrupt_log_records(i.spark, _log(i)).groupBy("repo_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("file_list", ("v_files",), "SELECT repo_id, path FROM v_files")
def file_list(i: Inputs):
    return exports.read_file_list(i.spark, _write_by_repository(i.v_files.select("repo_id", F.col("path").alias("value")), _folder(i, "lists")))


@query("file_contents", ("v_manifests",), "SELECT repo_id, path, text FROM v_manifests")
def file_contents(i: Inputs):
    """Manifests as files of their repositories, among files that are no text."""
    root = _folder(i, "contents")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(root)
        for part in parts:
            for repo, path, text in zip(part["repo_id"], part["path"], part["text"]):
                for name, data in ((path, text.encode()), (f"{path}.bin", b"\xff\xfe\x00")):
                    system.create_dir(f"{base}/{repo}/{name}".rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(f"{base}/{repo}/{name}") as out:
                        out.write(data)
            yield part[["repo_id"]]

    i.v_manifests.repartition(8, "repo_id", "path").mapInPandas(write, "repo_id STRING").write.format("noop").mode("overwrite").save()
    return exports.read_contents(i.spark, root)


@query("saved_state", ("v_answered",), """SELECT repo_id, CASE WHEN low % 2 = 0 THEN 'Keeps books' END AS project_description,
  CASE WHEN low > 3 THEN 'pytest' END AS testing_notes, CASE WHEN high > 20 THEN 1 ELSE 0 END AS n_answers FROM v_answered WHERE n_files % 3 <> 0""")
def saved_state(i: Inputs):
    """Answers as JSON lines, a third of them broken off."""
    answers = _answers(i).join(i.v_answered.select("repo_id", "n_files"), "repo_id")
    whole = F.to_json(F.struct(*[c for c in answers.columns if c != "n_files"]))
    path = _folder(i, "answers")
    text = answers.withColumn("x", whole).select(F.when(F.col("n_files") % 3 == 0, F.substring("x", 1, 20)).otherwise(F.col("x")).alias("value"))
    text.write.text(path)
    found = exports.read_state(i.spark, path, schemas.ANSWERS)
    n = F.when(F.col("domain_qa").isNull(), 0).otherwise(F.size("domain_qa"))
    return found.select("repo_id", "project_description", "testing_notes", n.alias("n_answers"))


# --- sinks ----------------------------------------------------------------------------------


@query("snapshot_versions", ("v_changes",), f"""{FREQ_SQL}, langs AS (SELECT repo_id, COUNT(*) AS n_files FROM freq GROUP BY repo_id)
  SELECT f.repo_id, f.path, f.change_count, l.n_files FROM freq f JOIN langs l ON l.repo_id = f.repo_id""")
def snapshot_versions(i: Inputs):
    """Two tables of a run, a run that breaks off after the first of them, and what is read then."""
    path = _folder(i, "snapshot")
    freq = history.file_frequency(i.v_changes)
    files = freq.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"))
    sinks.write_snapshot({"freq": freq, "files": files}, path, "run-1")
    broken = files.withColumn("n_files", F.when(F.col("repo_id") == "r0", F.raise_error(F.lit("lost"))).otherwise(F.col("n_files")))
    try:
        sinks.write_snapshot({"freq": freq.filter("repo_id <> 'r0'"), "files": broken}, path, "run-2")
    except PySparkException:
        pass
    else:
        raise AssertionError("the second run should break off")
    read = lambda name: sinks.read_snapshot(i.spark, path, name)
    return read("freq").join(read("files"), "repo_id").select("repo_id", "path", "change_count", "n_files")


@query("snapshot_runs", ("v_changes",), f"{FREQ_SQL} SELECT repo_id, path, change_count FROM freq")
def snapshot_runs(i: Inputs):
    """The log up to a day as one run; the next run adds the rest to what the first has left."""
    path = _folder(i, "runs")
    old, new = _halves(i.v_changes)
    sinks.write_snapshot({"freq": history.file_frequency(old)}, path, SPLIT)
    merged = incremental.merge_frequency(sinks.read_snapshot(i.spark, path, "freq"), history.file_frequency(new))
    sinks.write_snapshot({"freq": merged}, path, "end")
    return sinks.read_snapshot(i.spark, path, "freq", "end").select("repo_id", "path", "change_count")


@query("run_metadata", ALL_VIEWS, f"""{SUMMARY_SQL} SELECT repo_id, '1.2' AS version, '2024-02-01' AS last_updated, strftime(last_commit, '%Y-%m-%d %H:%M:%S') AS last_analyzed,
  commits AS commits_analyzed, coalesce(primary_language, 'Unknown') AS primary_language FROM summed""")
def run_metadata(i: Inputs):
    path = _folder(i, "meta")
    sinks.write_meta(_summary(i), path, "1.2", F.lit("2024-02-01"))
    return sinks.read_meta(i.spark, path).withColumn("last_analyzed", stamp("last_analyzed"))


def _report(i: Inputs) -> DataFrame:
    t = _tables(i)
    wide = stage(fleet.facts(t), "facts")
    scores = score.confidence_score(wide)
    path = _folder(i, "report")
    sinks.write_report(sinks.to_report_json(scores, score.score_total(scores), score.gaps(wide), _questions(i, t, wide)), path)
    return sinks.read_report(i.spark, path)


@query("report_scores", ALL_VIEWS, f"""{SCORE_SQL}, {TOTAL_SQL} SELECT s.repo_id, t.total, t.grade, s.pos, s.dimension, s.score, s.max FROM scores s JOIN totals t ON t.repo_id = s.repo_id""")
def report_scores(i: Inputs):
    """Scores as the written report has them."""
    return _report(i).select("repo_id", "total", "grade", F.inline("breakdown"))


@query("report_gaps", ALL_VIEWS, f"{SCORE_SQL}, {GAP_SQL} SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY key) AS BIGINT) AS nth, dimension, impact, question FROM gaps")
def report_gaps(i: Inputs):
    gaps = _report(i).select("repo_id", F.posexplode("gaps").alias("nth", "g"))
    return gaps.select("repo_id", (F.col("nth") + 1).cast("bigint").alias("nth"), "g.dimension", "g.impact", "g.question")


@query("report_questions", ALL_VIEWS, f"{QUESTION_SQL} SELECT repo_id, pos, category, question FROM smart")
def report_questions(i: Inputs):
    return _report(i).select("repo_id", F.inline("questions"))


@query("submodules", ("v_files",), """parts AS (SELECT repo_id, string_split(path, '/') AS p FROM v_files)
  SELECT DISTINCT repo_id, array_to_string(p[1:d], '/') AS path FROM (SELECT *, unnest(range(1, len(p))) AS d FROM parts) x WHERE d <= 3""")
def submodules(i: Inputs):
    """Directories of three levels, nested into a tree per top directory and laid flat again."""
    dirs = structure.explode_ancestors(i.v_files).select("repo_id", "dir").filter("dir <> ''").distinct()
    dirs = dirs.withColumn("depth", F.size(F.split("dir", "/"))).withColumn("parent", F.regexp_replace("dir", "/?[^/]*$", ""))
    tree = None
    for depth in (3, 2, 1):
        level = dirs.filter(F.col("depth") == depth).select("repo_id", "parent", F.col("dir").alias("path"))
        if tree is not None:
            below = tree.groupBy("repo_id", F.col("parent").alias("path")).agg(F.collect_list(F.struct(*[c for c in tree.columns if c not in ("repo_id", "parent")])).alias("children"))
            level = level.join(below, ["repo_id", "path"], "left")
        tree = level
    return structure.flatten_modules(tree.drop("parent"))
