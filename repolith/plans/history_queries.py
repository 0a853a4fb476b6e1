"""Queries over commits and changes."""

from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv
from repolith.operators import cochange, history, incremental, review
from repolith.plans.registry import Inputs, query, stamp, text
from repolith.session import stage
from repolith.sources.exports import parse_numstat

STYLE_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(subject, '{p}') THEN '{n}'" for n, p in fv.COMMIT_STYLES if p
) + " ELSE 'free' END"
STYLE_ORDER = "CASE style " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(fv.COMMIT_STYLES)) + " END"
EXT_SQL = r"regexp_extract(path, '[^/](\.[^./]*)$', 1)"
STEM_SQL = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')"
NAMING_SQL = "CASE " + " ".join(f"WHEN regexp_matches({STEM_SQL}, '{p}') THEN '{n}'" for n, p in fv.NAMING_STYLES) + " END"
NAMING_ORDER = "CASE style " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(fv.NAMING_STYLES)) + " END"
NAMING_EXTS = ", ".join(f"'{e}'" for e in fv.NAMING_EXTENSIONS)
FREQ_SQL = "freq AS (SELECT repo_id, path, COUNT(*) AS change_count, MAX(committed_at) AS last_changed FROM v_changes GROUP BY repo_id, path)"
HOT_SQL = f"""{FREQ_SQL}, hot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY change_count DESC, path) AS rank
  FROM freq) t WHERE rank <= 50)"""
HEADS_SQL = """heads AS (SELECT repo_id, commit_id, row_number() OVER (PARTITION BY repo_id ORDER BY MAX(committed_at) DESC, commit_id DESC) AS seq
  FROM v_changes GROUP BY repo_id, commit_id)"""
COUNTS_SQL = """counts AS (SELECT a.repo_id, a.path AS file_a, b.path AS file_b, COUNT(*) AS n FROM v_changes a
  JOIN v_changes b ON a.repo_id = b.repo_id AND a.commit_id = b.commit_id AND a.path < b.path
  GROUP BY a.repo_id, a.path, b.path HAVING COUNT(*) >= 3)"""
PAIRS_SQL = f"""{FREQ_SQL}, {COUNTS_SQL}, pairs AS (SELECT c.*, CAST(c.n AS DOUBLE) / least(coalesce(fa.change_count, 1), coalesce(fb.change_count, 1)) AS strength
  FROM counts c LEFT JOIN freq fa ON fa.repo_id = c.repo_id AND fa.path = c.file_a
  LEFT JOIN freq fb ON fb.repo_id = c.repo_id AND fb.path = c.file_b)"""
RANKED_PAIRS_SQL = f"""{PAIRS_SQL}, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id
  ORDER BY strength DESC, n DESC, file_a, file_b) AS rank FROM pairs) t WHERE rank <= 20)"""
KEY_SQL = "CASE WHEN email = '' THEN author ELSE email END"
MISSING_SQL = f"""{PAIRS_SQL}, partners AS (SELECT repo_id, file_a AS path, file_b AS missing, n, strength FROM pairs
    UNION ALL SELECT repo_id, file_b, file_a, n, strength FROM pairs),
  absent AS (SELECT c.repo_id, c.change_id, c.path AS changed, p.missing, p.n, p.strength FROM v_changeset c
    JOIN partners p ON p.repo_id = c.repo_id AND p.path = c.path
    LEFT JOIN v_changeset x ON x.repo_id = c.repo_id AND x.change_id = c.change_id AND x.path = p.missing WHERE x.path IS NULL)"""


def _stamp(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"


@query("hot_files", ("v_changes",), f"{HOT_SQL} SELECT repo_id, path, change_count, {_stamp('last_changed')} AS last_changed, rank FROM hot")
def hot_files(i: Inputs):
    return history.hot_files(i.v_changes).withColumn("last_changed", stamp("last_changed"))


@query("last_changed", ("v_changes",), f"{FREQ_SQL} SELECT repo_id, path, change_count, {_stamp('last_changed')} AS last_changed FROM freq")
def last_changed(i: Inputs):
    return history.file_frequency(i.v_changes).withColumn("last_changed", stamp("last_changed"))


@query("commit_totals", ("v_changes",), """SELECT repo_id, commit_id, COUNT(*) AS n_files, CAST(SUM(insertions) AS BIGINT) AS insertions,
  CAST(SUM(deletions) AS BIGINT) AS deletions FROM v_changes GROUP BY repo_id, commit_id""")
def commit_totals(i: Inputs):
    return history.commit_totals(i.v_changes)


@query("commit_projection", ("v_commits",), """SELECT repo_id, commit_id, left(CAST(commit_id AS VARCHAR), 7) AS short_sha,
  CASE WHEN body = '' THEN subject ELSE concat(subject, chr(10), chr(10), body) END AS message, is_merge FROM v_commits""")
def commit_projection(i: Inputs):
    return history.project_commits(i.v_commits).select("repo_id", "commit_id", "short_sha", "message", "is_merge")


@query("file_churn_newest", ("v_changes",), f"""{HEADS_SQL} SELECT c.repo_id, c.path, CAST(SUM(insertions + deletions) AS BIGINT) AS churn
  FROM v_changes c JOIN heads h ON h.repo_id = c.repo_id AND h.commit_id = c.commit_id AND h.seq <= 50 GROUP BY c.repo_id, c.path""")
def file_churn_newest(i: Inputs):
    return history.file_churn(i.v_changes, newest=50)


CHURN_SQL = "SELECT repo_id, path, CAST(SUM(insertions + deletions) AS BIGINT) AS churn FROM v_changes GROUP BY repo_id, path"


@query("file_churn", ("v_changes",), CHURN_SQL)
def file_churn(i: Inputs):
    return history.file_churn(i.v_changes)


@query("file_churn_all", ("v_changes",), CHURN_SQL)
def file_churn_all(i: Inputs):
    return history.file_churn(i.v_changes, newest=None)


@query("contributors", ("v_commits",), f"""SELECT repo_id, {KEY_SQL} AS key, max_by(author, row(committed_at, commit_id)) AS name,
  max_by(email, row(committed_at, commit_id)) AS email, COUNT(*) AS commits, {_stamp('MIN(committed_at)')} AS first_seen,
  {_stamp('MAX(committed_at)')} AS last_seen FROM v_commits GROUP BY repo_id, {KEY_SQL}""")
def contributors(i: Inputs):
    return history.contributors(i.v_commits).withColumns({c: stamp(c) for c in ("first_seen", "last_seen")})


@query("contributor_areas", ("v_commits", "v_changes"), f"""people AS (SELECT repo_id, commit_id, {KEY_SQL} AS key FROM v_commits),
  touched AS (SELECT p.repo_id, p.key, split_part(c.path, '/', 1) AS area, COUNT(*) AS n FROM v_changes c
    JOIN people p ON p.repo_id = c.repo_id AND p.commit_id = c.commit_id GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, key ORDER BY n DESC, area) AS r FROM touched)
  SELECT repo_id, key, string_agg(area, '|' ORDER BY r) AS areas FROM ranked WHERE r <= 5 GROUP BY repo_id, key""")
def contributor_areas(i: Inputs):
    return history.contributor_areas(i.v_commits, i.v_changes).withColumn("areas", text("areas"))


@query("non_merge_owners", ("v_commits",), "SELECT repo_id, author, COUNT(*) AS n FROM v_commits WHERE NOT is_merge GROUP BY repo_id, author")
def non_merge_owners(i: Inputs):
    return history.owners(i.v_commits)


@query("recurring_subjects", ("v_commits",), "SELECT repo_id, subject, COUNT(*) AS n FROM v_commits GROUP BY repo_id, subject")
def recurring_subjects(i: Inputs):
    return history.recurring_subjects(i.v_commits)


@query("recurring_subjects_newest", ("v_commits",), """r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, commit_id DESC) AS seq
  FROM v_commits) SELECT repo_id, subject, COUNT(*) AS n FROM r WHERE seq <= 50 GROUP BY repo_id, subject""")
def recurring_subjects_newest(i: Inputs):
    return history.recurring_subjects(i.v_commits, newest=50)


@query("breaking_commits", ("v_commits",), """r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, commit_id DESC) AS rank
  FROM v_commits WHERE regexp_matches(subject, 'breaking|migrate|deprecat')) SELECT repo_id, commit_id, subject, rank FROM r WHERE rank <= 20""")
def breaking_commits(i: Inputs):
    return history.flagged_commits(i.v_commits)


@query("commit_batches", ("v_commits",), """r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, commit_id DESC) AS k
  FROM v_commits WHERE NOT is_merge) SELECT repo_id, commit_id, CAST(floor((k - 1) / 20.0) AS BIGINT) AS batch FROM r""")
def commit_batches(i: Inputs):
    return history.commit_batches(i.v_commits)


@query("commit_batches_newest", ("v_commits",), """r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, commit_id DESC) AS k
  FROM v_commits WHERE NOT is_merge) SELECT repo_id, commit_id, CAST(floor((k - 1) / 20.0) AS BIGINT) AS batch FROM r WHERE k <= 400""")
def commit_batches_newest(i: Inputs):
    return history.commit_batches(i.v_commits, newest=400)


EVENTS_SQL = """spans AS (SELECT repo_id, path,
    arg_min(commit_id, row(committed_at, commit_id)) AS f, arg_max(commit_id, row(committed_at, commit_id)) AS l FROM v_changes GROUP BY repo_id, path),
  ev AS (SELECT repo_id, path, 'added' AS event, f AS commit_id FROM spans
    UNION ALL SELECT s.repo_id, s.path, 'deleted', s.l FROM spans s LEFT JOIN v_files t ON t.repo_id = s.repo_id AND t.path = s.path WHERE t.path IS NULL)"""


@query("added_deleted", ("v_changes", "v_files"), f"{EVENTS_SQL} SELECT repo_id, path, event, commit_id FROM ev")
def added_deleted(i: Inputs):
    return history.added_deleted(i.v_changes, i.v_files).select("repo_id", "path", "event", "commit_id")


@query("added_deleted_newest", ("v_changes", "v_files"), f"""{HEADS_SQL}, {EVENTS_SQL}
  SELECT e.repo_id, e.path, e.event, e.commit_id FROM ev e JOIN heads h ON h.repo_id = e.repo_id AND h.commit_id = e.commit_id AND h.seq <= 50""")
def added_deleted_newest(i: Inputs):
    return history.added_deleted(i.v_changes, i.v_files, newest=50).select("repo_id", "path", "event", "commit_id")


@query("file_evolution", ("v_changes",), """SELECT repo_id, path, arg_min(commit_id, row(committed_at, commit_id)) AS first_commit,
  arg_max(commit_id, row(committed_at, commit_id)) AS last_commit, CAST(SUM(insertions - deletions) AS BIGINT) AS net_lines FROM v_changes GROUP BY repo_id, path""")
def file_evolution(i: Inputs):
    return history.file_evolution(i.v_changes)


@query("commit_style_counts", ("v_commits",), f"SELECT repo_id, {STYLE_SQL} AS style, COUNT(*) AS n FROM v_commits GROUP BY ALL")
def commit_style_counts(i: Inputs):
    return i.v_commits.groupBy("repo_id", C.commit_style("subject").alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("commit_style", ("v_commits",), f"""s AS (SELECT *, {STYLE_SQL} AS style FROM v_commits),
  e AS (SELECT repo_id, style, subject, row_number() OVER (PARTITION BY repo_id, style ORDER BY committed_at DESC, commit_id DESC) AS r FROM s),
  n AS (SELECT repo_id, style, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY repo_id) AS total,
    row_number() OVER (PARTITION BY repo_id ORDER BY COUNT(*) DESC, {STYLE_ORDER}) AS b FROM s GROUP BY repo_id, style)
  SELECT n.repo_id, n.style AS pattern, n.n, CAST(n.n AS DOUBLE) / CAST(n.total AS DOUBLE) AS confidence, string_agg(e.subject, '|' ORDER BY e.r) AS examples
  FROM n JOIN e ON e.repo_id = n.repo_id AND e.style = n.style AND e.r <= 3 WHERE n.b = 1 GROUP BY ALL""")
def commit_style(i: Inputs):
    return history.dominant_commit_style(i.v_commits).withColumn("examples", text("examples"))


@query("naming_style", ("v_changes",), f"""s AS (SELECT repo_id, path, committed_at, commit_id, {NAMING_SQL} AS style FROM v_changes WHERE {EXT_SQL} IN ({NAMING_EXTS})),
  e AS (SELECT repo_id, style, path, row_number() OVER (PARTITION BY repo_id, style ORDER BY committed_at DESC, commit_id DESC, path) AS r FROM s WHERE style IS NOT NULL),
  t AS (SELECT repo_id, COUNT(*) AS total FROM s GROUP BY repo_id),
  n AS (SELECT repo_id, style, COUNT(*) AS n, row_number() OVER (PARTITION BY repo_id ORDER BY COUNT(*) DESC, {NAMING_ORDER}) AS b FROM s WHERE style IS NOT NULL GROUP BY repo_id, style)
  SELECT n.repo_id, n.style AS pattern, n.n, CAST(n.n AS DOUBLE) / t.total AS confidence, string_agg(e.path, '|' ORDER BY e.r) AS examples
  FROM n JOIN t ON t.repo_id = n.repo_id JOIN e ON e.repo_id = n.repo_id AND e.style = n.style AND e.r <= 3 WHERE n.b = 1 GROUP BY ALL""")
def naming_style(i: Inputs):
    return history.dominant_naming(i.v_changes).withColumn("examples", text("examples"))


PATTERNS_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, commit_id DESC) AS seq FROM v_commits),
  c AS (SELECT *, CASE WHEN is_merge THEN nullif(regexp_extract(subject, 'from [^\\s/]+/(\\S+)', 1), '') END AS branch FROM r),
  f AS (SELECT repo_id, count_if(NOT is_merge) AS np, count_if(is_merge AND contains(subject, '(#') AND NOT starts_with(subject, 'Merge')) AS sq,
    count_if(is_merge AND starts_with(subject, 'Merge pull request')) AS mg,
    count_if(NOT is_merge AND regexp_matches(subject, '^(feat|fix|docs|refactor|test|chore)\\(')) AS cv,
    count_if(NOT is_merge AND regexp_matches(subject, '^[A-Z]{2,}-\\d+')) AS jr,
    count_if(is_merge AND regexp_matches(subject, '#\\d+')) AS pr, COUNT(branch) AS nb,
    bool_or(starts_with(branch, 'dev_') OR contains(branch, '/dev_')) AS dev, bool_or(contains(branch, 'feature/')) AS feature FROM c GROUP BY repo_id),
  b AS (SELECT repo_id, string_agg(branch, ', ' ORDER BY k) AS names FROM (SELECT repo_id, branch, row_number() OVER (PARTITION BY repo_id ORDER BY seq) AS k
    FROM c WHERE branch IS NOT NULL) x WHERE k <= 3 GROUP BY repo_id),
  e AS (SELECT repo_id, string_agg(subject, '|' ORDER BY k) AS examples FROM (SELECT repo_id, subject, row_number() OVER (PARTITION BY repo_id ORDER BY seq) AS k
    FROM c WHERE NOT is_merge AND length(subject) > 10 AND NOT regexp_matches(trim(subject), '^(?i)(fix|changes|logs|merge|fx)$')) x WHERE k <= 5 GROUP BY repo_id),
  cp AS (SELECT f.repo_id, CASE WHEN cv > np * 0.5 THEN 'conventional-commits' WHEN jr > np * 0.3 THEN 'jira-prefixed' ELSE 'free-form' END AS style,
    CASE WHEN sq > mg THEN 'squash-merge' WHEN mg > 0 THEN 'merge-commit' ELSE 'unknown' END AS merge_strategy,
    CASE WHEN nb = 0 THEN '' WHEN feature AND dev THEN 'feature/dev_<author>/<description> or feature/<description>'
      WHEN feature THEN 'feature/<description>' ELSE names END AS branch_pattern,
    coalesce(examples, '') AS examples, CAST(CASE WHEN pr > 0 THEN floor(CAST(np AS DOUBLE) / pr + 0.5) ELSE 0 END AS BIGINT) AS avg_commits_per_pr
  FROM f LEFT JOIN b ON b.repo_id = f.repo_id LEFT JOIN e ON e.repo_id = f.repo_id)"""


@query("commit_patterns", ("v_commits",), f"{PATTERNS_SQL} SELECT * FROM cp")
def commit_patterns(i: Inputs):
    return history.commit_patterns(i.v_commits).withColumn("examples", text("examples"))


SINCE_SQL = """since AS (SELECT m.repo_id, COUNT(c.commit_id) AS n_commits, COUNT(c.commit_id) > 10 AS stale FROM v_marks m
  LEFT JOIN v_commits c ON c.repo_id = m.repo_id AND NOT c.is_merge AND c.committed_at > m.last_updated GROUP BY m.repo_id)"""
CHANGED_SQL = """changed AS (SELECT DISTINCT c.repo_id, c.path FROM v_changes c JOIN v_marks m ON m.repo_id = c.repo_id AND c.committed_at > m.last_updated)"""


@query("staleness", ("v_commits", "v_marks"), f"{SINCE_SQL} SELECT * FROM since")
def staleness(i: Inputs):
    return history.commits_since(i.v_commits, i.v_marks)


@query("diff_numstat", ("v_changes",), """SELECT repo_id, path, CAST(SUM(insertions) AS BIGINT) AS insertions, CAST(SUM(deletions) AS BIGINT) AS deletions FROM v_changes
  WHERE committed_at > TIMESTAMP '1997-01-01 00:00:00' AND committed_at <= TIMESTAMP '1999-06-30 00:00:00' GROUP BY repo_id, path""")
def diff_numstat(i: Inputs):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return incremental.diff_numstat(i.v_changes, at("1997-01-01 00:00:00"), at("1999-06-30 00:00:00"))


@query("changed_since", ("v_changes", "v_marks"), f"{CHANGED_SQL} SELECT * FROM changed")
def changed_since(i: Inputs):
    return incremental.changed_since(i.v_changes, i.v_marks)


@query("churn_alert", ("v_changes", "v_marks"), f"{CHANGED_SQL} SELECT repo_id, COUNT(*) AS n_files FROM changed GROUP BY repo_id HAVING COUNT(*) >= 15")
def churn_alert(i: Inputs):
    return incremental.churn_alert(i.v_changes, i.v_marks)


def _written(i: Inputs):
    """The changes as a table: counts of pairs and of files read them several times."""
    return i.write("v_changes", "repo_id", "commit_id", "committed_at", "path")


@query("co_change_counts", ("v_changes",), f"{COUNTS_SQL} SELECT * FROM counts")
def co_change_counts(i: Inputs):
    return cochange.co_change_counts(_written(i))


@query("co_change_narrow", ("v_changes",), """small AS (SELECT repo_id, commit_id FROM v_changes GROUP BY repo_id, commit_id HAVING COUNT(*) <= 5)
  SELECT a.repo_id, a.path AS file_a, b.path AS file_b, COUNT(*) AS n FROM v_changes a JOIN small s ON s.repo_id = a.repo_id AND s.commit_id = a.commit_id
  JOIN v_changes b ON a.repo_id = b.repo_id AND a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL HAVING COUNT(*) >= 2""")
def co_change_narrow(i: Inputs):
    """A lower width limit, so that wide commits occur in the data."""
    return cochange.co_change_counts(_written(i), max_files=5, min_count=2)


@query("co_change_wide", ("v_changes",), """months AS (SELECT DISTINCT repo_id, date_trunc('month', committed_at) AS commit_id, path FROM v_changes)
  SELECT a.repo_id, a.path AS file_a, b.path AS file_b, COUNT(*) AS n FROM months a
  JOIN months b ON a.repo_id = b.repo_id AND a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL HAVING COUNT(*) >= 10""")
def co_change_wide(i: Inputs):
    """All changes of a month as one commit, in parts so small that most commits are dealt as a grid."""
    months = _written(i).withColumn("commit_id", F.date_trunc("month", "committed_at"))
    return cochange.co_change_counts(months, min_count=10, part=16)


@query("co_change_pairs", ("v_changes",), f"{PAIRS_SQL} SELECT repo_id, file_a, file_b, n, strength FROM pairs")
def co_change_pairs(i: Inputs):
    changes = _written(i)
    return cochange.co_change_pairs(cochange.co_change_counts(changes), history.file_frequency(changes), top_n=None)


@query("co_change_topk", ("v_changes",), f"{RANKED_PAIRS_SQL} SELECT repo_id, file_a, file_b, n, strength, rank FROM ranked")
def co_change_topk(i: Inputs):
    changes = _written(i)
    return cochange.co_change_pairs(cochange.co_change_counts(changes), history.file_frequency(changes))


def _missing(i: Inputs):
    changes = _written(i)
    pairs = cochange.co_change_pairs(cochange.co_change_counts(changes), history.file_frequency(changes), top_n=None)
    return cochange.missing_partners(i.write("v_changeset"), stage(pairs, "pairs"))


@query("missing_partners", ("v_changeset",), f"{MISSING_SQL} SELECT * FROM absent")
def missing_partners(i: Inputs):
    return _missing(i)


@query("missing_partners_topk", ("v_changeset",), f"""{PAIRS_SQL}, partners AS (SELECT repo_id, file_a AS path, file_b AS missing, n, strength FROM pairs
    UNION ALL SELECT repo_id, file_b, file_a, n, strength FROM pairs),
  best AS (SELECT * FROM partners QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY strength DESC, n DESC, missing) <= 3)
  SELECT c.repo_id, c.change_id, c.path AS changed, p.missing, p.n, p.strength FROM v_changeset c
    JOIN best p ON p.repo_id = c.repo_id AND p.path = c.path
    LEFT JOIN v_changeset x ON x.repo_id = c.repo_id AND x.change_id = c.change_id AND x.path = p.missing WHERE x.path IS NULL""")
def missing_partners_topk(i: Inputs):
    """Of every file its three strongest partners only."""
    changes = _written(i)
    pairs = cochange.co_change_pairs(cochange.co_change_counts(changes), history.file_frequency(changes), top_n=None)
    return cochange.missing_partners(i.write("v_changeset"), stage(pairs, "pairs"), per_file=3)


@query("critical_touches", ("v_changes", "v_changeset"), f"""{HOT_SQL} SELECT c.repo_id, c.change_id, c.path FROM v_changeset c
  JOIN hot h ON h.repo_id = c.repo_id AND h.path = c.path""")
def critical_touches(i: Inputs):
    return review.critical_touches(i.v_changeset, history.hot_files(i.v_changes)).select("repo_id", "change_id", "path")


@query("numstat_lines", ("v_parts",), """lines AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS d, l_returnflag AS f,
    CASE WHEN l_linenumber = 7 THEN 'x/' || p.w1 || '/' || p.w2 || '.bin' WHEN l_linenumber = 6 THEN 'a//' || p.path ELSE p.path END AS raw
    FROM lineitem l JOIN v_parts p ON p.p_partkey = l.l_partkey)
  SELECT CASE WHEN d = 6 THEN 'a/' || substr(raw, 4) WHEN d = 7 THEN raw ELSE raw END AS path,
    COUNT(*) AS n, CAST(SUM(CASE WHEN d = 7 THEN 0 ELSE q END) AS BIGINT) AS insertions,
    CAST(SUM(CASE WHEN d = 7 THEN 0 ELSE d END) AS BIGINT) AS deletions, CAST(count_if(d = 7) AS BIGINT) AS binaries FROM lines GROUP BY 1""")
def numstat_lines(i: Inputs):
    """Numstat text made from every order line, with binaries (-) and both rename forms, parsed back."""
    parts = i.v_parts
    line = (
        "CASE WHEN l_linenumber = 7 THEN concat('-\t-\tx/{', w2, ' => ', w1, '}/', w2, '.bin') "
        "WHEN l_linenumber = 6 THEN concat(CAST(l_quantity AS INT), '\t6\ta/{old => }/', path) "
        "WHEN l_linenumber = 5 THEN concat(CAST(l_quantity AS INT), '\t5\tbefore.txt => ', path) "
        "ELSE concat(CAST(l_quantity AS INT), '\t', l_linenumber, '\t', path) END"
    )
    lines = i.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.expr(line).alias("line"))
    parsed = lines.select(parse_numstat(F.col("line")).alias("s")).select("s.*")
    return parsed.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
        F.count_if("is_binary").alias("binaries"),
    )
