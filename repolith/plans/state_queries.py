"""Queries over scores, questions, summaries, increments and streams."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions import fixed_values as fv
from repolith.operators import cochange, deps, history, imports, incremental, questions, score, structure, summary
from repolith.plans import facts as fleet
from repolith.plans.content_queries import (
    COMMANDS_SQL, DEPS_SQL, DESCRIPTION_SQL, DETECT_SQL, FWQ_SQL, RULE_TEXT_SQL, SERVICES_SQL, TODO_SQL,
)
from repolith.plans.history_queries import (
    COUNTS_SQL, FREQ_SQL, HOT_SQL, KEY_SQL, PATTERNS_SQL, RANKED_PAIRS_SQL, SINCE_SQL,
)
from repolith.plans.registry import Inputs, query, stamp
from repolith.plans.structure_queries import (
    ARCH_SQL, CODE_SQL, FACTS_SQL, KEY_TYPES_SQL, LANGS_SQL, LAYOUT_SQL, LINES, RESOLVE_SQL, ROOT_SQL, TYPES_SQL,
)
from repolith.session import ensure_checkpoint_dir, stage
from repolith.sources import sinks
from repolith.streaming import increments, throttle

EXPECTED_DOCS = ("README.md", "CONTRIBUTING.md", "Makefile", "package.json")


def _join(*fragments: str) -> str:
    """CTE fragments side by side, each shared fragment once and in front of its users."""
    text = ", ".join(fragments) + ","
    for shared in (DETECT_SQL, TYPES_SQL, DEPS_SQL, FREQ_SQL, LINES):
        if shared in text:
            text = f"{shared}, " + text.replace(f"{shared},", "")
    return text.rstrip(", ")


def _tables(i: Inputs) -> fleet.Tables:
    """The fleet's tables. The views that many branches read are written once, as tables are."""
    changes, contents = stage(i.v_changes, "changes"), stage(i.v_contents, "contents")
    return fleet.Tables(i.v_commits, changes, contents.select("repo_id", "path"), contents, i.v_rule_files)


ALL_VIEWS = ("v_commits", "v_changes", "v_files", "v_contents", "v_rule_files", "v_special", "v_answered", "v_marks")
_NAMED = {k: ", ".join(f"'{n}'" for n in names) for k, names in score.COMMAND_KINDS}
FACT_SQL = _join(
    DESCRIPTION_SQL, ROOT_SQL, LANGS_SQL, COMMANDS_SQL, ARCH_SQL, SERVICES_SQL, CODE_SQL, KEY_TYPES_SQL, RULE_TEXT_SQL,
    PATTERNS_SQL, TODO_SQL, DETECT_SQL, LAYOUT_SQL, FACTS_SQL, FREQ_SQL,
) + f""", cmdf AS (SELECT repo_id, COUNT(*) AS n_commands, {', '.join(
    f"bool_or(name IN ({n})) AS has_{k}, coalesce(arg_min(source LIKE '%package.json%' OR source LIKE '%Makefile%', CASE WHEN name IN ({n}) THEN row(pos, name, command) END), false) AS {k}_explicit"
    for k, n in _NAMED.items())} FROM cmds GROUP BY repo_id),
  clog AS (SELECT repo_id, bool_or(regexp_matches(path, '{fv.TEST_FILE_PATTERNS['convention']}')) AS t FROM v_changes GROUP BY repo_id),
  listed AS (SELECT path FROM v_files),
  nconv AS (SELECT r.repo_id, CAST(r.repo_id IN (SELECT repo_id FROM v_commits) AS INT) + CAST(coalesce(c.n, 0) > 0 AS INT) + CAST(coalesce(l.t, false) AS INT)
      + (SELECT COUNT(*) FROM facts f WHERE f.repo_id = r.repo_id AND f.kind = 'style_config') AS n FROM (SELECT DISTINCT repo_id FROM v_files) r
    LEFT JOIN (SELECT repo_id, count_if(regexp_matches(path, '\\.(ts|tsx|js|py|go|rs|java)$') AND NOT regexp_matches(path, '\\.test\\.')) AS n FROM v_changes GROUP BY repo_id) c ON c.repo_id = r.repo_id
    LEFT JOIN clog l ON l.repo_id = r.repo_id),
  fr AS (SELECT r.repo_id, d.description, coalesce(p.root_package, '') AS root_package, g.language AS primary_language, coalesce(m.n_commands, 0) AS n_commands,
    {', '.join(f"coalesce(m.has_{k}, false) AS has_{k}, coalesce(m.{k}_explicit, false) AS {k}_explicit" for k, _ in score.COMMAND_KINDS)},
    a.style, CASE WHEN a.entry_points = '' THEN 0 ELSE len(string_split(a.entry_points, '|')) END AS n_entry_points, CASE WHEN a.layers = '' THEN 0 ELSE len(string_split(a.layers, '|')) END AS n_layers,
    CASE WHEN a.api_patterns = '' THEN 0 ELSE len(string_split(a.api_patterns, '|')) END AS n_api_patterns, (SELECT COUNT(*) FROM svc s WHERE s.repo_id = r.repo_id) AS n_services,
    (SELECT COUNT(*) FROM codep s WHERE s.repo_id = r.repo_id) AS n_patterns, (SELECT COUNT(*) FROM keyt s WHERE s.repo_id = r.repo_id) AS n_types,
    (SELECT COUNT(*) FROM trules s WHERE s.repo_id = r.repo_id) AS n_rules, v.n AS n_conventions, coalesce(h.style, 'unknown') AS commit_style, coalesce(h.branch_pattern, '') AS branch_pattern,
    (SELECT COUNT(*) FROM todos s WHERE s.repo_id = r.repo_id) AS n_todos, (SELECT COUNT(*) FROM detected s WHERE s.repo_id = r.repo_id AND s.kind = 'test_framework') AS n_test_frameworks, y.layout
    FROM (SELECT DISTINCT repo_id FROM v_files) r LEFT JOIN descr d ON d.repo_id = r.repo_id LEFT JOIN rootp p ON p.repo_id = r.repo_id
    LEFT JOIN langs g ON g.repo_id = r.repo_id AND g.is_primary LEFT JOIN cmdf m ON m.repo_id = r.repo_id LEFT JOIN arch a ON a.repo_id = r.repo_id
    LEFT JOIN nconv v ON v.repo_id = r.repo_id LEFT JOIN cp h ON h.repo_id = r.repo_id LEFT JOIN layouts y ON y.repo_id = r.repo_id)"""
_BUILD = " + ".join(f"CASE WHEN has_{k} THEN CASE WHEN {k}_explicit THEN 5 ELSE 3 END ELSE 0 END" for k, _ in score.COMMAND_KINDS)
SCORE_SQL = f"""{FACT_SQL}, sw AS (SELECT *, CASE WHEN description IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN root_package <> '' THEN 4 ELSE 1 END + CASE WHEN primary_language IS NOT NULL THEN 4 ELSE 0 END AS s1,
    {_BUILD} AS s2, least(20, 5 * CAST(style <> 'unknown' AS INT) + 4 * CAST(n_entry_points > 0 AS INT) + 4 * CAST(n_layers > 0 AS INT) + 4 * CAST(n_api_patterns > 0 AS INT) + 3 * CAST(n_services > 0 AS INT)) AS s3,
    least(15, least(9, n_patterns * 3) + least(6, CAST(floor(n_types / 5.0 + 0.5) AS BIGINT))) AS s4,
    least(15, least(5, n_rules * 2) + least(4, n_conventions * 2) + 2 * CAST(commit_style <> 'unknown' AS INT) + 2 * CAST(branch_pattern <> '' AS INT) + 2 * CAST(n_todos > 0 AS INT)) AS s5,
    3 * CAST(n_test_frameworks > 0 AS INT) + 3 * CAST(layout <> 'none' AS INT) + CASE WHEN has_test THEN 4 ELSE 1 END AS s6 FROM fr),
  scores AS ({' UNION ALL '.join(f"SELECT repo_id, CAST({n} AS BIGINT) AS pos, '{d}' AS dimension, CAST(s{n + 1} AS BIGINT) AS score, CAST({m} AS BIGINT) AS max FROM sw" for n, (d, m) in enumerate(fv.DIMENSION_MAX))})"""
_GRADE = "CASE WHEN {0} >= 80 THEN 'A' WHEN {0} >= 65 THEN 'B' WHEN {0} >= 50 THEN 'C' WHEN {0} >= 35 THEN 'D' ELSE 'F' END"
TOTAL_SQL = f"totals AS (SELECT repo_id, CAST(SUM(score) AS BIGINT) AS total, {_GRADE.format('SUM(score)')} AS grade FROM scores GROUP BY repo_id)"


@query("confidence_facts", ALL_VIEWS, f"""{FACT_SQL} SELECT repo_id, description, root_package, primary_language, n_commands, style, n_entry_points, n_layers, n_api_patterns, n_services,
  n_patterns, n_types, n_rules, n_conventions, commit_style, branch_pattern, n_todos, n_test_frameworks, layout FROM fr""")
def confidence_facts(i: Inputs):
    wide = fleet.facts(_tables(i))
    return wide.drop("commands", *[c for c in wide.columns if c.startswith("has_") or c.endswith("_explicit")])


@query("confidence_score", ALL_VIEWS, f"{SCORE_SQL} SELECT * FROM scores")
def confidence_score(i: Inputs):
    return score.confidence_score(fleet.facts(_tables(i))).drop("details")


@query("confidence_total", ALL_VIEWS, f"{SCORE_SQL}, {TOTAL_SQL} SELECT * FROM totals")
def confidence_total(i: Inputs):
    return score.score_total(score.confidence_score(fleet.facts(_tables(i))))


_MISSING = "array_to_string(list_filter([CASE WHEN NOT has_build THEN 'build' END, CASE WHEN NOT has_test THEN 'test' END, CASE WHEN NOT has_run THEN 'run/start' END], lambda x: x IS NOT NULL), ', ')"
GAP_SQL = f"""gaps AS (SELECT repo_id, dimension, impact, i + CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 100 ELSE 200 END AS key, question FROM (
    SELECT repo_id, 'Project Identity' AS dimension, 'high' AS impact, 1 AS i, 'What does this project do? Describe its purpose in 1-2 sentences.' AS question FROM sw WHERE description IS NULL
    UNION ALL SELECT repo_id, 'Project Identity', 'high', 2, 'What is the primary programming language for this project?' FROM sw WHERE primary_language IS NULL
    UNION ALL SELECT repo_id, 'Build & Run', 'high', 3, concat('What are the commands to ', {_MISSING}, ' this project?') FROM sw WHERE s2 < 10
    UNION ALL SELECT repo_id, 'Architecture', 'medium', 5, 'What are the main entry points to this application?' FROM sw WHERE n_entry_points = 0
    UNION ALL SELECT repo_id, 'Architecture', 'medium', 6, 'What are the main layers or modules in this codebase? (e.g., API → service → repository → database)' FROM sw WHERE n_layers = 0
    UNION ALL SELECT repo_id, 'Code Patterns', 'medium', 7, 'What patterns or idioms should developers follow in this codebase? (e.g., DI style, error handling, naming conventions)' FROM sw WHERE n_patterns = 0
    UNION ALL SELECT repo_id, 'Domain Context', CASE WHEN s5 = 0 THEN 'high' ELSE 'medium' END, 8, 'What domain-specific rules or gotchas should developers know about? Any tribal knowledge not in code?' FROM sw WHERE s5 < 8
    UNION ALL SELECT repo_id, 'Testing', CASE WHEN s6 = 0 THEN 'high' ELSE 'low' END, 9, 'How do you run tests? Any conventions for test organization, naming, or mocking?' FROM sw WHERE s6 < 6) x)"""


@query("confidence_gaps", ALL_VIEWS, f"{SCORE_SQL}, {GAP_SQL} SELECT repo_id, dimension, impact, question FROM gaps")
def confidence_gaps(i: Inputs):
    return score.gaps(fleet.facts(_tables(i))).select("repo_id", "dimension", "impact", "question")


def _answers(i: Inputs) -> DataFrame:
    first = F.struct(F.lit(fv.TRIBAL_QUESTIONS[0]).alias("question"), F.lit("Read the ledger first.").alias("answer"))
    none = F.array().cast("array<string>")
    return i.v_answered.select(
        "repo_id",
        F.when(F.col("low") % 2 == 0, "Keeps books").alias("project_description"),
        F.when(F.col("high") % 2 == 0, F.array(F.lit("make"))).otherwise(none).alias("build_commands"),
        F.when(F.col("third") == 1, "layered").alias("architecture_notes"),
        F.when(F.col("n_files") > 6, F.array(F.lit("di"))).alias("code_patterns"),
        F.when(F.col("low") > 5, F.array(F.lit("ledger"))).alias("domain_context"),
        F.when(F.col("low") > 3, "pytest").alias("testing_notes"),
        F.when(F.col("high") > 20, F.array(first)).alias("domain_qa"),
    )


DONE_SQL = """done AS (SELECT repo_id, low % 2 = 0 AS d1, high % 2 = 0 AS d2, third = 1 AS d3, n_files > 6 AS d4, low > 5 AS d5, low > 3 AS d6, high > 20 AS qa FROM v_answered)"""
UPLIFT_SQL = f"""{DONE_SQL}, up AS (SELECT s.repo_id, s.pos, s.dimension, CAST(CASE
    WHEN pos = 0 AND d1 THEN max WHEN pos = 1 AND d2 THEN max WHEN pos = 2 AND d3 THEN least(max, score + 10) WHEN pos = 3 AND d4 THEN least(max, score + 8)
    WHEN pos = 4 THEN least(max, least(max, score + CASE WHEN d5 THEN 10 ELSE 0 END) + CASE WHEN qa THEN 3 ELSE 0 END) WHEN pos = 5 AND d6 THEN least(max, score + 5) ELSE score END AS BIGINT) AS score, s.max
    FROM scores s LEFT JOIN done d ON d.repo_id = s.repo_id)"""


@query("score_uplift", ALL_VIEWS, f"{SCORE_SQL}, {UPLIFT_SQL} SELECT * FROM up")
def score_uplift(i: Inputs):
    return score.uplift(score.confidence_score(fleet.facts(_tables(i))), _answers(i))


@query("open_gaps", ALL_VIEWS, f"""{SCORE_SQL}, {GAP_SQL}, {DONE_SQL} SELECT g.repo_id, g.dimension, g.question FROM gaps g LEFT JOIN done d ON d.repo_id = g.repo_id
  WHERE NOT coalesce(CASE g.dimension WHEN 'Project Identity' THEN d1 WHEN 'Build & Run' THEN d2 WHEN 'Architecture' THEN d3 WHEN 'Code Patterns' THEN d4 WHEN 'Domain Context' THEN d5 ELSE d6 END, false)""")
def open_gaps(i: Inputs):
    return score.open_gaps(score.gaps(fleet.facts(_tables(i))), _answers(i)).select("repo_id", "dimension", "question")


_DOCS = ", ".join(f"'{p}'" for p in EXPECTED_DOCS)
HEALTH_SQL = f"""{SINCE_SQL}, ex AS (SELECT repo_id, count_if(path IN ({_DOCS})) AS e FROM v_files GROUP BY repo_id),
  hw AS (SELECT x.repo_id, x.e, CASE WHEN s.stale THEN x.e ELSE 0 END AS st, coalesce(s.n_commits, 0) AS n_commits FROM ex x LEFT JOIN since s ON s.repo_id = x.repo_id),
  hs AS (SELECT *, CAST(greatest(0, least(100, floor((e * 20 - st * 5) / 80.0 * 100 + 0.5))) AS BIGINT) AS score FROM hw),
  health AS (SELECT repo_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
    CAST(4 - e AS BIGINT) AS n_missing, CAST(st AS BIGINT) AS n_stale, n_commits FROM hs)"""


def _health(i: Inputs) -> DataFrame:
    return score.doc_health(i.v_files, history.commits_since(i.v_commits, i.v_marks), EXPECTED_DOCS)


@query("doc_health", ("v_files", "v_commits", "v_marks"), f"{HEALTH_SQL} SELECT * FROM health")
def doc_health(i: Inputs):
    return _health(i)


@query("doc_issues", ("v_files", "v_commits", "v_marks"), f"""{HEALTH_SQL} SELECT h.repo_id, 'error' AS severity, concat('Missing file: ', p.path) AS message FROM health h
  CROSS JOIN (VALUES {', '.join(f"('{p}')" for p in EXPECTED_DOCS)}) p(path) WHERE NOT EXISTS (SELECT 1 FROM v_files f WHERE f.repo_id = h.repo_id AND f.path = p.path)
  UNION ALL SELECT repo_id, 'warning', concat(n_stale, ' files may be stale (', n_commits, ' commits since last update)') FROM health WHERE n_stale > 0""")
def doc_issues(i: Inputs):
    return score.doc_issues(i.v_files, _health(i), EXPECTED_DOCS)


@query("rubric_score", ("v_commits",), """SELECT c.repo_id, l.l_suppkey AS run_id, CAST(SUM(l.l_linenumber - 1) * 2.5 AS DOUBLE) AS total, CAST(count_if(l.l_linenumber - 1 < 5) AS BIGINT) AS n_gaps
  FROM lineitem l JOIN v_commits c ON c.commit_id = l.l_orderkey GROUP BY ALL""")
def rubric_score(i: Inputs):
    rubric = i.lineitem.join(i.v_commits, F.col("l_orderkey") == F.col("commit_id")).select(
        "repo_id", F.col("l_suppkey").alias("run_id"), (F.col("l_linenumber") - 1).alias("score")
    )
    return score.rubric_score(rubric)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QUESTION_SQL = f"""{SCORE_SQL}, {GAP_SQL}, {HOT_SQL.replace(FREQ_SQL + ',', '')}, {RANKED_PAIRS_SQL.replace(FREQ_SQL + ',', '')}, {RESOLVE_SQL}, {FWQ_SQL.replace(DETECT_SQL + ',', '')},
  svn AS (SELECT repo_id, COUNT(*) AS n, string_agg(service, ', ' ORDER BY line_no) AS names FROM svc GROUP BY repo_id),
  cand AS (SELECT repo_id, 1 AS c, rank AS p, 'hot-file' AS category, 'domainQA' AS dimension,
      concat(regexp_extract(path, '([^/]*)$', 1), ' changed ', change_count, ' times recently — what are the key business rules or invariants it enforces?') AS question, concat('Most frequently changed file: ', path) AS context FROM hot WHERE rank <= 3
    UNION ALL SELECT repo_id, 2, 1, 'architecture', 'domainQA', concat('The codebase appears to be a ', style, '. Why was this architecture chosen? Any constraints or trade-offs to know about?'),
      concat('Detected ', n_layers, ' layers, ', n_entry_points, ' entry points') FROM fr
    UNION ALL SELECT repo_id, 2, 2, 'architecture', 'domainQA', concat('I see ', n, ' services (', names, '). How do they communicate? Any ordering dependencies or gotchas?'), 'Detected from service map analysis' FROM svn WHERE n > 1
    UNION ALL SELECT repo_id, 3, rank, 'coupling', 'domainQA', concat(regexp_extract(file_a, '([^/]*)$', 1), ' and ', regexp_extract(file_b, '([^/]*)$', 1), ' always change together (', n, ' times). Is this intentional coupling or tech debt?'),
      concat('Co-change strength: ', CAST(floor(strength * 100 + 0.5) AS BIGINT), '%') FROM ranked WHERE rank <= 2
    UNION ALL SELECT repo_id, 4, rank, 'load-bearing', 'domainQA', concat(regexp_extract(file, '([^/]*)$', 1), ' is imported by ', n_imports, ' other files. Any rules for modifying it? Breaking change risks?'), concat('High fan-in module: ', file) FROM topfan WHERE rank <= 2
    UNION ALL SELECT repo_id, 5, t.p, 'tribal', 'domainQA', t.q, NULL FROM (SELECT DISTINCT repo_id FROM v_files) r CROSS JOIN (VALUES {', '.join(f"({n}, {_q(x)})" for n, x in enumerate(fv.TRIBAL_QUESTIONS))}) t(p, q)
    UNION ALL SELECT repo_id, 6, pos, 'framework', 'domainQA', concat('[', framework, '] ', question), context FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS r FROM fwq) x WHERE r <= 4
    UNION ALL SELECT repo_id, 7, key, 'gap', dimension, question, NULL FROM gaps WHERE impact IN ('high', 'medium')),
  smart AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY c, p, question) AS pos FROM cand k
    WHERE NOT (k.question = {_q(fv.TRIBAL_QUESTIONS[0])} AND k.repo_id IN (SELECT repo_id FROM v_answered WHERE high > 20))) x WHERE pos <= 12)"""


def _questions(i: Inputs, t: fleet.Tables, wide: DataFrame) -> DataFrame:
    freq = t.freq
    names = deps.read_manifests(t.manifests)
    return questions.smart_questions(
        t.files,
        history.hot_files(t.changes),
        structure.architecture(t.files),
        fleet.services(t),
        cochange.co_change_pairs(cochange.co_change_counts(t.changes), freq),
        imports.fan_in(t.import_edges),
        deps.framework_questions(fleet.detected(t), names),
        score.gaps(wide),
        _answers(i),
    )


@query("smart_questions", ALL_VIEWS, f"{QUESTION_SQL} SELECT repo_id, pos, category, dimension, question, CASE WHEN category <> 'gap' THEN context END AS context FROM smart")
def smart_questions(i: Inputs):
    # the text of gap contexts is checked in the unit tests
    t = _tables(i)
    return _questions(i, t, fleet.facts(t)).withColumn("context", F.when(F.col("category") != "gap", F.col("context")))


@query("report_json")
def report_json(i: Inputs):
    t = _tables(i)
    wide = stage(fleet.facts(t), "facts")
    scores = score.confidence_score(wide)
    return sinks.to_report_json(scores, score.score_total(scores), score.gaps(wide), _questions(i, t, wide))


def _summary(i: Inputs) -> DataFrame:
    t = _tables(i)
    return summary.fleet_summary(
        t.commits,
        t.files,
        t.freq,
        structure.language_share(t.files),
        cochange.co_change_counts(t.changes),
        score.score_total(score.confidence_score(fleet.facts(t))),
    )


SUMMARY_SQL = f"""{SCORE_SQL}, {TOTAL_SQL}, {COUNTS_SQL},
  who AS (SELECT repo_id, COUNT(*) AS commits, COUNT(DISTINCT {KEY_SQL}) AS contributors, MAX(committed_at) AS last_commit FROM v_commits GROUP BY repo_id),
  nf AS (SELECT repo_id, COUNT(*) AS files FROM v_files GROUP BY repo_id), nc AS (SELECT repo_id, COUNT(*) AS changed_files, arg_min(path, row(-change_count, path)) AS hottest_file FROM freq GROUP BY repo_id),
  np AS (SELECT repo_id, COUNT(*) AS pairs FROM counts GROUP BY repo_id),
  summed AS (SELECT w.*, coalesce(nf.files, 0) AS files, coalesce(nc.changed_files, 0) AS changed_files, nc.hottest_file, g.language AS primary_language, coalesce(np.pairs, 0) AS pairs, t.total, t.grade FROM who w
    LEFT JOIN nf ON nf.repo_id = w.repo_id LEFT JOIN nc ON nc.repo_id = w.repo_id LEFT JOIN np ON np.repo_id = w.repo_id
    LEFT JOIN langs g ON g.repo_id = w.repo_id AND g.is_primary LEFT JOIN totals t ON t.repo_id = w.repo_id)"""


@query("fleet_summary", ALL_VIEWS, f"{SUMMARY_SQL} SELECT * REPLACE (strftime(last_commit, '%Y-%m-%d %H:%M:%S') AS last_commit) FROM summed")
def fleet_summary(i: Inputs):
    return _summary(i).withColumn("last_commit", stamp("last_commit"))


# --- increments -----------------------------------------------------------------------------

SPLIT = "1998-06-01 00:00:00"


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = F.lit(SPLIT).cast("timestamp_ntz")
    return df.filter(F.col("committed_at") < at), df.filter(F.col("committed_at") >= at)


@query("snapshot_merge", ("v_changes",), f"{FREQ_SQL} SELECT repo_id, path, change_count, strftime(last_changed, '%Y-%m-%d %H:%M:%S') AS last_changed FROM freq")
def snapshot_merge(i: Inputs):
    """Counts of the log up to a day plus counts after it equal the counts of the whole log."""
    old, new = _halves(i.v_changes)
    merged = incremental.merge_frequency(history.file_frequency(old), history.file_frequency(new))
    return merged.withColumn("last_changed", stamp("last_changed"))


@query("pair_merge", ("v_changes",), f"{COUNTS_SQL} SELECT * FROM counts")
def pair_merge(i: Inputs):
    old, new = _halves(i.v_changes)
    parts = [cochange.co_change_counts(part, min_count=1) for part in (old, new)]
    return incremental.merge_pairs(*parts).filter(F.col("n") >= fv.PAIR_MIN_COUNT)


@query("ttl_latest", (), """WITH c AS (SELECT user_id AS key, event_type AS payload, ts + INTERVAL 24 HOUR AS expires_at FROM events WHERE event_type <> 'click'
    UNION ALL SELECT user_id, concat('new ', event_type), TIMESTAMP '2024-01-30 12:00:00' + INTERVAL 24 HOUR FROM events WHERE event_type = 'click')
  SELECT key, arg_max(payload, row(expires_at, payload)) AS payload, strftime(MAX(expires_at), '%Y-%m-%d %H:%M:%S') AS expires_at FROM c GROUP BY key HAVING MAX(expires_at) > TIMESTAMP '2024-01-30 12:00:00'""")
def ttl_latest(i: Inputs):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    cache = i.events.filter("event_type <> 'click'").select(
        F.col("user_id").alias("key"),
        F.col("event_type").alias("payload"),
        (F.col("ts") + F.make_interval(hours=F.lit(24))).alias("expires_at"),
    )
    new = i.events.filter("event_type = 'click'").select(
        F.col("user_id").alias("key"), F.concat(F.lit("new "), F.col("event_type")).alias("payload")
    )
    return incremental.ttl_upsert(cache, new, now).withColumn("expires_at", stamp("expires_at"))


_S, _E = incremental.AUTO_START, incremental.AUTO_END


@query("doc_upsert", ("v_docs",), f"""d AS (SELECT repo_id, path, text, length(text) % 4 AS kind, concat('{_S}new ', path, '{_E}') AS section FROM v_docs)
  SELECT repo_id, path, CASE kind WHEN 0 THEN concat(text, section, 'tail') WHEN 1 THEN text WHEN 2 THEN concat('head', section) ELSE concat('intro', section, 'x') END AS content,
    CASE kind WHEN 0 THEN 'updated' WHEN 1 THEN 'skipped' WHEN 2 THEN 'skipped' ELSE 'created' END AS action,
    CASE kind WHEN 1 THEN 'Manual content preserved' WHEN 2 THEN 'Content unchanged' END AS reason FROM d""")
def doc_upsert(i: Inputs):
    """Every document in one of four states, told by its length: marked, unmarked, equal, missing."""
    kind = F.length("text") % 4
    section = F.concat(F.lit(f"{_S}new "), F.col("path"), F.lit(_E))
    old = F.concat(F.lit(_S), F.lit("old"), F.lit(_E))
    docs = i.v_docs.withColumn("kind", kind)
    existing = docs.filter("kind < 3").select(
        "repo_id",
        "path",
        F.when(F.col("kind") == 0, F.concat("text", old, F.lit("tail")))
        .when(F.col("kind") == 1, F.col("text"))
        .otherwise(F.concat(F.lit("head"), section))
        .alias("content"),
    )
    generated = docs.select("repo_id", "path", F.concat(F.lit("intro"), section, F.lit("x")).alias("content"))
    return incremental.upsert_documents(existing, generated)


def _throttle_sql(key: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT {key} AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, arg_min(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY 1, 2),
  a AS (SELECT k, MIN(s) AS s FROM e GROUP BY k UNION ALL SELECT e.k, MIN(e.s) FROM a JOIN e ON e.k = a.k AND e.s >= a.s + 300 GROUP BY e.k)
  SELECT e.event_id, e.k AS {key} FROM a JOIN e ON e.k = a.k AND e.s = a.s"""


@query("throttle_user", (), _throttle_sql("user_id"))
def throttle_user(i: Inputs):
    return incremental.throttle(i.events.select("event_id", "ts", "user_id"), "user_id", "ts", "event_id").drop("ts")


@query("throttle_type", (), _throttle_sql("event_type"))
def throttle_type(i: Inputs):
    """A handful of keys hold all rows, so they take the way of busy keys."""
    events = i.events.select("event_id", "ts", "event_type")
    return incremental.throttle(events, "event_type", "ts", "event_id", sparse=100).drop("ts")


@query("throttle_stream", (), _throttle_sql("user_id"))
def throttle_stream(i: Inputs):
    """All events, delivered up to half an hour late and out of order, through the stream."""
    base = f"{ensure_checkpoint_dir(i.spark)}/throttle-{uuid.uuid4().hex}"
    late = F.pmod(F.xxhash64("event_id"), F.lit(1800)).cast("int")
    events = i.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    arrives = events.withColumn("at", F.unix_seconds("ts") + late)
    first, last = arrives.agg(F.min("at"), F.max("at")).first()
    size = (last - first) // 6 + 1
    # a file per delivery; the last one holds an event of no user that moves the watermark past all others
    for n in range(6):
        arrives.filter((F.col("at") - first).between(n * size, (n + 1) * size - 1)).drop("at").coalesce(1).write.mode("append").parquet(f"{base}/in")
    end = i.spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), F.timestamp_seconds(F.lit(last + 86_400)).alias("ts"))
    end.write.mode("append").parquet(f"{base}/in")
    stream = i.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    _run(throttle.stream_throttle(stream, "user_id", "ts", "event_id", f"{base}/out", f"{base}/ckpt", delay="1 hour"))
    return throttle.read_throttle(i.spark, f"{base}/out").filter("event_id >= 0").select("event_id", "user_id")


@query("trigger_routing", (), "SELECT event_id, user_id FROM events WHERE CASE WHEN event_type = 'purchase' THEN 'merge' WHEN event_type = 'error' THEN 'manual' ELSE 'commit' END = 'commit'")
def trigger_routing(i: Inputs):
    mode = F.when(F.col("event_type") == "purchase", "merge").when(F.col("event_type") == "error", "manual").otherwise("commit")
    return increments.route_triggers(i.events.withColumn("mode", mode), "commit").select("event_id", "user_id")


# --- streams --------------------------------------------------------------------------------


def _commit_rows(i: Inputs) -> DataFrame:
    """Commits with their file lists; the lists of this data hold at most a dozen paths."""
    lists = i.v_changes.groupBy("repo_id", "commit_id", "committed_at").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return lists.select("repo_id", F.col("commit_id").cast("string").alias("commit_id"), "committed_at", "files")


def _landing(i: Inputs) -> tuple[DataFrame, str]:
    """Commits delivered as files in the shared folder, the larger ones twice, read as a stream."""
    base = f"{ensure_checkpoint_dir(i.spark)}/stream-{uuid.uuid4().hex}"
    commits = _commit_rows(i)
    commits.write.mode("overwrite").parquet(f"{base}/landing/first")
    i.spark.read.parquet(f"{base}/landing/first").filter("size(files) > 3").write.parquet(f"{base}/landing/again")
    schema_path = f"{base}/landing/*"
    return increments.read_commit_stream(i.spark, schema_path), base


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query("stream_frequency", ("v_changes",), f"{FREQ_SQL} SELECT repo_id, path, change_count, strftime(last_changed, '%Y-%m-%d %H:%M:%S') AS last_changed FROM freq")
def stream_frequency(i: Inputs):
    stream, base = _landing(i)
    _run(increments.stream_frequency(stream, f"{base}/freq", f"{base}/ckpt"))
    return increments.read_frequency(i.spark, f"{base}/freq").withColumn("last_changed", stamp("last_changed"))


@query("stream_pairs", ("v_changes",), f"{COUNTS_SQL} SELECT * FROM counts")
def stream_pairs(i: Inputs):
    stream, base = _landing(i)
    _run(increments.stream_pairs(stream, f"{base}/pairs", f"{base}/ckpt"))
    return increments.read_pairs(i.spark, f"{base}/pairs")


ALERT_SQL = """nw AS (SELECT c.repo_id, c.commit_id, c.path FROM v_changes c JOIN v_marks m ON m.repo_id = c.repo_id AND c.committed_at > m.last_updated),
  al AS (SELECT repo_id, COUNT(DISTINCT commit_id) AS n_commits, COUNT(DISTINCT path) AS n_files FROM nw GROUP BY repo_id HAVING COUNT(DISTINCT commit_id) > 10 OR COUNT(DISTINCT path) >= 15)"""


@query("stale_alerts", ("v_changes", "v_marks"), f"{ALERT_SQL} SELECT * FROM al")
def stale_alerts(i: Inputs):
    return increments.stale_alerts(_commit_rows(i), i.v_marks)


@query("stream_alerts", ("v_changes", "v_marks"), f"{ALERT_SQL} SELECT * FROM al")
def stream_alerts(i: Inputs):
    stream, base = _landing(i)
    _run(increments.stream_alerts(stream, f"{base}/alerts", f"{base}/ckpt"))
    return increments.read_alerts(i.spark, f"{base}/alerts", i.v_marks)
