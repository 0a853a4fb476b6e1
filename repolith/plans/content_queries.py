"""Queries over texts, manifests, pull requests and knowledge records."""

from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv
from repolith.operators import content, deps, history, knowledge, prs, questions, rules
from repolith.plans.history_queries import FREQ_SQL
from repolith.plans.registry import Inputs, query, stamp, text
from repolith.plans.structure_queries import LINES
from repolith.schemas import PULL_REQUEST_JSON

#: rules that occur in the driver's documents: addresses, numbers, licence words, secrets
DOCUMENT_RULES = (
    ("*", "address", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+"),
    ("*", "number", r"\d{3}[ -]\d{3,4}"),
    ("*", "licence", r"(?i)licen[sc]e|copyright"),
    ("*", "secret", r"(?i)api_key|secret|password|token"),
    ("fr", "word", r"(^|\s)que\s"),
    ("de", "word", r"(^|\s)der\s"),
)
TODO_SQL = f"""{LINES}, todos AS (SELECT repo_id, path, line_no, regexp_extract(line, '{fv.TODO_PATTERN}', 1) AS kind,
    trim(regexp_extract(line, '{fv.TODO_PATTERN}', 2)) AS text FROM lines WHERE regexp_matches(line, '{fv.TODO_PATTERN}'))"""
TODO50_SQL = f"""{TODO_SQL}, {FREQ_SQL}, h50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY change_count DESC, path) AS r FROM freq) x WHERE r <= 50),
  hot_todos AS (SELECT t.* FROM todos t JOIN h50 h ON h.repo_id = t.repo_id AND h.path = t.path)"""


@query("todo_scan", ("v_contents",), f"{TODO_SQL} SELECT * FROM todos")
def todo_scan(i: Inputs):
    return content.scan_todos(i.v_contents)


@query("todo_hot_files", ("v_contents", "v_changes"), f"{TODO50_SQL} SELECT * FROM hot_todos")
def todo_hot_files(i: Inputs):
    return content.scan_todos(i.v_contents, history.file_frequency(i.v_changes), top_files=50)


@query("todo_topk", ("v_contents", "v_changes"), f"""{TODO_SQL}, {FREQ_SQL} SELECT * EXCLUDE (change_count) FROM (SELECT t.*, h.change_count,
  row_number() OVER (PARTITION BY t.repo_id ORDER BY h.change_count DESC NULLS LAST, t.path, t.line_no) AS rank FROM todos t
  LEFT JOIN freq h ON h.repo_id = t.repo_id AND h.path = t.path) x WHERE rank <= 30""")
def todo_topk(i: Inputs):
    return content.top_todos(content.scan_todos(i.v_contents), history.file_frequency(i.v_changes)).drop("change_count")


def _rule_sql(source: str, language: str, rules) -> str:
    lines = f"rl AS (SELECT repo_id, path, {language} AS language, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {source})"
    hits = " UNION ALL ".join(
        f"SELECT repo_id, path, line_no, '{c}' AS category, CAST({n} AS BIGINT) AS rule FROM rl WHERE {'true' if lang == '*' else f'''language = '{lang}' '''} AND regexp_matches(line, '{p}')"
        for n, (lang, c, p) in enumerate(rules)
    )
    return f"{lines}, hits AS ({hits})"


DOC_RULES_SQL = _rule_sql("v_docs", "language", DOCUMENT_RULES)


@query("rule_scan", ("v_docs",), f"{DOC_RULES_SQL} SELECT * FROM hits")
def rule_scan(i: Inputs):
    return content.scan_rules(i.v_docs, DOCUMENT_RULES)


@query("rule_counts", ("v_docs",), f"{DOC_RULES_SQL} SELECT repo_id, category, COUNT(*) AS n_hits, COUNT(DISTINCT path) AS n_files FROM hits GROUP BY repo_id, category")
def rule_counts(i: Inputs):
    return content.rule_counts(content.scan_rules(i.v_docs, DOCUMENT_RULES))


_LANG_OF = "CASE WHEN regexp_matches(path, '\\.tsx?$') THEN 'TypeScript' WHEN regexp_matches(path, '\\.jsx?$') THEN 'JavaScript' WHEN ends_with(path, '.py') THEN 'Python' WHEN ends_with(path, '.java') THEN 'Java' END"


# every part's name as a rule: a table that grows with the data
@query("literal_scan", ("v_docs",), """names AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS literal FROM part UNION SELECT DISTINCT left(c_name, 12) FROM customer UNION SELECT 'er' UNION SELECT 'é'),
  texts AS (SELECT repo_id, path, text FROM v_docs) SELECT t.repo_id, t.path, n.literal FROM texts t JOIN names n ON contains(t.text, n.literal)""")
def literal_scan(i: Inputs):
    names = i.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("literal"))
    names = names.union(i.customer.select(F.left("c_name", F.lit(12)))).union(i.spark.createDataFrame([("er",), ("é",)], "literal STRING")).distinct()
    return rules.literal_hits(i.v_docs.select("repo_id", "path", "text"), names).drop("text")


@query("risk_scan", ("v_contents",), f"{_rule_sql('v_contents', _LANG_OF, fv.RISK_RULES)} SELECT * FROM hits")
def risk_scan(i: Inputs):
    return content.scan_rules(i.v_contents)


def _lead_sql(source: str) -> str:
    return f"""pl AS (SELECT repo_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM {source}),
  pt AS (SELECT repo_id, path, MIN(no) AS t FROM pl WHERE starts_with(line, '# ') OR starts_with(line, '===') GROUP BY ALL),
  pf AS (SELECT l.repo_id, l.path, MIN(l.no) AS f FROM pl l JOIN pt ON pt.repo_id = l.repo_id AND pt.path = l.path AND l.no > t WHERE trim(line) <> '' GROUP BY ALL),
  ps AS (SELECT l.repo_id, l.path, MIN(l.no) AS s FROM pl l JOIN pf ON pf.repo_id = l.repo_id AND pf.path = l.path AND l.no >= f
    WHERE trim(line) = '' OR starts_with(line, '#') OR starts_with(line, '---') GROUP BY ALL),
  leads AS (SELECT l.repo_id, l.path, string_agg(trim(line), ' ' ORDER BY l.no) AS lead FROM pl l JOIN pf ON pf.repo_id = l.repo_id AND pf.path = l.path
    LEFT JOIN ps ON ps.repo_id = l.repo_id AND ps.path = l.path WHERE l.no >= f AND (s IS NULL OR l.no < s) GROUP BY ALL)"""


TITLED = "titled AS (SELECT repo_id, path, concat('# ', repo_id, chr(10), chr(10), text) AS text FROM v_docs)"


@query("lead_paragraph", ("v_docs",), f"{TITLED}, {_lead_sql('titled')} SELECT * FROM leads")
def lead_paragraph(i: Inputs):
    titled = i.v_docs.withColumn("text", F.concat(F.lit("# "), F.col("repo_id"), F.lit("\n\n"), F.col("text")))
    return content.lead_paragraph(titled)


DESCRIPTION_SQL = f"""{_lead_sql('v_contents')}, dsrc AS (
    SELECT repo_id, 1 AS p, lead AS d FROM leads WHERE path = 'README.md'
    UNION ALL SELECT repo_id, 2, CASE WHEN length(trim(regexp_extract(text, '<description>(.*?)</description>', 1))) > 5 THEN trim(regexp_extract(text, '<description>(.*?)</description>', 1))
      WHEN length(regexp_extract(text, '<name>(.*?)</name>', 1)) > 3 THEN regexp_extract(text, '<name>(.*?)</name>', 1) END FROM v_contents WHERE path = 'pom.xml'
    UNION ALL SELECT repo_id, 3, regexp_extract(text, '"description":"([^"]*)"', 1) FROM v_contents WHERE path = 'package.json' AND json_valid(text)),
  descr AS (SELECT repo_id, arg_min(d, p) AS description FROM dsrc WHERE d IS NOT NULL AND d <> '' GROUP BY repo_id)"""


@query("project_description", ("v_contents",), f"{DESCRIPTION_SQL} SELECT * FROM descr")
def project_description(i: Inputs):
    return content.project_description(i.v_contents)


RULE_TEXT_SQL = """rules1 AS (SELECT repo_id, path, '- ' || array_to_string(regexp_extract_all(text, 'Description:\\s*"(.+?)"', 1), chr(10) || '- ') AS rule FROM v_rule_files WHERE path = 'code-review.rules'),
  rules2 AS (SELECT repo_id, path, trim(regexp_replace(text, '(?s)^---.*?---\\s*', ''), chr(10)) AS rule
    FROM v_rule_files WHERE starts_with(path, '.cursor/rules/')), trules AS (SELECT * FROM rules1 UNION ALL SELECT * FROM rules2)"""


@query("team_rules", ("v_rule_files",), f"{RULE_TEXT_SQL} SELECT * FROM trules")
def team_rules(i: Inputs):
    return content.extract_rules(i.v_rule_files)


# the views' compose file has a fixed shape, so the oracle states the services directly
SERVICES_SQL = """composed AS (SELECT repo_id, path, s_nationkey AS k FROM v_special WHERE path = 'docker-compose.yml'),
  svc AS (SELECT repo_id, path, 'web' AS service, CAST(2 AS BIGINT) AS line_no, '8080' AS port, concat('db', k, '|cache') AS depends_on FROM composed
    UNION ALL SELECT repo_id, path, concat('db', k), 9, '5432', '' FROM composed UNION ALL SELECT repo_id, path, 'cache', 13, NULL, '' FROM composed)"""


@query("service_map", ("v_special",), f"{SERVICES_SQL} SELECT * FROM svc")
def service_map(i: Inputs):
    chosen = content.compose_files(i.v_files).select("repo_id", "path")
    texts = i.v_contents.join(chosen, ["repo_id", "path"], "left_semi")
    return content.service_map(texts).withColumn("depends_on", text("depends_on"))


COMMANDS_SQL = """has AS (SELECT repo_id, bool_or(path = 'pom.xml') AS pom, bool_or(path = 'package.json') AS pkg, bool_or(path = 'Makefile') AS mk, bool_or(path = 'Dockerfile') AS dk FROM v_files GROUP BY repo_id),
  pk AS (SELECT repo_id, json_valid(text) AS good FROM v_contents WHERE path = 'package.json'),
  cmds AS (SELECT repo_id, CAST(1 AS BIGINT) AS pos, 'build' AS name, 'mvn clean package -DskipTests' AS command, 'pom.xml' AS source FROM has WHERE pom
    UNION ALL SELECT repo_id, 2, 'test', 'mvn test', 'pom.xml' FROM has WHERE pom UNION ALL SELECT repo_id, 3, 'run', 'mvn spring-boot:run', 'pom.xml' FROM has WHERE pom
    UNION ALL SELECT repo_id, 20, 'build', 'npm run build', 'package.json (tsc)' FROM pk WHERE good UNION ALL SELECT repo_id, 20, 'test', 'npm run test', 'package.json (vitest)' FROM pk WHERE good
    UNION ALL SELECT repo_id, 30, n, 'make ' || n, 'Makefile' FROM has CROSS JOIN (VALUES ('build'), ('lint'), ('run-dev')) v(n) WHERE mk
    UNION ALL SELECT repo_id, 40, 'docker-build', 'docker build -f Dockerfile -t app .', 'Dockerfile' FROM has WHERE dk),
  ucmds AS (SELECT repo_id, pos, name, command, source FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY pos, command, source) AS r FROM cmds) x WHERE r = 1)"""


@query("build_commands", ("v_contents", "v_files"), f"{COMMANDS_SQL} SELECT * FROM ucmds")
def build_commands(i: Inputs):
    return content.build_commands(i.v_contents, i.v_files)


# --- dependencies ---------------------------------------------------------------------------

DEPS_SQL = r"""rawdeps AS (SELECT repo_id, path AS manifest, unnest(CASE
      WHEN path = 'package.json' AND json_valid(text) THEN json_keys(text, '$.dependencies') || json_keys(text, '$.devDependencies')
      WHEN path = 'pom.xml' THEN regexp_extract_all(text, '<artifactId>(.+?)</artifactId>', 1)
      WHEN path = 'go.mod' THEN regexp_extract_all(text, '\t(.+?)\s', 1)
      WHEN path = 'Cargo.toml' THEN regexp_extract_all(text, '(?m)^(\w[\w-]*)\s*=', 1)
      WHEN path = 'requirements.txt' THEN list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(regexp_extract(trim(x), '^([^=<>!~\s\[]*)', 1))), lambda d: d <> '' AND NOT starts_with(d, '#') AND NOT starts_with(d, '-'))
      WHEN path = 'Gemfile' THEN regexp_extract_all(text, 'gem\s+[''"](.+?)[''"]', 1) END) AS dep FROM v_contents),
  mdeps AS (SELECT DISTINCT repo_id, manifest, dep FROM rawdeps)"""


@query("manifest_deps", ("v_contents",), f"{DEPS_SQL} SELECT * FROM mdeps")
def manifest_deps(i: Inputs):
    return deps.read_manifests(i.v_contents)


_GROUP = "CASE " + " ".join(f"WHEN regexp_matches(name, '(?i){p}') THEN '{g}'" for p, g in fv.DEPENDENCY_GROUPS) + " ELSE 'other' END"
VDEPS_SQL = f"""vd AS (SELECT repo_id, concat(m.g, ':', m.a) AS name, m.v AS version FROM v_contents CROSS JOIN (VALUES ('org.springframework.boot', 'spring-boot-starter-web', '3.2.0'),
    ('org.projectlombok', 'lombok', ''), ('com.google.guava', 'guava', '')) m(g, a, v) WHERE path = 'pom.xml'
    UNION ALL SELECT repo_id, k, json_extract_string(text, concat('$.', s, '."', k, '"')) FROM (SELECT repo_id, text, s, unnest(json_keys(text, '$.' || s)) AS k
      FROM v_contents CROSS JOIN (VALUES ('dependencies'), ('devDependencies')) y(s) WHERE path = 'package.json' AND json_valid(text)) x),
  vdeps AS (SELECT *, {_GROUP} AS "group" FROM vd)"""


@query("versioned_deps", ("v_contents",), f"{VDEPS_SQL} SELECT * FROM vdeps")
def versioned_deps(i: Inputs):
    return deps.versioned_deps(i.v_contents)


@query("dep_groups", ("v_contents",), f"""{VDEPS_SQL}, sh AS (SELECT *, list_last(string_split(name, ':')) AS short FROM vdeps WHERE "group" NOT IN ('other', 'code-gen', 'logging')),
  rk AS (SELECT *, row_number() OVER (PARTITION BY repo_id, "group" ORDER BY short, name) AS r, COUNT(*) OVER (PARTITION BY repo_id, "group") AS c FROM sh)
  SELECT repo_id, "group", string_agg(short, '|' ORDER BY r) AS names, greatest(MAX(c) - 1, 0) AS n_more FROM rk WHERE r <= 1 GROUP BY repo_id, "group\"""")
def dep_groups(i: Inputs):
    return deps.deps_by_group(deps.versioned_deps(i.v_contents), k=1).withColumn("names", text("names"))


_SIGS = ", ".join(f"({n}, '{k}', '{name}', {least})" for n, (k, name, _, _, least) in enumerate(fv.SIGNATURES))
_SIG_DEPS = ", ".join(f"({n}, '{d}')" for n, s in enumerate(fv.SIGNATURES) for d in s[3])
_SIG_FILES = ", ".join(f"({n}, '{f}')" for n, s in enumerate(fv.SIGNATURES) for f in s[2])
DETECT_SQL = f"""{DEPS_SQL}, ev AS (SELECT DISTINCT m.repo_id, s.i, 'd' || s.d AS e FROM mdeps m JOIN (VALUES {_SIG_DEPS}) s(i, d) ON contains(m.dep, s.d)
    UNION ALL SELECT f.repo_id, s.i, 'f' || s.f FROM v_files f JOIN (VALUES {_SIG_FILES}) s(i, f) ON f.path = s.f),
  detected AS (SELECT e.repo_id, s.kind, s.name, COUNT(*) AS score FROM ev e JOIN (VALUES {_SIGS}) s(i, kind, name, least) ON s.i = e.i GROUP BY e.repo_id, s.kind, s.name, s.least HAVING COUNT(*) >= s.least)"""


@query("framework_detect", ("v_contents", "v_files"), f"{DETECT_SQL} SELECT * FROM detected")
def framework_detect(i: Inputs):
    return deps.detect_signatures(deps.read_manifests(i.v_contents), i.v_files)


@query("framework_detect_table", ("v_contents", "v_files"), f"{DETECT_SQL} SELECT * FROM detected")
def framework_detect_table(i: Inputs):
    """The same signatures as a table, looked up by trigrams."""
    rows = [(n, kind, name, list(paths), list(names), least) for n, (kind, name, paths, names, least) in enumerate(fv.SIGNATURES)]
    table = i.spark.createDataFrame(rows, "sig INT, kind STRING, name STRING, paths ARRAY<STRING>, deps ARRAY<STRING>, min_score INT")
    return deps.detect_signatures(deps.read_manifests(i.v_contents), i.v_files, table)


def _lit(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_FWQ = ", ".join(f"({n}, {_lit(a)}, {_lit(b)}, {_lit(c)}, {_lit(d)})" for n, (a, b, c, d) in enumerate(fv.FRAMEWORK_QUESTIONS))
FWQ_SQL = f"""{DETECT_SQL}, fwq AS (SELECT d.repo_id, q.name AS framework, q.question, q.context, CAST(q.pos AS BIGINT) AS pos FROM detected d JOIN (VALUES {_FWQ}) q(pos, name, question, context, blocked) ON q.name = d.name
    WHERE d.kind IN ('framework', 'orm') AND (q.blocked IS NULL OR NOT EXISTS (SELECT 1 FROM mdeps m WHERE m.repo_id = d.repo_id AND m.dep = q.blocked)))"""


def framework_question_rows(i: Inputs):
    names = deps.read_manifests(i.v_contents)
    return deps.framework_questions(deps.detect_signatures(names, i.v_files), names)


@query("framework_questions", ("v_contents", "v_files"), f"{FWQ_SQL} SELECT * FROM fwq")
def framework_questions(i: Inputs):
    return framework_question_rows(i)


# --- pull requests --------------------------------------------------------------------------


def _prs(i: Inputs):
    raw = i.v_pr_json.select("repo_id", F.from_json("body", PULL_REQUEST_JSON).alias("p")).select("repo_id", "p.*")
    return prs.flatten_prs(raw)


_TEST = fv.TEST_FILE_PATTERNS["pull_request"]
PRS_SQL = f"""prs AS (SELECT repo_id, number, subject AS title, CASE WHEN is_merge THEN '' ELSE author END AS author,
    CASE WHEN number % 4 = 0 THEN NULL ELSE '2024-01-02 03:04:05' END AS merged_at, CASE WHEN number % 6 = 0 THEN 'Security' ELSE '' END AS labels,
    CASE WHEN number % 11 = 0 THEN '' ELSE array_to_string(list_sort(string_split(paths, '|')), '|') END AS files, added AS lines_added, removed AS lines_removed,
    CASE WHEN email = '' THEN 'lead' ELSE concat(email, '|lead') END AS reviewers, CAST(1 AS BIGINT) AS comment_count,
    number % 11 <> 0 AND len(list_filter(string_split(paths, '|'), lambda p: regexp_matches(p, '{_TEST}'))) > 0 AS has_tests,
    array_to_string(list_filter([CASE WHEN contains(lower(subject), 'breaking') THEN 'breaking-change' END, CASE WHEN contains(lower(subject), 'security') OR number % 6 = 0 THEN 'security' END,
      CASE WHEN contains(lower(subject), 'perf') THEN 'perf' END, CASE WHEN contains(lower(subject), 'fix') OR contains(lower(subject), 'bug') THEN 'bugfix' END,
      CASE WHEN contains(lower(subject), 'feat') THEN 'feature' END, CASE WHEN contains(lower(subject), 'refactor') THEN 'refactor' END,
      CASE WHEN contains(lower(subject), 'deps') OR contains(lower(subject), 'dependab') THEN 'dependencies' END], lambda x: x IS NOT NULL), '|') AS topics FROM v_pr_source)"""


@query("pr_flatten", ("v_pr_source",), f"{PRS_SQL} SELECT * FROM prs")
def pr_flatten(i: Inputs):
    lists = ("labels", "files", "reviewers", "topics")
    flat = _prs(i).drop("description", "base_branch").withColumn("merged_at", stamp("merged_at"))
    return flat.withColumn("files", F.array_sort("files")).withColumns({c: text(c) for c in lists})


@query("pr_tags", ("v_pr_source",), f"{PRS_SQL} SELECT repo_id, number, unnest(string_split(topics, '|')) AS topic FROM prs WHERE topics <> ''")
def pr_tags(i: Inputs):
    return prs.pr_tags(_prs(i))


_SUMS = """COUNT(*) AS n_prs, CAST(SUM(CASE WHEN files = '' THEN 0 ELSE len(string_split(files, '|')) END) AS BIGINT) AS files, CAST(SUM(lines_added) AS BIGINT) AS added,
  CAST(SUM(lines_removed) AS BIGINT) AS removed, CAST(count_if(has_tests) AS BIGINT) AS with_tests"""


@query("pr_summary", ("v_pr_source",), f"{PRS_SQL} SELECT repo_id, author, {_SUMS} FROM prs GROUP BY repo_id, author")
def pr_summary(i: Inputs):
    return prs.pr_summary(_prs(i))


@query("pr_summary_topic", ("v_pr_source",), f"{PRS_SQL} SELECT repo_id, topic, {_SUMS} FROM (SELECT *, unnest(string_split(topics, '|')) AS topic FROM prs WHERE topics <> '') x GROUP BY repo_id, topic")
def pr_summary_topic(i: Inputs):
    return prs.pr_summary(_prs(i), "topic")


# --- knowledge ------------------------------------------------------------------------------


@query("qa_pairs", ("v_qa",), """SELECT repo_id, turn, CASE WHEN starts_with(question, '[React] ') THEN 'React' ELSE '' END AS framework,
  CASE WHEN starts_with(question, '[React] ') THEN substr(question, 9) ELSE question END AS clean_question, starts_with(question, '[React] ') AS is_framework, answer FROM v_qa""")
def qa_pairs(i: Inputs):
    return questions.split_qa(i.v_qa).select("repo_id", "turn", "framework", "clean_question", "is_framework", "answer")


_KEY = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("question_dedup", ("v_qa",), f"""asked AS (SELECT repo_id, {_KEY.format("upper(question)")} AS k FROM v_qa WHERE turn > 1)
  SELECT q.repo_id, q.turn, q.question FROM v_qa q WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.repo_id = q.repo_id AND a.k = {_KEY.format('q.question')})""")
def question_dedup(i: Inputs):
    asked = i.v_qa.filter("turn > 1").select("repo_id", F.upper("question").alias("question"))
    return questions.new_questions(i.v_qa, asked).select("repo_id", "turn", "question")


_WORDS = "list_sort(list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+')))"


@query("similar_questions", ("v_qa",), f"""asked AS (SELECT concat('r', repo_no % 5) AS repo_id, repo_no * 1000 + turn * 10 AS id, question FROM v_qa
    UNION ALL SELECT concat('r', repo_no % 5), repo_no * 1000 + turn * 10 + 1, concat('Please tell: ', question, '?!') FROM v_qa WHERE repo_no % 3 = 0),
  w AS (SELECT *, {_WORDS} AS words FROM asked),
  near AS (SELECT a.repo_id, a.id, MIN(b.id) AS same_as FROM w a JOIN w b ON a.repo_id = b.repo_id AND b.id < a.id
    AND 100 * len(list_intersect(a.words, b.words)) >= 70 * len(list_distinct(list_concat(a.words, b.words))) WHERE len(a.words) > 0 GROUP BY a.repo_id, a.id)
  SELECT w.repo_id, w.id, w.question, n.same_as FROM w LEFT JOIN near n ON n.repo_id = w.repo_id AND n.id = w.id""")
def similar_questions(i: Inputs):
    """Questions of many conversations, a third of them asked again with words in front."""
    repo, number = F.concat(F.lit("r"), (F.col("repo_no") % 5).cast("string")), F.col("repo_no") * 1000 + F.col("turn") * 10
    asked = i.v_qa.select(repo.alias("repo_id"), number.alias("id"), "question")
    again = i.v_qa.filter("repo_no % 3 = 0").select(repo.alias("repo_id"), (number + 1).alias("id"), F.concat(F.lit("Please tell: "), F.col("question"), F.lit("?!")).alias("question"))
    return questions.similar_questions(asked.unionByName(again))


@query("unanswered", ("v_qa",), """SELECT 'c' || CAST(u.conv_id AS VARCHAR) AS repo_id, u.turn, CASE WHEN u.turn % 4 = 0 THEN '[React] ' || u.text ELSE u.text END AS question FROM conversations u
  WHERE u.role = 'user' AND NOT EXISTS (SELECT 1 FROM v_qa q WHERE q.repo_id = 'c' || CAST(u.conv_id AS VARCHAR)
    AND q.question = CASE WHEN u.turn % 4 = 0 THEN '[React] ' || u.text ELSE u.text END)""")
def unanswered(i: Inputs):
    asked = i.conversations.filter("role = 'user'").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("repo_id"),
        "turn",
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("[React] "), F.col("text"))).otherwise(F.col("text")).alias("question"),
    )
    # one short answer list per conversation turn, so no list grows with the data
    answers = i.v_qa.select("repo_id", F.array(F.struct("question", "answer")).alias("domain_qa"))
    return questions.unanswered(asked, answers).select("repo_id", "turn", "question")


@query("decision_index", ("v_decisions",), "SELECT repo_id, regexp_extract(id, '^[A-Z]+', 0) AS prefix, status, COUNT(*) AS n FROM v_decisions GROUP BY ALL")
def decision_index(i: Inputs):
    return knowledge.decision_index(i.v_decisions)


@query("maturity", ("v_decisions",), """SELECT repo_id, COUNT(DISTINCT session) AS sessions, CASE WHEN COUNT(DISTINCT session) <= 3 THEN 'New hire'
  WHEN COUNT(DISTINCT session) <= 10 THEN 'Contributing' ELSE 'Senior' END AS level FROM v_decisions GROUP BY repo_id""")
def maturity(i: Inputs):
    return knowledge.maturity(i.v_decisions)


@query("supersession", ("v_decisions",), """nxt AS (SELECT d.repo_id, d.id, s.id AS nxt_id FROM v_decisions d LEFT JOIN v_decisions s ON s.repo_id = d.repo_id AND s.id = d.superseded_by),
  walk AS (SELECT repo_id, id, id AS cur, 0 AS hops FROM nxt UNION ALL SELECT w.repo_id, w.id, n.nxt_id, w.hops + 1 FROM walk w JOIN nxt n ON n.repo_id = w.repo_id AND n.id = w.cur WHERE n.nxt_id IS NOT NULL)
  SELECT repo_id, id, arg_max(cur, hops) AS active_id, CAST(MAX(hops) AS BIGINT) AS hops FROM walk GROUP BY repo_id, id""")
def supersession(i: Inputs):
    return knowledge.active_decision(i.v_decisions)


@query("dependency_names", ("v_contents",), f"{VDEPS_SQL} SELECT repo_id, name, list_last(string_split(name, ':')) AS short FROM vdeps")
def dependency_names(i: Inputs):
    return deps.versioned_deps(i.v_contents).select("repo_id", "name", C.short_name("name").alias("short"))
