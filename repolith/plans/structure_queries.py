"""Queries over file lists, directories, imports and types."""

from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv
from repolith.operators import history, imports, reach, review, structure, types
from repolith.plans.history_queries import FREQ_SQL, HOT_SQL, MISSING_SQL, _missing
from repolith.plans.registry import Inputs, query, text
from repolith.session import stage

SEG = "string_split(path, '/')"
EXT = r"regexp_extract(path, '[^/](\.[^./]*)$', 1)"
LANG = f"CASE lower({EXT}) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in fv.EXTENSION_LANGUAGES.items()) + " END"
IGNORED = "[" + ", ".join(f"'{d}'" for d in fv.IGNORED_DIRS) + "]"
ANC = f"""anc AS (SELECT repo_id, path, array_to_string(list_slice({SEG}, 1, k), '/') AS dir, k AS depth
  FROM (SELECT repo_id, path, unnest(generate_series(1, len({SEG}) - 1)) AS k FROM v_files) x)"""
COUNTED = f"{FREQ_SQL}, counted AS (SELECT f.repo_id, f.path, coalesce(q.change_count, 0) AS n FROM v_files f LEFT JOIN freq q ON q.repo_id = f.repo_id AND q.path = f.path)"
# candidates by comparing every directory with every source prefix of its repository
MODULES = f"""{COUNTED}, {ANC}, dirs AS (SELECT DISTINCT repo_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM v_files WHERE contains(path, '/')),
  prefixes AS (SELECT DISTINCT repo_id, regexp_extract(d, concat('^((?:[^/]+/)*?', s, ')/'), 1) AS p FROM dirs
    CROSS JOIN (VALUES {', '.join(f"('{p}')" for p in fv.SOURCE_PREFIXES)}) x(s) WHERE regexp_matches(d, concat('^((?:[^/]+/)*?', s, ')/'))),
  cand AS (SELECT DISTINCT a.repo_id, a.dir FROM anc a JOIN prefixes p ON p.repo_id = a.repo_id AND starts_with(a.dir, p.p || '/')
    AND a.depth - len(string_split(p.p, '/')) BETWEEN 1 AND 4),
  tot AS (SELECT a.repo_id, a.dir, COUNT(*) AS file_count, CAST(SUM(c.n) AS BIGINT) AS change_count FROM anc a
    JOIN counted c ON c.repo_id = a.repo_id AND c.path = a.path GROUP BY a.repo_id, a.dir),
  roots AS (SELECT t.* FROM tot t JOIN cand c ON c.repo_id = t.repo_id AND c.dir = t.dir WHERE file_count >= 3),
  keyf AS (SELECT repo_id, dir, string_agg(path, '|' ORDER BY r) AS key_files FROM (SELECT a.repo_id, a.dir, a.path,
    row_number() OVER (PARTITION BY a.repo_id, a.dir ORDER BY c.n DESC, a.path) AS r FROM anc a JOIN counted c ON c.repo_id = a.repo_id AND c.path = a.path) x
    WHERE r <= 5 GROUP BY repo_id, dir),
  modules AS (SELECT r.repo_id, r.dir, p.dir AS parent_dir, r.file_count, r.change_count, k.key_files FROM roots r
    JOIN keyf k ON k.repo_id = r.repo_id AND k.dir = r.dir
    LEFT JOIN roots p ON p.repo_id = r.repo_id AND p.dir = regexp_extract(r.dir, '^(.*)/[^/]*$', 1))"""
LINES = "lines AS (SELECT repo_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM v_contents)"


def _case_ext(patterns) -> str:
    whens = []
    for exts, pattern in patterns:
        names = ", ".join(f"'{e}'" for e in exts)
        whens.append(f"WHEN {EXT} IN ({names}) THEN regexp_extract(line, '{pattern}', 1)")
    return "CASE " + " ".join(whens) + " END"


CLASSES = f"{LINES}, classes AS (SELECT * FROM (SELECT repo_id, path, line_no, {_case_ext(types.CLASS_NAME_PATTERNS)} AS class_name FROM lines) x WHERE class_name <> '')"
CFLAGS = """cflags AS (SELECT a.repo_id, a.dir, COUNT(*) AS n_classes, """ + ", ".join(
    f"bool_or(ends_with(c.class_name, '{s}')) AS s{i}" for i, (s, _) in enumerate(fv.CLASS_SUFFIX_PURPOSES)
) + """ FROM anc a JOIN classes c ON c.repo_id = a.repo_id AND c.path = a.path GROUP BY a.repo_id, a.dir)"""
NAME = "lower(regexp_extract(m.dir, '([^/]*)$', 1))"
PURPOSE = (
    f"CASE {NAME} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.DIRECTORY_PURPOSES.items()) + " ELSE CASE "
    + " ".join(f"WHEN contains({NAME}, '{k}') THEN '{v}'" for k, v in fv.DIRECTORY_PURPOSES.items())
    + " " + " ".join(f"WHEN s{i} THEN '{p}'" for i, (_, p) in enumerate(fv.CLASS_SUFFIX_PURPOSES))
    + " ELSE concat(m.file_count, ' files') END END"
)
DESCRIBED = f"{MODULES}, {CLASSES}, {CFLAGS}, described AS (SELECT m.*, {PURPOSE} AS description, coalesce(f.n_classes, 0) AS n_classes FROM modules m LEFT JOIN cflags f ON f.repo_id = m.repo_id AND f.dir = m.dir)"
HOTDIRS = f"""{MODULES}, {CLASSES}, {CFLAGS}, kept AS (SELECT m.repo_id, m.dir, m.change_count FROM modules m LEFT JOIN cflags f ON f.repo_id = m.repo_id AND f.dir = m.dir
    WHERE m.file_count >= 3 AND m.change_count >= 5 AND NOT regexp_matches(m.dir, '^src/(main|test)(/resources)?$')
    AND NOT (list_contains(string_split(m.dir, '/'), 'java') AND len(string_split(m.dir, '/')) - list_position(string_split(m.dir, '/'), 'java') + 1 <= 3)
    AND (coalesce(f.n_classes, 0) > 0 OR NOT EXISTS (SELECT 1 FROM modules c WHERE c.repo_id = m.repo_id AND c.parent_dir = m.dir))),
  hotd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY change_count DESC, dir) AS rank FROM kept) x WHERE rank <= 10)"""


@query("path_parts", ("v_files",), f"""SELECT repo_id, path, lower({EXT}) AS ext, {SEG}[len({SEG})] AS name,
  regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, {SEG}[1] AS top_dir, len({SEG}) AS depth FROM v_files""")
def path_parts(i: Inputs):
    return structure.path_columns(i.v_files)


@query("kept_files", ("v_files",), f"SELECT repo_id, path, {LANG} AS language FROM v_files WHERE len(list_intersect({SEG}, {IGNORED})) = 0")
def kept_files(i: Inputs):
    return structure.with_language(structure.drop_ignored(i.v_files))


LANGS_SQL = f"""lf AS (SELECT repo_id, {LANG} AS language FROM v_files WHERE len(list_intersect({SEG}, {IGNORED})) = 0),
  lc AS (SELECT repo_id, language, COUNT(*) AS files FROM lf WHERE language IS NOT NULL GROUP BY ALL),
  langs AS (SELECT repo_id, language, files, CAST(floor(files / CAST(SUM(files) OVER (PARTITION BY repo_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage,
    row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, language) = 1 AS is_primary FROM lc)"""


@query("language_share", ("v_files",), f"{LANGS_SQL} SELECT * FROM langs")
def language_share(i: Inputs):
    return structure.language_share(i.v_files)


def _layout_sql(source: str, variant: str) -> str:
    sep = " OR ".join(f"starts_with(path, '{d}')" for d in fv.TEST_DIRS)
    hit = f"regexp_matches(path, '{fv.TEST_FILE_PATTERNS[variant]}')"
    return f"""tl AS (SELECT repo_id, CAST(count_if({hit} AND NOT ({sep})) AS BIGINT) AS colocated, CAST(count_if({hit} AND ({sep})) AS BIGINT) AS separate FROM {source} GROUP BY repo_id),
  layouts AS (SELECT *, CASE WHEN colocated = 0 AND separate = 0 THEN 'none' WHEN colocated > 0 AND separate > 0 THEN 'mixed'
    WHEN colocated > separate THEN 'colocated' ELSE 'separate-dir' END AS layout FROM tl)"""


LAYOUT_SQL = _layout_sql("v_files", "architecture")


@query("test_layout", ("v_files",), f"{LAYOUT_SQL} SELECT * FROM layouts")
def test_layout(i: Inputs):
    return structure.test_layout(i.v_files)


@query("test_layout_log", ("v_changes",), f"p AS (SELECT DISTINCT repo_id, path FROM v_changes), {_layout_sql('p', 'convention')} SELECT * FROM layouts")
def test_layout_log(i: Inputs):
    return structure.test_layout(structure.changed_paths(i.v_changes), "convention")


FACT_ROWS = ", ".join(f"({n}, '{k}', '{p}', {str(d).lower()}, '{label}')" for n, (k, p, d, label) in enumerate(fv.PATH_FACTS))
FACTS_SQL = f"""rules AS (SELECT * FROM (VALUES {FACT_ROWS}) r(pos, kind, rule_path, is_dir, label)),
  facts AS (SELECT DISTINCT f.repo_id, r.kind, r.label, r.rule_path AS path, r.pos FROM v_files f JOIN rules r
    ON (NOT r.is_dir AND f.path = r.rule_path) OR (r.is_dir AND starts_with(f.path, r.rule_path || '/')))"""


@query("path_facts", ("v_files",), f"{FACTS_SQL} SELECT repo_id, kind, label, path FROM facts")
def path_facts(i: Inputs):
    return structure.path_facts(i.v_files).drop("pos")


@query("coverage_levels", ("v_files",), f"""{FACTS_SQL}, k AS (SELECT repo_id, count_if(kind = 'doc') AS d, count_if(kind = 'ci') AS c FROM facts GROUP BY repo_id),
  r AS (SELECT DISTINCT repo_id FROM v_files)
  SELECT r.repo_id, CASE WHEN d >= 3 THEN 'high' WHEN d >= 2 THEN 'medium' WHEN d >= 1 THEN 'low' ELSE 'none' END AS docs,
  CASE WHEN c >= 2 THEN 'full' WHEN c = 1 THEN 'partial' ELSE 'none' END AS ci FROM r LEFT JOIN k ON k.repo_id = r.repo_id""")
def coverage_levels(i: Inputs):
    kinds = structure.path_facts(i.v_files).groupBy("repo_id").agg(
        F.count_if(F.col("kind") == "doc").alias("d"), F.count_if(F.col("kind") == "ci").alias("c")
    )
    # a repository without any such file is reported too
    kinds = i.v_files.select("repo_id").distinct().join(kinds, "repo_id", "left")
    return kinds.select("repo_id", C.doc_coverage(F.col("d")).alias("docs"), C.ci_coverage(F.col("c")).alias("ci"))


@query("files_with_frequency", ("v_files", "v_changes"), f"{COUNTED} SELECT * FROM counted")
def files_with_frequency(i: Inputs):
    return structure.files_with_frequency(i.v_files, history.file_frequency(i.v_changes))


@query("ancestors", ("v_files",), f"{ANC} SELECT * FROM anc")
def ancestors(i: Inputs):
    return structure.explode_ancestors(i.v_files)


def _modules(i: Inputs):
    return structure.module_rollup(i.v_files, history.file_frequency(i.v_changes))


def _flags(i: Inputs):
    return structure.dir_class_flags(types.class_names(i.v_contents))


@query("module_rollup", ("v_files", "v_changes"), f"{MODULES} SELECT * FROM modules")
def module_rollup(i: Inputs):
    return _modules(i).withColumn("key_files", text("key_files"))


@query("module_roots", ("v_files", "v_changes"), f"""{MODULES} SELECT repo_id, dir, file_count, change_count FROM modules m
  WHERE NOT EXISTS (SELECT 1 FROM modules o WHERE o.repo_id = m.repo_id AND starts_with(m.dir, o.dir || '/'))""")
def module_roots(i: Inputs):
    return structure.module_roots(i.v_files, history.file_frequency(i.v_changes)).select("repo_id", "dir", "file_count", "change_count")


@query("module_purpose", ("v_files", "v_changes", "v_contents"), f"{DESCRIBED} SELECT repo_id, dir, description, n_classes FROM described")
def module_purpose(i: Inputs):
    return structure.module_purpose(_modules(i), _flags(i)).select("repo_id", "dir", "description", "n_classes")


@query("meaningful_modules", ("v_files", "v_changes", "v_contents"), f"""{DESCRIBED} SELECT repo_id, dir, description, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY repo_id ORDER BY change_count DESC, dir) AS rank FROM described WHERE NOT ends_with(description, 'files')) x WHERE rank <= 12""")
def meaningful_modules(i: Inputs):
    described = structure.module_purpose(_modules(i), _flags(i))
    return structure.meaningful_modules(described).select("repo_id", "dir", "description", "rank")


@query("hot_dirs", ("v_files", "v_changes", "v_contents"), f"{HOTDIRS} SELECT * FROM hotd")
def hot_dirs(i: Inputs):
    return structure.hot_dirs(_modules(i), _flags(i))


@query("hot_dir_modules", ("v_files", "v_changes", "v_contents"), f"""{HOTDIRS} SELECT h.repo_id, h.dir, h.rank, m.file_count, m.change_count, m.key_files
  FROM hotd h JOIN modules m ON m.repo_id = h.repo_id AND m.dir = h.dir""")
def hot_dir_modules(i: Inputs):
    modules = _modules(i)
    hot = structure.hot_dirs(modules, _flags(i))
    return structure.hot_dir_modules(hot, modules).drop("parent_dir").withColumn("key_files", text("key_files"))


def _labelled(rules) -> str:
    tests = {"contains": "contains(path, '{}')", "equals": "path = '{}'", "endswith": "ends_with(path, '{}')"}
    parts = [
        f"CASE WHEN bool_or({' OR '.join(tests[t].format(v) for v in vals)}) THEN '{label}' END" for label, t, vals in rules
    ]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '|')"


def _under(*dirs: str) -> str:
    return "bool_or(" + " OR ".join(f"starts_with(path, '{d}/')" for d in dirs) + ")"


def _has(words) -> str:
    return "bool_or(" + " OR ".join(f"contains(path, '{w}')" for w in words) + ")"


_ENTRIES = [p for k, p, _, _ in fv.PATH_FACTS if k == "entry_point"]
ARCH_SQL = f"""af AS (SELECT repo_id, {_under('packages')} AS pk, {_under('apps')} AS ap, {_under('services')} AS sv,
    bool_or(path IN ({', '.join(f"'{w}'" for w in fv.WORKSPACE_FILES)})) AS ws, count_if(path = 'pom.xml' OR ends_with(path, '/pom.xml')) AS poms,
    {_has(('docker-compose', *fv.SERVICE_REGISTRY_WORDS))} AS dc, bool_or(path IN ('src/index.ts', 'src/lib.rs')) AS li, {_has(fv.SERVER_WORDS)} AS srv,
    {_labelled([(e, 'equals', (e,)) for e in _ENTRIES])} AS entry_points,
    array_to_string(list_filter([{', '.join(f"CASE WHEN {_under(d, 'src/' + d, 'app/' + d)} THEN '{d}' END" for d in fv.LAYER_DIRS)}], lambda x: x IS NOT NULL), '|') AS layers,
    {_labelled(fv.DATABASE_PATTERNS)} AS db_patterns, {_labelled(fv.API_PATTERNS)} AS api_patterns, bool_or(path = 'Dockerfile') AS has_docker,
    {_under(*fv.IAC_DIRS)} OR bool_or(path IN ('docker-compose.yml', 'docker-compose.yaml')) AS has_iac FROM v_files GROUP BY repo_id),
  arch AS (SELECT repo_id, CASE WHEN (pk OR ap) AND ws THEN 'monorepo' WHEN pk AND ap THEN 'monorepo' WHEN sv THEN 'microservices'
    WHEN poms >= 3 AND dc THEN 'microservices' WHEN li AND NOT srv THEN 'library' ELSE 'monolith' END AS style,
    entry_points, layers, db_patterns, api_patterns, has_docker, has_iac FROM af)"""


@query("architecture_facts", ("v_files",), f"{ARCH_SQL} SELECT * FROM arch")
def architecture_facts(i: Inputs):
    lists = ("entry_points", "layers", "db_patterns", "api_patterns")
    return structure.architecture(i.v_files).withColumns({c: text(c) for c in lists})


@query("key_modules", ("v_files",), f"""SELECT DISTINCT repo_id, {SEG}[1] AS module FROM v_files WHERE contains(path, '/')
  AND NOT starts_with(path, '.') AND {SEG}[1] NOT IN ({', '.join(f"'{d}'" for d in fv.NON_MODULE_DIRS)})""")
def key_modules(i: Inputs):
    return structure.key_modules(i.v_files)


CONFIG_ROWS = ", ".join(f"('{p}', '{t}', '{s}')" for p, t, s in fv.CONFIG_FILES)


@query("config_inventory", ("v_files",), f"""SELECT f.repo_id, f.path, r.type, r.summary FROM v_files f JOIN (VALUES {CONFIG_ROWS}) r(path, type, summary) ON r.path = f.path
  UNION ALL SELECT repo_id, path, 'spring', concat('Environment-specific Spring config (', {SEG}[len({SEG})], ')') FROM v_files WHERE regexp_matches(path, 'application-\\w+\\.yml$')""")
def config_inventory(i: Inputs):
    return structure.config_inventory(i.v_files)


ROOT_SQL = f"""rp AS (SELECT repo_id, MIN(CASE WHEN ends_with(path, '.java') AND contains(path, 'src/main/java/') THEN path END) AS f, bool_or(starts_with(path, 'src/')) AS s
    FROM v_files GROUP BY repo_id),
  rootp AS (SELECT repo_id, CASE WHEN f IS NOT NULL THEN array_to_string(list_slice(string_split(regexp_extract(f, 'src/main/java/(.*)/[^/]*$', 1), '/'), 1, 4), '.')
    WHEN s THEN 'src/' ELSE '' END AS root_package FROM rp)"""


@query("root_package", ("v_files",), f"{ROOT_SQL} SELECT * FROM rootp")
def root_package(i: Inputs):
    return structure.root_package(i.v_files)


# --- imports --------------------------------------------------------------------------------


def _all(pattern: str, source: str = "text") -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_extract_all({source}, '{pattern}', 1)"


IMPORTS_SQL = f"""spec_lists AS (SELECT repo_id, path AS src, CASE
    WHEN {EXT} IN ('.ts', '.tsx', '.js', '.jsx', '.mjs') THEN {_all(r'''(?m)^import\s+(?:type\s+)?(?:[^'"]*\s+from\s+)?['"]([^'"]+)['"]''')}
      || {_all(r'''\bimport\s*\(\s*['"]([^'"]+)['"]\s*\)''')} || {_all(r'''\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)''')}
    WHEN {EXT} = '.java' THEN {_all(r'(?m)^import\s+(?:static\s+)?([\w.]+)\s*;')}
    WHEN {EXT} = '.py' THEN {_all(r'(?m)^from\s+([\w.]+)\s+import')} || {_all(r'(?m)^import\s+([\w.]+)')}
    WHEN {EXT} = '.go' THEN {_all(r'"([^"]+)"', r"regexp_extract(text, '(?s)import\s*\((.*?)\)', 1)")} || {_all(r'(?m)^import\s+"([^"]+)"')}
    WHEN {EXT} = '.rs' THEN {_all(r'(?m)^use\s+([\w:]+)')} END AS specs FROM v_contents WHERE regexp_matches(path, '{fv.IMPORT_SOURCE}')),
  imps AS (SELECT repo_id, src, unnest(specs) AS spec, generate_subscripts(specs, 1) - 1 AS pos FROM spec_lists)"""
# './x' and '../x' from a directory; deeper climbs do not occur in the views
RESOLVE_SQL = IMPORTS_SQL + r""", based AS (SELECT *, CASE WHEN starts_with(spec, '.') THEN 'relative' WHEN ends_with(src, '.java') THEN 'java' WHEN ends_with(src, '.py') THEN 'python' END AS kind,
    regexp_extract(src, '^(.*)/[^/]*$', 1) AS dir FROM imps),
  keyed AS (SELECT *, CASE WHEN kind = 'relative' THEN ltrim(CASE
      WHEN starts_with(spec, './') THEN concat(dir, '/', substr(spec, 3))
      WHEN starts_with(spec, '../') THEN CASE WHEN dir = '' THEN concat('~/../', substr(spec, 4)) WHEN contains(dir, '/') THEN concat(regexp_extract(dir, '^(.*)/[^/]*$', 1), '/', substr(spec, 4)) ELSE substr(spec, 4) END
      ELSE concat(dir, '/', spec) END, '/') ELSE replace(spec, '.', '/') END AS base FROM based),
  tries AS (SELECT repo_id, src, pos, unnest(c) AS path, generate_subscripts(c, 1) - 1 AS rule_pos FROM (SELECT *, CASE
      WHEN kind = 'relative' THEN [base, regexp_replace(base, '\.js$', '.ts'), base || '/index.ts', base || '.ts', base || '.ts', base || '/index.ts',
        base || '.tsx', base || '.tsx', base || '/index.tsx', base || '.js', base || '.ts', base || '/index.js', base || '.jsx', base || '.jsx', base || '/index.jsx', base || '.mjs', base || '.mjs', base || '/index.mjs']
      WHEN kind = 'java' THEN ['src/main/java/' || base || '.java', 'src/' || base || '.java', base || '.java']
      WHEN kind = 'python' THEN [base || '.py', base || '/__init__.py'] END AS c FROM keyed) x),
  found AS (SELECT t.repo_id, t.src, t.pos, arg_min(t.path, t.rule_pos) AS dst, MIN(t.rule_pos) AS rule_pos FROM tries t
    JOIN v_files f ON f.repo_id = t.repo_id AND f.path = t.path GROUP BY ALL),
  resolved AS (SELECT k.repo_id, k.src, k.pos, k.spec, f.dst, f.rule_pos FROM keyed k LEFT JOIN found f ON f.repo_id = k.repo_id AND f.src = k.src AND f.pos = k.pos),
  edges AS (SELECT repo_id, src, dst, COUNT(*) AS mult FROM resolved WHERE dst IS NOT NULL GROUP BY ALL),
  fanin AS (SELECT repo_id, dst AS file, CAST(SUM(mult) AS BIGINT) AS n_imports, COUNT(*) AS fan_in FROM edges GROUP BY ALL),
  topfan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n_imports DESC, file) AS rank FROM fanin) x WHERE rank <= 30)"""


@query("import_statements", ("v_contents",), f"{IMPORTS_SQL} SELECT * FROM imps")
def import_statements(i: Inputs):
    return imports.extract_imports(i.v_contents)


def _resolved(i: Inputs):
    return imports.resolve_imports(imports.extract_imports(i.v_contents), i.v_files)


@query("import_resolution", ("v_contents", "v_files"), f"{RESOLVE_SQL} SELECT * FROM resolved")
def import_resolution(i: Inputs):
    return _resolved(i)


@query("import_edges", ("v_contents", "v_files"), f"{RESOLVE_SQL} SELECT * FROM edges")
def import_edges(i: Inputs):
    return imports.import_edges(_resolved(i))


@query("fan_in", ("v_contents", "v_files"), f"{RESOLVE_SQL} SELECT * FROM topfan")
def fan_in(i: Inputs):
    return imports.fan_in(imports.import_edges(_resolved(i)))


START_SQL = "start AS (SELECT DISTINCT repo_id, path AS changed FROM v_changeset)"


# the longest shortest way in the views has three steps
@query("blast_radius", ("v_contents", "v_files", "v_changeset"), f"""{RESOLVE_SQL}, {START_SQL},
  walk AS (SELECT repo_id, changed, changed AS importer, 0 AS hop FROM start
    UNION SELECT w.repo_id, w.changed, e.src, w.hop + 1 FROM walk w JOIN edges e ON e.repo_id = w.repo_id AND e.dst = w.importer WHERE w.hop < 20)
  SELECT repo_id, changed, importer, CAST(MIN(hop) AS BIGINT) AS hop FROM walk WHERE importer <> changed GROUP BY repo_id, changed, importer""")
def blast_radius(i: Inputs):
    return imports.blast_radius(i.v_changeset, imports.import_edges(_resolved(i)))


@query("blast_radius_near", ("v_contents", "v_files", "v_changeset"), f"""{RESOLVE_SQL}, {START_SQL},
  one AS (SELECT DISTINCT s.repo_id, s.changed, e.src AS importer FROM start s JOIN edges e ON e.repo_id = s.repo_id AND e.dst = s.changed WHERE e.src <> s.changed),
  two AS (SELECT DISTINCT o.repo_id, o.changed, e.src AS importer FROM one o JOIN edges e ON e.repo_id = o.repo_id AND e.dst = o.importer WHERE e.src <> o.changed)
  SELECT repo_id, changed, importer, CAST(MIN(hop) AS BIGINT) AS hop FROM (SELECT *, 1 AS hop FROM one UNION ALL SELECT *, 2 FROM two) x GROUP BY repo_id, changed, importer""")
def blast_radius_near(i: Inputs):
    return imports.blast_radius(i.v_changeset, imports.import_edges(_resolved(i)), hops=2)


@query("reach_chains", (), """WITH RECURSIVE n AS (SELECT CAST(floor(o_orderkey / 500.0) AS BIGINT) AS r, o_orderkey AS k FROM orders),
  walk AS (SELECT r, k AS origin, k AS node, 0 AS hop FROM n WHERE k % 250 = 3
    UNION ALL SELECT w.r, w.origin, n.k, w.hop + 1 FROM walk w JOIN n ON n.r = w.r AND n.k = w.node + 1)
  SELECT concat('r', r) AS repo_id, CAST(origin AS VARCHAR) AS origin, CAST(node AS VARCHAR) AS node, CAST(hop AS BIGINT) AS hop FROM walk WHERE hop > 0""")
def reach_chains(i: Inputs):
    """Orders that follow each other by number, five hundred to a chain: far more steps than are walked one by one."""
    of = F.concat(F.lit("r"), F.floor(F.col("o_orderkey") / 500).cast("string"))
    nodes = i.orders.select(of.alias("repo_id"), F.col("o_orderkey").alias("k"))
    text = lambda c: c.cast("string")
    after = nodes.select("repo_id", (F.col("k") - 1).alias("k"), text(F.col("k")).alias("b"))
    steps = nodes.join(after, ["repo_id", "k"]).select("repo_id", text(F.col("k")).alias("a"), "b")
    start = nodes.filter("k % 250 = 3").select("repo_id", text(F.col("k")).alias("origin"))
    return reach.reachable(start, steps)


@query("change_risk", ("v_changes", "v_changeset", "v_contents", "v_files"), f"""{HOT_SQL}, {MISSING_SQL.replace(FREQ_SQL + ',', '')}, {RESOLVE_SQL},
  am AS (SELECT repo_id, change_id, changed, COUNT(*) AS n FROM absent GROUP BY ALL),
  j AS (SELECT c.repo_id, c.change_id, c.path, h.rank AS hot_rank, coalesce(f.fan_in, 0) AS fan_in, coalesce(a.n, 0) AS n_missing FROM v_changeset c
    LEFT JOIN hot h ON h.repo_id = c.repo_id AND h.path = c.path LEFT JOIN fanin f ON f.repo_id = c.repo_id AND f.file = c.path
    LEFT JOIN am a ON a.repo_id = c.repo_id AND a.change_id = c.change_id AND a.changed = c.path)
  SELECT *, CASE CAST(hot_rank IS NOT NULL AS INT) + CAST(fan_in > 0 AS INT) + CAST(n_missing > 0 AS INT)
    WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS risk FROM j""")
def change_risk(i: Inputs):
    # written, so that nothing of the imports is left on disk when the partners are met
    fan = stage(imports.fan_in(imports.import_edges(_resolved(i)), k=None), "fan_in")
    missing = _missing(i)
    return review.change_risk(i.v_changeset, history.hot_files(i.v_changes), fan, missing)


# --- types ----------------------------------------------------------------------------------


@query("class_names", ("v_contents",), f"{CLASSES} SELECT * FROM classes")
def class_names(i: Inputs):
    return types.class_names(i.v_contents)


_ROLE = "CASE " + " ".join(
    f"WHEN {'ends_with' if end else 'contains'}(name, '{w}') THEN '{r}'" for w, end, r in fv.TYPE_ROLES
) + " ELSE '' END"
_JAVA = types._JAVA_DECL
_TRIM = "trim(line, ' ' || chr(9))"
TYPES_SQL = f"""{LINES}, loc AS (SELECT repo_id, path, MAX(line_no) AS loc FROM lines GROUP BY ALL),
  jd AS (SELECT repo_id, path, MIN(line_no) AS at FROM lines WHERE ends_with(path, '.java') AND regexp_matches({_TRIM}, '{_JAVA}') GROUP BY ALL),
  ja AS (SELECT l.repo_id, l.path, string_agg(regexp_extract({_TRIM}, '@\\w+', 0), '|' ORDER BY l.line_no) FILTER (WHERE starts_with({_TRIM}, '@')) AS annotations,
    string_agg(trim(regexp_replace({_TRIM}, '^[\\s/*]+', '')), ' ' ORDER BY l.line_no) FILTER (WHERE starts_with({_TRIM}, '* ') AND NOT starts_with({_TRIM}, '* @')) AS doc
    FROM lines l JOIN jd ON jd.repo_id = l.repo_id AND jd.path = l.path AND l.line_no <= jd.at GROUP BY ALL),
  t0 AS (SELECT l.repo_id, l.path AS file, l.line_no, regexp_extract(l.line, '{_JAVA}', 2) AS name, regexp_extract(l.line, '{_JAVA}', 1) AS kind,
      concat_ws('|', nullif(regexp_extract(l.line, '{_JAVA}', 3), ''), nullif(regexp_replace(regexp_replace(regexp_extract(l.line, '{_JAVA}', 4), '<[^,]*', '', 'g'), '\\s*,\\s*', '|', 'g'), '')) AS super_types,
      coalesce(a.annotations, '') AS annotations, a.doc FROM lines l JOIN jd ON jd.repo_id = l.repo_id AND jd.path = l.path AND l.line_no = jd.at
      JOIN ja a ON a.repo_id = l.repo_id AND a.path = l.path
    UNION ALL SELECT repo_id, path, line_no, regexp_extract({_TRIM}, '{types._SCRIPT_DECL}', 2), regexp_extract({_TRIM}, '{types._SCRIPT_DECL}', 1), '', '', NULL
      FROM lines WHERE {EXT} IN ('.ts', '.tsx') AND regexp_matches({_TRIM}, '{types._SCRIPT_DECL}')
    UNION ALL SELECT l.repo_id, l.path, l.line_no, regexp_extract(line, '{types._PYTHON_DECL}', 1), 'class', regexp_replace(regexp_extract(line, '{types._PYTHON_DECL}', 2), '\\s*,\\s*', '|', 'g'),
      CASE WHEN contains(right(array_to_string(list_slice(string_split(c.text, chr(10)), 1, l.line_no - 1), chr(10)) || chr(10), 100), '@dataclass') THEN '@dataclass' ELSE '' END, NULL
      FROM lines l JOIN v_contents c ON c.repo_id = l.repo_id AND c.path = l.path WHERE ends_with(l.path, '.py') AND regexp_matches(line, '{types._PYTHON_DECL}')
    UNION ALL SELECT repo_id, path, line_no, regexp_extract(line, '{types._GO_DECL}', 1), regexp_extract(line, '{types._GO_DECL}', 2), '', '', NULL FROM lines WHERE ends_with(path, '.go') AND regexp_matches(line, '{types._GO_DECL}')
    UNION ALL SELECT repo_id, path, line_no, regexp_extract(line, '{types._RUST_DECL}', 2), regexp_extract(line, '{types._RUST_DECL}', 1), '', '', NULL FROM lines WHERE ends_with(path, '.rs') AND regexp_matches(line, '{types._RUST_DECL}')),
  types AS (SELECT t.repo_id, t.file, t.line_no, t.name, t.kind, t.super_types, t.annotations,
    CASE WHEN regexp_matches(t.file, '\\.(java|ts|tsx)$') THEN l.loc ELSE 0 END AS loc,
    coalesce(t.doc, CASE WHEN contains(t.annotations, '@Service') THEN 'service' END, {_ROLE}) AS description
    FROM t0 t JOIN loc l ON l.repo_id = t.repo_id AND l.path = t.file)"""


@query("type_declarations", ("v_contents",), f"{TYPES_SQL} SELECT * FROM types")
def type_declarations(i: Inputs):
    return types.extract_types(i.v_contents).withColumns({c: text(c) for c in ("super_types", "annotations")})


KEY_TYPES_SQL = f"""{TYPES_SQL}, keyt AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.repo_id ORDER BY loc DESC, file, line_no) AS rank FROM types t
    WHERE NOT contains(file, 'test') AND NOT contains(file, 'Test')) x WHERE rank <= 60)"""


@query("key_types", ("v_contents", "v_changes"), f"{KEY_TYPES_SQL} SELECT repo_id, file, name, kind, loc, description, rank FROM keyt")
def key_types(i: Inputs):
    found = types.key_types(types.extract_types(i.v_contents))
    return found.select("repo_id", "file", "name", "kind", "loc", "description", "rank")


@query("types_in_dir", ("v_contents", "v_files", "v_changes"), f"""{HOTDIRS}, {TYPES_SQL.replace(LINES + ',', '')},
  r AS (SELECT h.repo_id, h.dir, t.file, t.name, row_number() OVER (PARTITION BY h.repo_id, h.dir ORDER BY t.loc DESC, t.file, t.name) AS rank
    FROM hotd h JOIN types t ON t.repo_id = h.repo_id AND starts_with(t.file, h.dir || '/')) SELECT * FROM r WHERE rank <= 10""")
def types_in_dir(i: Inputs):
    hot = structure.hot_dirs(_modules(i), _flags(i))
    found = structure.types_in_dir(types.extract_types(i.v_contents), hot)
    return found.select("repo_id", "dir", "file", "name", "rank")


USAGE_SQL = f"""{TYPES_SQL}, used AS (SELECT repo_id, file, line_no, unnest(string_split(annotations, '|')) AS annotation FROM types WHERE annotations <> ''),
  usage AS (SELECT repo_id, annotation, COUNT(*) AS n FROM used GROUP BY ALL)"""


@query("annotation_usage", ("v_contents",), f"""{USAGE_SQL}, ex AS (SELECT repo_id, annotation, string_agg(file, '|' ORDER BY r) AS examples FROM (SELECT *,
    row_number() OVER (PARTITION BY repo_id, annotation ORDER BY file, line_no) AS r FROM used) x WHERE r <= 3 GROUP BY ALL)
  SELECT u.repo_id, u.annotation, u.n, e.examples FROM usage u JOIN ex e ON e.repo_id = u.repo_id AND e.annotation = u.annotation""")
def annotation_usage(i: Inputs):
    return types.annotation_usage(types.extract_types(i.v_contents)).withColumn("examples", text("examples"))


def _literal_sql(source: str, patterns) -> str:
    parts = [
        f"SELECT repo_id, '{name}' AS pattern, CAST(count_if({' OR '.join(f'''contains(text, '{x}')''' for x in lits)}) AS BIGINT) AS n_files, count_if({' OR '.join(f'''contains(text, '{x}')''' for x in lits)}) > {limit} AS present FROM {source} GROUP BY repo_id"
        for name, lits, limit in patterns
    ]
    return " UNION ALL ".join(parts)


PREVALENCE_SQL = f"prevalence AS ({_literal_sql('v_contents', fv.CODE_PATTERNS)})"
TESTLIB_SQL = f"""testf AS (SELECT * FROM v_contents WHERE regexp_matches(path, '{fv.TEST_FILE_PATTERNS['library']}')), testlib AS ({_literal_sql('testf', fv.TEST_LIBRARY_PATTERNS)})"""


@query("pattern_prevalence", ("v_contents", "v_changes"), f"{PREVALENCE_SQL} SELECT * FROM prevalence")
def pattern_prevalence(i: Inputs):
    return types.pattern_prevalence(i.v_contents)


@query("test_conventions", ("v_contents",), f"{TESTLIB_SQL} SELECT * FROM testlib")
def test_conventions(i: Inputs):
    return types.test_conventions(i.v_contents)


def code_pattern_rows(i: Inputs):
    found = types.extract_types(i.v_contents)
    return types.code_patterns(
        types.annotation_usage(found), types.pattern_prevalence(i.v_contents), types.test_conventions(i.v_contents)
    )


CODE_SQL = f"""{USAGE_SQL}, {PREVALENCE_SQL}, {TESTLIB_SQL},
  cfx AS (SELECT r.repo_id, coalesce(bool_or(u.annotation IN ({', '.join(f"'{a}'" for a in fv.LOMBOK_ANNOTATIONS)})), false) AS lombok,
    coalesce(MAX(CASE WHEN u.annotation = '@AllArgsConstructor' THEN u.n END), 0) AS allargs FROM (SELECT DISTINCT repo_id FROM v_contents) r LEFT JOIN usage u ON u.repo_id = r.repo_id GROUP BY ALL),
  pfx AS (SELECT repo_id, MAX(CASE WHEN pattern = 'either' THEN n_files END) AS e, MAX(CASE WHEN pattern = 'problem' THEN n_files END) AS p, MAX(CASE WHEN pattern = 'autowired' THEN n_files END) AS a FROM prevalence GROUP BY ALL),
  tfx AS (SELECT repo_id, bool_or(present) AS t FROM testlib GROUP BY ALL),
  codep AS (SELECT c.repo_id, unnest(list_filter([CASE WHEN lombok THEN 'Lombok annotations' END, CASE WHEN e > 3 THEN 'Vavr Either for error handling' END,
    CASE WHEN p > 0 THEN 'RFC 7807 Problem responses' END, CASE WHEN allargs > 5 AND coalesce(a, 0) < allargs THEN 'Constructor injection via Lombok' WHEN a > 5 THEN 'Mixed dependency injection' END,
    CASE WHEN t THEN 'Test conventions' END], lambda x: x IS NOT NULL)) AS pattern FROM cfx c LEFT JOIN pfx p ON p.repo_id = c.repo_id LEFT JOIN tfx t ON t.repo_id = c.repo_id)"""


@query("code_patterns", ("v_contents", "v_changes"), f"{CODE_SQL} SELECT * FROM codep")
def code_patterns(i: Inputs):
    return code_pattern_rows(i)
