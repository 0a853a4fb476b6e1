"""Repository-shaped views over the driver's tables, as one SQL text that Spark and DuckDB both run.

One order is one commit, one order line one file change, one supplier one manifest file. A third
of the customers fall into repository ``r0``, so the views carry a hot key at every scale; the
number of repositories grows with the data. Every view reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.session import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _upper(word: str) -> str:
    return f"concat(upper(substr({word}, 1, 1)), substr({word}, 2))"


def _stem(w1: str, w2: str) -> str:
    return f"""CASE p_type
      WHEN 'ECONOMY' THEN concat({w1}, '-', {w2})
      WHEN 'SMALL' THEN concat({w1}, '_', {w2})
      WHEN 'MEDIUM' THEN concat({w1}, {_upper(w2)})
      WHEN 'PROMO' THEN concat({w1}, '_', {w2})
      WHEN 'STANDARD' THEN concat({w1}, '-', {w2}, '.test')
      ELSE concat({_upper(w1)}, {_upper(w2)}) END"""


def _lines(*parts: str) -> str:
    """SQL text of lines: each part is a SQL expression, joined by line feeds."""
    glued = ", chr(10), ".join(parts)
    return f"concat({glued})"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EXT = """CASE WHEN p_type = 'LARGE' THEN '.java' ELSE CASE w1 WHEN 'small' THEN '.ts' WHEN 'red' THEN '.ts'
      WHEN 'blue' THEN '.js' WHEN 'hot' THEN '.py' WHEN 'old' THEN '.go' WHEN 'large' THEN '.rs'
      WHEN 'new' THEN '.tsx' ELSE '.md' END END"""
_DIR = """CASE WHEN p_type = 'PROMO' AND w1 = 'old' THEN '' ELSE CASE p_type WHEN 'ECONOMY' THEN 'src/services/'
      WHEN 'SMALL' THEN 'src/services/billing/' WHEN 'MEDIUM' THEN 'src/controllers/' WHEN 'PROMO' THEN 'lib/utils/'
      WHEN 'STANDARD' THEN 'tests/unit/' ELSE 'src/main/java/com/acme/core/' END END"""
_NAME = f"concat({_upper('w1')}, {_upper('w2')})"

_SCRIPT = _lines(
    f"concat('import {{ a }} from ', chr(39), './', {_stem('w1', _q('gear'))}, '.js', chr(39), ';')",
    _q('import type { B } from "../models/none";'),
    f"concat('const c = require(', chr(39), '../controllers/', w1, 'Bolt', chr(39), ');')",
    "concat('const d = import(', chr(39), 'left-pad', chr(39), ');')",
    "CASE WHEN w2 = 'bolt' THEN '// TODO: tidy the bolt' WHEN w2 = 'gear' THEN '  // FIXME later' ELSE '' END",
    f"concat('export class ', {_NAME}, CASE WHEN w2 = 'ring' THEN 'Service' ELSE '' END, ' extends Base {{')",
    "CASE WHEN w2 = 'plate' THEN '  const password = get();' WHEN w2 = 'rod' THEN '  node.innerHTML = Either<a>;' ELSE '' END",
    "'}'",
    f"concat('export interface ', {_NAME}, 'Config {{}}')",
)
_PYTHON = _lines(
    "'import os'", "'from lib.utils.hot_gear import run'", "'from .local import x'", "''", "'@dataclass'",
    f"concat('class ', {_NAME}, '(Base, Mixin):')", "'    token = os.system(1)'", "''",
    f"concat('class ', {_NAME}, 'Helper:')", "'    pass'",
)
_JAVA = _lines(
    "'package com.acme.core;'", f"concat('import com.acme.core.', {_upper('w1')}, 'Gear;')", "'import java.util.List;'",
    "'import static com.acme.Util.run;'", "''",
    f"CASE WHEN w2 = 'bolt' THEN {_lines(_q('/**'), _q(' * Handles bolt orders.'), _q(' * @since 1'), _q(' */'))} ELSE '' END",
    "CASE WHEN w2 = 'ring' THEN '@Service' ELSE '@Getter' END", "'@AllArgsConstructor'",
    f"concat('public class ', {_NAME}, CASE WHEN w2 = 'rod' THEN 'Engine' ELSE '' END, ' extends Base implements Run<T>, Stop {{')",
    "concat(chr(9), '// HACK: rework ', w2)", "concat(chr(9), '@Autowired Repo repo; // ProblemHandling')", "'}'",
)
_GO = _lines(
    "'import ('", "concat(chr(9), '\"fmt\"')", "concat(chr(9), '\"os\"')", "')'", "'import \"net/http\"'", "''",
    f"concat('type ', {_NAME}, ' struct {{')", "'}'", f"concat('type ', {_NAME}, 'Port interface {{')", "'}'",
)
_RUST = _lines(
    "'use std::io;'", "'use crate::core;'", f"concat('pub struct ', {_NAME}, ' {{')", "'}'",
    f"concat('pub trait ', {_NAME}, 'Run {{')", "'}'", f"concat('enum ', {_NAME}, 'Kind {{')", "'}'",
)
_MARKDOWN = _lines(
    f"concat('# ', {_NAME})", "''", "concat('Lead text of ', w1, ' ', w2, '.')", "'  Second line.'", "''", "'Rest.'",
)

_SPECIAL_PATHS = (
    "package.json", "pom.xml", "go.mod", "Cargo.toml", "requirements.txt", "Gemfile", "Dockerfile",
    "docker-compose.yml", "README.md", "CONTRIBUTING.md", ".github/workflows/ci.yml", ".eslintrc.json",
    "package-lock.json", "go.sum", "src/index.ts", "manage.py", "prisma/schema.prisma", "Makefile", "turbo.json",
    "packages/core/index.ts",
)
_SPECIAL = {
    "package.json": """CASE WHEN s_nationkey % 5 = 0 THEN '{"broken":' ELSE concat('{"name":"app","description":"Service number ',
        CAST(s_suppkey AS STRING), '","dependencies":{"react":"^18.0.0","react-dom":"^18.0.0"',
        CASE WHEN s_nationkey % 2 = 0 THEN ',"next":"^14.0.0","ioredis":"1.2.3"' ELSE ',"express":"4.0.0","jsonwebtoken-jwt":"9"' END,
        '},"devDependencies":{"vitest":"^1.0.0","typescript":"^5.0.0"},"scripts":{"build":"tsc","test":"vitest","deploy":"x"}}') END""",
    "pom.xml": _lines(
        "'<project><name>Ledger</name>'",
        "CASE WHEN s_nationkey % 2 = 0 THEN '<description> Books of account </description>' ELSE '<description>none</description>' END",
        "'<dependency>'", "'  <groupId>org.springframework.boot</groupId>'",
        "'  <artifactId>spring-boot-starter-web</artifactId>'", "'  <version>3.2.0</version>'", "'</dependency>'",
        "'<dependency><groupId>org.projectlombok</groupId><artifactId>lombok</artifactId></dependency>'",
        "'<dependency><groupId>com.google.guava</groupId><artifactId>guava</artifactId></dependency>'",
        "'<plugin>spring-boot-maven-plugin</plugin></project>'",
    ),
    "go.mod": _lines("'module acme'", "'require ('", "concat(chr(9), 'github.com/gin-gonic/gin v1.9.0')", "concat(chr(9), 'gorm.io/gorm v1.25.0')", "')'"),
    "Cargo.toml": _lines("'[dependencies]'", "'axum = \"0.7\"'", "'serde-json = \"1\"'"),
    "requirements.txt": _lines("'# pinned'", "'Django>=4.2'", "'pytest'", "'-r base.txt'", "'SQLAlchemy[asyncio]==2.0'", "'redis ~= 5'"),
    "Gemfile": _lines("'source \"https://rubygems.org\"'", "concat('gem ', chr(39), 'activerecord', chr(39))", "'gem \"rspec\", \"~> 3\"'"),
    "docker-compose.yml": _lines(
        "'services:'", "'  web:'", "'    ports:'", "'      - \"8080:8080\"'", "'    depends_on:'",
        "concat('      - db', CAST(s_nationkey AS STRING))", "'      - \"cache\"'", "'  # a comment'",
        "concat('  db', CAST(s_nationkey AS STRING), ':')", "'    image: pg'", "'    ports:'", "'      - 5432:5432'",
        "'  cache:'", "'    image: redis'", "'volumes:'", "'  data:'",
    ),
    "README.md": _lines("concat('# App ', CAST(s_suppkey AS STRING))", "''", "concat('Keeps the books of nation ', CAST(s_nationkey AS STRING), '.')", "'Every day.'", "''", "'More.'"),
    "Makefile": _lines("'build: all'", "concat(chr(9), 'cc')", "'lint:'", "concat(chr(9), 'lint')", "'run-dev: build'"),
}


def _special_text() -> str:
    cases = " ".join(f"WHEN '{p}' THEN {sql}" for p, sql in _SPECIAL.items())
    return f"CASE path {cases} ELSE concat('content of ', path) END"


def _special_path() -> str:
    cases = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_SPECIAL_PATHS))
    return f"CASE CAST(s_suppkey % {len(_SPECIAL_PATHS)} AS INT) {cases} END"


# name -> (views it reads, SQL); driver tables are written <table>
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_commits": (
        (),
        """SELECT CASE WHEN o_custkey % 3 = 0 THEN 'r0'
            ELSE concat('r', CAST(CAST(floor(o_custkey / 100.0) AS BIGINT) AS STRING)) END AS repo_id,
          o_orderkey AS commit_id, concat('Dev ', CAST(o_custkey AS STRING)) AS author,
          CASE WHEN o_custkey % 7 = 0 THEN '' ELSE concat('u', CAST(CAST(floor(o_custkey / 2.0) AS BIGINT) AS STRING), '@example.com') END AS email,
          o_orderdate AS committed_at, (o_orderkey % 10 = 0) AS is_merge,
          CASE CAST(o_orderkey % 10 AS INT)
            WHEN 0 THEN CASE WHEN o_orderkey % 20 = 0
              THEN concat('Merge pull request #', CAST(o_orderkey AS STRING), ' from acme/feature/dev_', CAST(o_custkey AS STRING))
              ELSE concat('Join work (#', CAST(o_orderkey AS STRING), ')') END
            WHEN 5 THEN concat('PROJ-', CAST(o_orderkey AS STRING), ' price change')
            WHEN 6 THEN concat('fix: ', lower(o_orderpriority))
            WHEN 7 THEN concat('fixes #', CAST(o_orderkey AS STRING))
            WHEN 8 THEN CASE WHEN o_orderstatus = 'P' THEN 'breaking: migrate the ledger' ELSE concat('✨ polish ', lower(o_orderstatus)) END
            WHEN 9 THEN concat('update ', lower(o_orderpriority))
            ELSE concat('feat(core): order ', CAST(o_orderkey AS STRING)) END AS subject,
          CASE WHEN o_orderstatus = 'F' THEN '' ELSE concat('Priority ', o_orderpriority) END AS body
        FROM <orders>""",
    ),
    "v_parts": (
        (),
        f"""SELECT p_partkey, p_type, w1, w2, concat({_DIR}, {_stem('w1', 'w2')}, {_EXT}) AS path
        FROM (SELECT p_partkey, p_type, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM <part>) p""",
    ),
    "v_changes": (
        ("v_commits", "v_parts"),
        """SELECT c.repo_id, c.commit_id, c.committed_at, p.path,
          CAST(SUM(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS insertions,
          CAST(SUM(l.l_linenumber) AS BIGINT) AS deletions
        FROM <lineitem> l JOIN v_commits c ON c.commit_id = l.l_orderkey JOIN v_parts p ON p.p_partkey = l.l_partkey
        GROUP BY c.repo_id, c.commit_id, c.committed_at, p.path""",
    ),
    "v_tracked": (
        ("v_commits", "v_parts"),
        """SELECT DISTINCT c.repo_id, p.path, p.p_type, p.w1, p.w2
        FROM <lineitem> l JOIN v_commits c ON c.commit_id = l.l_orderkey JOIN v_parts p ON p.p_partkey = l.l_partkey
        WHERE NOT (p.w1 = 'old' AND p.w2 = 'gizmo')""",
    ),
    "v_special": (
        (),
        f"""SELECT concat('r', CAST(CAST(floor(s_suppkey * 3 / 20.0) AS BIGINT) AS STRING)) AS repo_id,
          {_special_path()} AS path, s_suppkey, s_nationkey FROM <supplier>""",
    ),
    "v_files": (
        ("v_tracked", "v_special"),
        "SELECT repo_id, path FROM v_tracked UNION ALL SELECT repo_id, path FROM v_special",
    ),
    "v_manifests": (("v_special",), f"SELECT repo_id, path, {_special_text()} AS text FROM v_special"),
    "v_sources": (
        ("v_tracked",),
        f"""SELECT repo_id, path, CASE
            WHEN p_type = 'LARGE' THEN {_JAVA}
            WHEN w1 IN ('small', 'red', 'blue', 'new') THEN {_SCRIPT}
            WHEN w1 = 'hot' THEN {_PYTHON} WHEN w1 = 'old' THEN {_GO} WHEN w1 = 'large' THEN {_RUST}
            ELSE {_MARKDOWN} END AS text
        FROM v_tracked""",
    ),
    "v_contents": (
        ("v_sources", "v_manifests"),
        "SELECT repo_id, path, text FROM v_sources UNION ALL SELECT repo_id, path, text FROM v_manifests",
    ),
    # last documentation update: the day of the repository's median-like order, by the earliest urgent commit
    "v_marks": (
        ("v_commits",),
        """SELECT repo_id, MIN(committed_at) AS first_at, MAX(committed_at) AS last_at,
          MAX(CASE WHEN subject = 'fix: 1-urgent' THEN committed_at END) AS last_updated
        FROM v_commits GROUP BY repo_id""",
    ),
    # the change set under review: the newest commit of every author
    "v_newest": (
        ("v_commits",),
        """SELECT repo_id, MAX(commit_id) AS change_id FROM v_commits GROUP BY repo_id, author""",
    ),
    "v_changeset": (
        ("v_changes", "v_newest"),
        """SELECT c.repo_id, c.commit_id AS change_id, c.path FROM v_changes c
        JOIN v_newest n ON n.repo_id = c.repo_id AND n.change_id = c.commit_id""",
    ),
    # pull requests as JSON text, one per order
    "v_pr_source": (
        ("v_commits", "v_changes"),
        """SELECT c.repo_id, c.commit_id AS number, c.author, c.subject, c.is_merge, c.email, f.paths, f.added, f.removed
        FROM v_commits c JOIN (SELECT repo_id, commit_id, string_agg(DISTINCT path, '|') AS paths,
            CAST(SUM(insertions) AS BIGINT) AS added, CAST(SUM(deletions) AS BIGINT) AS removed
          FROM v_changes GROUP BY repo_id, commit_id) f
        ON f.repo_id = c.repo_id AND f.commit_id = c.commit_id""",
    ),
    "v_pr_json": (
        ("v_pr_source",),
        """SELECT repo_id, concat('{"number":', CAST(number AS STRING), ',"title":"', subject, '","author":',
            CASE WHEN is_merge THEN 'null' ELSE concat('{"login":"', author, '"}') END,
            ',"additions":', CAST(added AS STRING), ',"deletions":', CAST(removed AS STRING),
            ',"mergedAt":', CASE WHEN number % 4 = 0 THEN 'null' ELSE '"2024-01-02T03:04:05Z"' END,
            ',"files":', CASE WHEN number % 11 = 0 THEN 'null' ELSE concat('[{"path":"', replace(paths, '|', '"},{"path":"'), '"}]') END,
            ',"labels":', CASE WHEN number % 6 = 0 THEN '[{"name":"Security"}]' ELSE '[]' END,
            ',"reviews":[{"author":{"login":"', email, '"}},{"author":null},{"author":{"login":"', email, '"}},{"author":{"login":"lead"}}]',
            ',"comments":[{"body":"ok"}]}') AS body
        FROM v_pr_source""",
    ),
    # question and answer pairs: a user turn and the next turn, when that is the assistant's
    "v_qa": (
        (),
        """SELECT u.conv_id AS repo_no, concat('c', CAST(u.conv_id AS STRING)) AS repo_id, u.turn,
          CASE WHEN u.turn % 4 = 0 THEN concat('[React] ', u.text) ELSE u.text END AS question, a.text AS answer
        FROM <conversations> u JOIN <conversations> a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    ),
    # decision records: every order is one; ten in a row of the same ending form a chain
    "v_decisions": (
        (),
        """SELECT concat('r', CAST(CAST(floor(o_orderkey / 1000.0) AS BIGINT) AS STRING)) AS repo_id,
          concat(prefix, '-', CAST(o_orderkey AS STRING)) AS id,
          CASE WHEN o_orderstatus = 'F' THEN 'active' WHEN o_orderstatus = 'O' THEN 'superseded' ELSE 'current' END AS status,
          concat('s', CAST(o_custkey % 12 AS STRING)) AS session,
          CASE WHEN o_orderkey % 100 < 90 AND o_custkey % 9 > 0 THEN concat(prefix, '-', CAST(o_orderkey + 10 AS STRING)) END AS superseded_by
        FROM (SELECT o_orderkey, o_custkey, o_orderstatus, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'ARCH' WHEN 1 THEN 'CONV'
          WHEN 2 THEN 'REJ' WHEN 3 THEN 'DOM' ELSE 'KNOW' END AS prefix FROM <orders>) o""",
    ),
    # team rule files, from the suppliers
    "v_rule_files": (
        (),
        """SELECT concat('r', CAST(CAST(floor(s_suppkey * 3 / 20.0) AS BIGINT) AS STRING)) AS repo_id,
          CASE WHEN s_suppkey % 7 = 0 THEN 'code-review.rules' ELSE concat('.cursor/rules/r', CAST(s_suppkey AS STRING), '.md') END AS path,
          CASE WHEN s_suppkey % 7 = 0 THEN concat('rule:', chr(10), '  Description: "Keep ', s_name, '"', chr(10), '  Description:"Test it"')
            ELSE concat('---', chr(10), 'globs: x', chr(10), '---', chr(10), chr(10), 'Mind ', s_name, ' well.', chr(10)) END AS text
        FROM <supplier>""",
    ),
    # answers a person gave: one row per repository that has a manifest of the kind
    "v_answered": (
        ("v_special",),
        """SELECT repo_id, COUNT(*) AS n_files, MIN(s_nationkey) AS low, MAX(s_nationkey) AS high,
          MAX(CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 0 END) AS third
        FROM v_special GROUP BY repo_id""",
    ),
    # documents as files of a repository named by their source
    "v_docs": (
        (),
        """SELECT source AS repo_id, concat('docs/', CAST(doc_id AS STRING), '.', lang) AS path, lang AS language, text FROM <documents>""",
    ),
}


def _order(names: tuple[str, ...]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in done:
            done.append(name)

    for name in names:
        visit(name)
    return done


def with_views(*names: str) -> str:
    """``WITH`` clause of the views for the oracle, driver tables by their own names."""
    parts = []
    for name in _order(names):
        sql = VIEWS[name][1]
        for table in TABLES:
            sql = sql.replace(f"<{table}>", table)
        parts.append(f"{name} AS ({sql})")
    return "WITH RECURSIVE " + ",\n".join(parts)


def input_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the files of the driver's tables, read from their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sf_dir)
    return files.agg(F.sum("length")).first()[0] or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # texts cost far more per row than they weigh
    return spread(df) if name == "documents" else df


def _changes(lineitem: DataFrame, commits: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of ``v_changes``. Parts come first, so that the join of the commits deals the lines as their grouping needs them."""
    lines = lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "path", "l_quantity", "l_linenumber")
    return (
        lines.join(commits, F.col("l_orderkey") == F.col("commit_id"))
        .groupBy("repo_id", "commit_id", "committed_at", "path")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("insertions"), F.sum("l_linenumber").alias("deletions"))
    )


def view(spark: SparkSession, sf_dir: str, name: str, written: dict[str, DataFrame] | None = None) -> DataFrame:
    """A test view as a DataFrame; Catalyst inlines it, so only the used columns are read.

    ``written`` holds views that were written as tables, for themselves and for all views over them.
    """
    if written and name in written:
        return written[name]
    needed, sql = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n, written) for n in needed}
    if name == "v_changes":
        return _changes(table(spark, sf_dir, "lineitem"), inputs["v_commits"], inputs["v_parts"])
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in needed:
        sql = sql.replace(f" {n} ", f" {{{n}}} ").replace(f" {n}\n", f" {{{n}}}\n")
        if sql.endswith(f" {n}"):
            sql = sql[: -len(n)] + f"{{{n}}}"
    for n in TABLES:
        if f"<{n}>" in sql:
            inputs[n] = table(spark, sf_dir, n)
            sql = sql.replace(f"<{n}>", f"{{{n}}}")
    return spark.sql(sql, **inputs)
