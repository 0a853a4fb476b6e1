"""Confidence score, gaps, uplift by answers, documentation health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv

#: command names that satisfy each part of the build score
COMMAND_KINDS = (
    ("build", ("build",)),
    ("test", ("test",)),
    ("run", ("run", "dev", "start", "run-local")),
    ("lint", ("lint", "typecheck", "format")),
)
#: fact columns of ``confidence_facts`` with the value a repository without the fact gets
FACT_DEFAULTS = {
    "description": None,
    "root_package": "",
    "primary_language": None,
    "n_commands": 0,
    "commands": "",
    "has_build": False,
    "has_test": False,
    "has_run": False,
    "has_lint": False,
    "build_explicit": False,
    "test_explicit": False,
    "run_explicit": False,
    "lint_explicit": False,
    "style": "unknown",
    "n_entry_points": 0,
    "n_layers": 0,
    "n_api_patterns": 0,
    "n_services": 0,
    "n_patterns": 0,
    "n_types": 0,
    "n_rules": 0,
    "n_conventions": 0,
    "commit_style": "unknown",
    "branch_pattern": "",
    "n_todos": 0,
    "n_test_frameworks": 0,
    "layout": "none",
}


def command_facts(commands: DataFrame) -> DataFrame:
    """Which command kinds exist and whether the first of each comes from an explicit script."""
    source = F.col("source")
    explicit = C.any_of([F.contains(source, F.lit(w)) for w in ("package.json", "Makefile", "scripts")])
    order = F.struct("pos", "name", "command")
    aggs = [F.count(F.lit(1)).alias("n_commands")]
    for kind, names in COMMAND_KINDS:
        hit = F.col("name").isin(*names)
        aggs.append(F.bool_or(hit).alias(f"has_{kind}"))
        aggs.append(F.coalesce(F.min_by(explicit, F.when(hit, order)), F.lit(False)).alias(f"{kind}_explicit"))
    # a repository has a bounded handful of commands, so the list is safe to collect
    listed = F.array_sort(F.collect_list(F.struct("pos", "command")))
    aggs.append(F.array_join(F.transform(listed, lambda c: c["command"]), "; ").alias("commands"))
    return commands.groupBy("repo_id").agg(*aggs)


def confidence_facts(repos: DataFrame, *frames: DataFrame) -> DataFrame:
    """One wide fact row per repository from per-repository frames; absent facts get their default.

    The frames are stacked and folded by one grouping, instead of a chain of joins on ``repo_id``.
    """
    stacked = repos.select("repo_id", F.lit(True).alias("_known"))
    present = set()
    for frame in frames:
        keep = [c for c in frame.columns if c in FACT_DEFAULTS]
        present.update(keep)
        stacked = stacked.unionByName(frame.select("repo_id", *keep), allowMissingColumns=True)
    folded = (
        stacked.groupBy("repo_id")
        .agg(F.max("_known").alias("_known"), *[F.max(c).alias(c) for c in sorted(present)])
        .filter("_known")
    )
    columns = []
    for name, default in FACT_DEFAULTS.items():
        kind = {bool: "boolean", int: "bigint"}.get(type(default), "string")
        value = F.lit(default).cast(kind)
        columns.append((F.coalesce(F.col(name), value) if name in present else value).alias(name))
    return folded.select("repo_id", *columns)


def _points(condition: Column, points: int, otherwise: int = 0) -> Column:
    return F.when(condition, points).otherwise(otherwise)


def _dimensions() -> list[tuple[str, Column, Column]]:
    """(dimension, score, details) as expressions over the fact row."""
    c = F.col
    text = lambda name, suffix: F.concat(c(name).cast("string"), F.lit(suffix))
    described, language = c("description").isNotNull(), c("primary_language").isNotNull()
    build, build_details = F.lit(0), []
    for kind, _ in COMMAND_KINDS:
        build = build + F.when(c(f"has_{kind}"), _points(c(f"{kind}_explicit"), 5, 3)).otherwise(0)
        build_details.append(
            F.when(c(f"has_{kind}"), F.when(c(f"{kind}_explicit"), f"{kind} (explicit)").otherwise(f"{kind} (inferred)"))
        )
    return [
        (
            "Project Identity",
            _points(described, 12) + _points(c("root_package") != "", 4, 1) + _points(language, 4),
            F.array(
                F.when(described, "description from source"),
                F.when(c("root_package") != "", "package structure"),
                c("primary_language"),
            ),
        ),
        ("Build & Run", build, F.array(*build_details)),
        (
            "Architecture",
            F.least(
                F.lit(20),
                _points(c("style") != "unknown", 5)
                + _points(c("n_entry_points") > 0, 4)
                + _points(c("n_layers") > 0, 4)
                + _points(c("n_api_patterns") > 0, 4)
                + _points(c("n_services") > 0, 3),
            ),
            F.array(
                F.when(c("style") != "unknown", F.concat(F.lit("style: "), c("style"))),
                F.when(c("n_entry_points") > 0, text("n_entry_points", " entry points")),
                F.when(c("n_layers") > 0, text("n_layers", " layers")),
                F.when(c("n_api_patterns") > 0, text("n_api_patterns", " API patterns")),
                F.when(c("n_services") > 0, text("n_services", " services")),
            ),
        ),
        (
            "Code Patterns",
            F.least(
                F.lit(15),
                F.least(F.lit(9), c("n_patterns") * 3) + F.least(F.lit(6), C.js_round(c("n_types") / F.lit(5))),
            ),
            F.array(
                F.when(c("n_patterns") > 0, text("n_patterns", " patterns found")),
                F.when(c("n_types") > 0, text("n_types", " key types")),
            ),
        ),
        (
            "Domain Context",
            F.least(
                F.lit(15),
                F.least(F.lit(5), c("n_rules") * 2)
                + F.least(F.lit(4), c("n_conventions") * 2)
                + _points(c("commit_style") != "unknown", 2)
                + _points(c("branch_pattern") != "", 2)
                + _points(c("n_todos") > 0, 2),
            ),
            F.array(
                F.when(c("n_rules") > 0, text("n_rules", " team rules")),
                F.when(c("n_conventions") > 0, text("n_conventions", " conventions")),
                F.when(c("commit_style") != "unknown", F.concat(F.lit("commit: "), c("commit_style"))),
                F.when(c("branch_pattern") != "", "branch pattern"),
                F.when(c("n_todos") > 0, text("n_todos", " TODOs")),
            ),
        ),
        (
            "Testing",
            _points(c("n_test_frameworks") > 0, 3) + _points(c("layout") != "none", 3) + _points(c("has_test"), 4, 1),
            F.array(
                F.when(c("n_test_frameworks") > 0, text("n_test_frameworks", " test frameworks")),
                F.when(c("layout") != "none", F.concat(F.lit("structure: "), c("layout"))),
                F.when(c("has_test"), "test command"),
            ),
        ),
    ]


def confidence_score(facts: DataFrame) -> DataFrame:
    """Six dimension rows per repository: score, max, details (AGG-19)."""
    maximum = dict(fv.DIMENSION_MAX)
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("pos"),
            F.lit(name).alias("dimension"),
            score.cast("bigint").alias("score"),
            F.lit(maximum[name]).cast("bigint").alias("max"),
            F.array_compact(details).alias("details"),
        )
        for i, (name, score, details) in enumerate(_dimensions())
    ]
    return facts.select("repo_id", F.explode(F.array(*rows)).alias("r")).select("repo_id", "r.*")


def score_total(scores: DataFrame) -> DataFrame:
    """Total and grade per repository (AGG-19, PRJ-16)."""
    return (
        scores.groupBy("repo_id").agg(F.sum("score").alias("total")).withColumn("grade", C.grade("total"))
    )


def gaps(facts: DataFrame) -> DataFrame:
    """What the score misses: dimension, question, context, impact; high impact first by ``pos`` (AGG-19, TOP-07)."""
    scored = {name: score for name, score, _ in _dimensions()}
    c = F.col
    missing = F.array_join(
        F.array_compact(
            F.array(
                F.when(~c("has_build"), "build"), F.when(~c("has_test"), "test"), F.when(~c("has_run"), "run/start")
            )
        ),
        ", ",
    )
    domain, testing = scored["Domain Context"], scored["Testing"]
    no_domain, no_tests = domain == 0, testing == 0
    lit = F.lit

    def gap(when: Column, dimension: str, question, context, impact) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else lit(v)
        return F.when(
            when,
            F.struct(
                lit(dimension).alias("dimension"),
                as_col(question).alias("question"),
                as_col(context).alias("context"),
                as_col(impact).alias("impact"),
            ),
        )

    found = F.array_compact(
        F.array(
            gap(c("description").isNull(), "Project Identity", "What does this project do? Describe its purpose in 1-2 sentences.", "No project description found in README, package.json, or pom.xml. Generated a generic fallback.", "high"),
            gap(c("primary_language").isNull(), "Project Identity", "What is the primary programming language for this project?", "Could not detect the primary language from file extensions.", "high"),
            gap(
                scored["Build & Run"] < 10,
                "Build & Run",
                F.concat(lit("What are the commands to "), missing, lit(" this project?")),
                F.concat(lit("Only found "), c("n_commands").cast("string"), lit(" commands. Missing: "), missing, lit(".")),
                "high",
            ),
            gap(c("style") == "unknown", "Architecture", "How is this codebase organized? (e.g., monolith, microservices, monorepo, library)", "Could not confidently determine the architecture style.", "high"),
            gap(c("n_entry_points") == 0, "Architecture", "What are the main entry points to this application?", "No entry points detected (e.g., main class, index file, server startup).", "medium"),
            gap(c("n_layers") == 0, "Architecture", "What are the main layers or modules in this codebase? (e.g., API → service → repository → database)", "No layered architecture detected.", "medium"),
            gap(c("n_patterns") == 0, "Code Patterns", "What patterns or idioms should developers follow in this codebase? (e.g., DI style, error handling, naming conventions)", "No code patterns detected from static analysis.", "medium"),
            gap(
                domain < 8,
                "Domain Context",
                "What domain-specific rules or gotchas should developers know about? Any tribal knowledge not in code?",
                F.when(no_domain, "No team rules, conventions, or domain documentation found.").otherwise(
                    "Limited domain context found — mostly inferred from git history."
                ),
                F.when(no_domain, "high").otherwise("medium"),
            ),
            gap(
                testing < 6,
                "Testing",
                "How do you run tests? Any conventions for test organization, naming, or mocking?",
                F.when(no_tests, "No test framework or test structure detected.").otherwise(
                    "Found test framework but limited info on how tests are organized and run."
                ),
                F.when(no_tests, "high").otherwise("low"),
            ),
        )
    )
    rank = F.when(c("g.impact") == "high", 0).when(c("g.impact") == "medium", 1).otherwise(2)
    return (
        facts.select("repo_id", F.posexplode(found).alias("i", "g"))
        .select("repo_id", "g.*", (rank * 100 + c("i")).cast("bigint").alias("pos"))
    )


def _answered() -> dict[str, Column]:
    filled = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    listed = lambda name: F.coalesce(F.size(name), F.lit(0)) > 0
    return {
        "Project Identity": filled("project_description"),
        "Build & Run": listed("build_commands"),
        "Architecture": filled("architecture_notes"),
        "Code Patterns": listed("code_patterns"),
        "Domain Context": listed("domain_context"),
        "Testing": filled("testing_notes"),
    }


def uplift(scores: DataFrame, answers: DataFrame) -> DataFrame:
    """Dimension scores after human answers (AGG-20)."""
    a = _answered()
    qa = F.coalesce(F.size("domain_qa"), F.lit(0))
    score, top, dim = F.col("score"), F.col("max"), F.col("dimension")
    domain = F.least(top, score + F.when(a["Domain Context"], 10).otherwise(0))
    domain = F.least(top, domain + F.least(F.lit(10), qa * 3))
    boosted = (
        F.when((dim == "Project Identity") & a["Project Identity"], top)
        .when((dim == "Build & Run") & a["Build & Run"], top)
        .when((dim == "Architecture") & a["Architecture"], F.least(top, score + 10))
        .when((dim == "Code Patterns") & a["Code Patterns"], F.least(top, score + 8))
        .when(dim == "Domain Context", domain)
        .when((dim == "Testing") & a["Testing"], F.least(top, score + 5))
        .otherwise(score)
    )
    return scores.join(answers, "repo_id", "left").select(
        "repo_id", "pos", "dimension", boosted.cast("bigint").alias("score"), "max"
    )


def open_gaps(gap_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Gaps whose dimension nobody has answered (AGG-20)."""
    done = answers.select(
        "repo_id",
        F.explode(F.array_compact(F.array(*[F.when(cond, name) for name, cond in _answered().items()]))).alias("dimension"),
    )
    return gap_rows.join(done, ["repo_id", "dimension"], "left_anti")


def doc_health(files: DataFrame, since: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Documentation score per repository: 20 per expected file, 5 off each stale one (AGG-21).

    ``since`` is the result of ``commits_since``; all existing files are stale together.
    """
    present = files.groupBy("repo_id").agg(
        *[F.coalesce(F.bool_or(F.col("path") == p), F.lit(False)).cast("bigint").alias(f"f{i}") for i, p in enumerate(expected)]
    )
    existing = sum((F.col(f"f{i}") for i in range(1, len(expected))), F.col("f0"))
    joined = present.select("repo_id", existing.alias("existing")).join(since, "repo_id", "left")
    stale = F.when(F.coalesce("stale", F.lit(False)), F.col("existing")).otherwise(F.lit(0).cast("bigint"))
    raw = C.js_round((F.col("existing") * 20 - F.col("n_stale") * 5) / F.lit(len(expected) * 20) * 100)
    return (
        joined.withColumn("n_stale", stale)
        .withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("bigint"))
        .select(
            "repo_id",
            "score",
            C.grade("score", fv.HEALTH_CUTS).alias("grade"),
            (F.lit(len(expected)).cast("bigint") - F.col("existing")).alias("n_missing"),
            "n_stale",
            F.coalesce("n_commits", F.lit(0).cast("bigint")).alias("n_commits"),
        )
    )


def doc_issues(files: DataFrame, health: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Missing files as errors, staleness as a warning (AGG-21)."""
    repos = health.select("repo_id", F.explode(F.array(*[F.lit(p) for p in expected])).alias("path"))
    missing = repos.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select(
        "repo_id", F.lit("error").alias("severity"), F.concat(F.lit("Missing file: "), F.col("path")).alias("message")
    )
    stale = health.filter("n_stale > 0").select(
        "repo_id",
        F.lit("warning").alias("severity"),
        F.concat(
            F.col("n_stale").cast("string"), F.lit(" files may be stale ("), F.col("n_commits").cast("string"),
            F.lit(" commits since last update)"),
        ).alias("message"),
    )
    return missing.unionByName(stale)


def rubric_score(rubric: DataFrame) -> DataFrame:
    """Eight 0..5 dimensions to a 0..100 total per run, and how many fall short (AGG-36)."""
    return rubric.groupBy("repo_id", "run_id").agg(
        (F.sum("score") * F.lit(fv.RUBRIC_FACTOR)).alias("total"),
        F.count_if(F.col("score") < 5).alias("n_gaps"),
    )
