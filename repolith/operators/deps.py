"""Dependencies and technology detection from package manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv
from repolith.functions.ranking import collect_ranked, top_k
from repolith.operators.rules import literal_hits
from repolith.session import rule_frame

_PACKAGE = "dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>"
_PYTHON_MANIFESTS = ("requirements.txt", "requirements-dev.txt", "Pipfile")


def _all(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def read_manifests(contents: DataFrame) -> DataFrame:
    """Dependency names per manifest: repo_id, manifest, dep (SRC-05). Broken JSON gives no rows."""
    path, text = F.col("path"), F.col("text")
    package = F.from_json(text, _PACKAGE)
    empty = F.array().cast("array<string>")
    keys = lambda c: F.coalesce(F.map_keys(c), empty)
    names = F.concat(keys(package["dependencies"]), keys(package["devDependencies"]))
    python = F.filter(
        F.transform(
            F.split(text, "\n"), lambda x: F.lower(F.element_at(F.split(C.strip(x), r"[=<>!~\s\[]"), 1))
        ),
        lambda d: (d != "") & ~d.startswith("#") & ~d.startswith("-"),
    )
    deps = (
        F.when(path == "package.json", names)
        .when((path == "pom.xml") | path.endswith("/pom.xml"), _all(text, r"<artifactId>(.+?)</artifactId>"))
        .when(path == "go.mod", _all(text, r"\t(.+?)\s"))
        .when(path == "Cargo.toml", _all(text, r"(?m)^(\w[\w-]*)\s*="))
        .when(path.isin(*_PYTHON_MANIFESTS), python)
        .when(path == "Gemfile", _all(text, r"""gem\s+['"](.+?)['"]"""))
    )
    return contents.select(
        "repo_id", path.alias("manifest"), F.explode(F.array_distinct(deps)).alias("dep")
    )


def versioned_deps(contents: DataFrame) -> DataFrame:
    """Dependencies with version and group (AGG-14): pom entries once per group:artifact, package entries as listed."""
    path, text = F.col("path"), F.col("text")
    pattern = (
        r"(?s)<dependency>\s*<groupId>(.+?)</groupId>\s*<artifactId>(.+?)</artifactId>(?:\s*<version>(.+?)</version>)?"
    )
    blocks = F.arrays_zip(
        _all(text, pattern, 1).alias("g"), _all(text, pattern, 2).alias("a"), _all(text, pattern, 3).alias("v")
    )
    maven = (
        contents.filter((path == "pom.xml") | path.endswith("/pom.xml"))
        .select("repo_id", "path", F.posexplode(blocks).alias("pos", "d"))
        .select(
            "repo_id",
            F.concat(F.col("d.g"), F.lit(":"), F.col("d.a")).alias("name"),
            F.coalesce(F.col("d.v"), F.lit("")).alias("version"),
            F.struct("path", "pos").alias("at"),
        )
        .groupBy("repo_id", "name")
        .agg(F.min_by("version", "at").alias("version"))
    )
    package = F.from_json(text, _PACKAGE)
    entries = lambda c: F.coalesce(
        F.map_entries(c), F.array().cast("array<struct<key: string, value: string>>")
    )
    listed = (
        contents.filter(path == "package.json")
        .select(
            "repo_id",
            F.explode(F.concat(entries(package["dependencies"]), entries(package["devDependencies"]))).alias("d"),
        )
        .select("repo_id", F.col("d.key").alias("name"), F.col("d.value").alias("version"))
    )
    return maven.unionByName(listed).withColumn("group", C.dependency_group("name"))


def deps_by_group(deps: DataFrame, k: int = 5, hidden: Sequence[str] = fv.HIDDEN_GROUPS) -> DataFrame:
    """First names per group and how many more there are (AGG-13)."""
    shown = deps.filter(~F.col("group").isin(*hidden)).withColumn("short", C.short_name("name"))
    counts = shown.groupBy("repo_id", "group").agg(F.count(F.lit(1)).alias("n"))
    names = (
        top_k(shown, k, ["repo_id", "group"], [F.asc("short"), F.asc("name")])
        .groupBy("repo_id", "group")
        .agg(collect_ranked("rank", "short").alias("names"))
    )
    return counts.join(names, ["repo_id", "group"]).select(
        "repo_id", "group", "names", F.greatest(F.col("n") - k, F.lit(0)).alias("n_more")
    )


def detect_signatures(deps: DataFrame, files: DataFrame, signatures: Sequence[tuple] | DataFrame = fv.SIGNATURES) -> DataFrame:
    """Frameworks, test frameworks, build tools and ORMs with enough evidence (JOIN-04).

    A dependency counts when it contains the signature's name. For a list of signatures that test runs as
    expressions on each distinct dependency; a table of them, (sig, kind, name, paths, deps, min_score), may have any
    size and is looked up by trigrams. Files are found by an equi-join; only hits are shuffled.
    """
    known = deps.select("repo_id", "dep").distinct()
    if isinstance(signatures, DataFrame):
        info = signatures.select("sig", "kind", "name", "min_score")
        literals = signatures.select("sig", F.explode(F.array_distinct("deps")).alias("literal"))
        by_dep = literal_hits(known, literals, text="dep").select("repo_id", "sig", F.concat(F.lit("dep "), F.col("literal")).alias("evidence"))
        table = signatures.select("sig", F.explode("paths").alias("path")).withColumn("evidence", F.concat(F.lit("file "), F.col("path")))
    else:
        hits = F.array_compact(
            F.array(
                *[
                    F.when(F.contains("dep", F.lit(d)), F.struct(F.lit(i).alias("sig"), F.lit(f"dep {d}").alias("evidence")))
                    for i, (_, _, _, names, _) in enumerate(signatures)
                    for d in names
                ]
            )
        )
        by_dep = known.select("repo_id", F.explode(hits).alias("h")).select("repo_id", "h.*")
        rows = [(f, i, f"file {f}") for i, (_, _, paths, _, _) in enumerate(signatures) for f in paths]
        table = rule_frame(files.sparkSession, rows, "path STRING, sig INT, evidence STRING")
        info = rule_frame(
            files.sparkSession,
            [(i, kind, name, least) for i, (kind, name, _, _, least) in enumerate(signatures)],
            "sig INT, kind STRING, name STRING, min_score INT",
        )
    by_file = files.select("repo_id", "path").join(table, "path").select("repo_id", "sig", "evidence")
    scored = (
        by_dep.unionByName(by_file)
        .distinct()
        .groupBy("repo_id", "sig")
        .agg(F.count(F.lit(1)).alias("score"))
    )
    return (
        scored.join(info, "sig").filter("score >= min_score").select("repo_id", "kind", "name", "score")
    )


def framework_questions(
    detected: DataFrame, deps: DataFrame, rules: Sequence[tuple] = fv.FRAMEWORK_QUESTIONS
) -> DataFrame:
    """Questions for detected frameworks and ORMs, unless a blocking dependency is present (JOIN-15)."""
    rows = [(i, *r) for i, r in enumerate(rules)]
    table = rule_frame(
        detected.sparkSession, rows, "pos BIGINT, name STRING, question STRING, context STRING, blocked_by STRING"
    )
    asked = detected.filter(F.col("kind").isin("framework", "orm")).join(table, "name")
    blockers = sorted({r[3] for r in rules if r[3]})
    present = deps.filter(F.col("dep").isin(*blockers)).select("repo_id", F.col("dep").alias("blocked_by")).distinct()
    return asked.join(present, ["repo_id", "blocked_by"], "left_anti").select(
        "repo_id", F.col("name").alias("framework"), "question", "context", "pos"
    )
