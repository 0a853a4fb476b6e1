"""Import statements, their targets, fan-in and blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv
from repolith.functions.ranking import top_k
from repolith.operators.reach import reachable

_SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mjs")


def _extract(text: Column, *patterns: str) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])


def import_specs(text: Column, ext: Column) -> Column:
    """Imported names of one file, in order of the rules, with repeats (PRJ-22)."""
    script = _extract(
        text,
        r"""(?m)^import\s+(?:type\s+)?(?:[^'"]*\s+from\s+)?['"]([^'"]+)['"]""",
        r"""\bimport\s*\(\s*['"]([^'"]+)['"]\s*\)""",
        r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    )
    java = _extract(text, r"(?m)^import\s+(?:static\s+)?([\w.]+)\s*;")
    python = _extract(text, r"(?m)^from\s+([\w.]+)\s+import", r"(?m)^import\s+([\w.]+)")
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)import\s*\((.*?)\)"), F.lit(1))
    block_lines = F.flatten(F.transform(blocks, lambda b: F.split(b, "\n")))
    packages = F.filter(
        F.transform(block_lines, lambda x: F.regexp_extract(x, r'"([^"]+)"', 1)), lambda x: x != ""
    )
    go = F.concat(packages, _extract(text, r'(?m)^import\s+"([^"]+)"'))
    rust = _extract(text, r"(?m)^use\s+([\w:]+)")
    return (
        F.when(ext.isin(*_SCRIPT), script)
        .when(ext == ".java", java)
        .when(ext == ".py", python)
        .when(ext == ".go", go)
        .when(ext == ".rs", rust)
    )


def head(text: Column, lines: int | None) -> Column:
    """First lines of a text, or the whole text."""
    if lines is None:
        return text
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")


def extract_imports(contents: DataFrame, head_lines: int | None = None) -> DataFrame:
    """One row per import statement: src, pos, spec (PRJ-22). Whole texts unless ``head_lines`` is given."""
    source = contents.filter(C.is_source_file("path"))
    ext = F.lower(C.extension("path"))
    return spec_rows(source.withColumn("specs", import_specs(head(F.col("text"), head_lines), ext)))


def spec_rows(files: DataFrame) -> DataFrame:
    """One row per import statement of files with their ``specs``."""
    rows = files.select("repo_id", F.col("path").alias("src"), F.posexplode("specs").alias("pos", "spec"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def _candidates(kind: Column, base: Column) -> Column:
    """Paths to try, best first."""
    relative = []
    for ext in fv.RESOLVE_EXTENSIONS:
        candidate = F.concat(base, F.lit(ext))
        index = F.lit(f"index{ext or '.ts'}")
        relative += [
            candidate,
            F.regexp_replace(candidate, r"\.js$", ".ts"),
            F.when(base == "", index).otherwise(F.concat(base, F.lit("/"), index)),
        ]
    java = [F.concat(F.lit(prefix), base, F.lit(".java")) for prefix in fv.JAVA_SOURCE_PREFIXES]
    python = [F.concat(base, F.lit(suffix)) for suffix in fv.PYTHON_SUFFIXES]
    return (
        F.when(kind == "relative", F.array(*relative))
        .when(kind == "java", F.array(*java))
        .when(kind == "python", F.array(*python))
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Target file of every import; null for an external one (JOIN-03).

    Imports are first reduced to distinct (repo, kind, base) keys, so a package that every file
    imports is looked up once; the lookup is an equi-join of its ordered candidates with the file
    list, best candidate by position; the answers then go back to the statements.
    """
    relative = F.col("spec").startswith(".")
    dotted = F.replace("spec", F.lit("."), F.lit("/"))
    # a relative import that climbs above the root keeps its '..' and so finds no file
    joined = C.normalise_path(F.concat_ws("/", C.directory("src"), F.col("spec")))
    keyed = imports.withColumns(
        {
            "kind": F.when(relative, "relative")
            .when(F.col("src").endswith(".java"), "java")
            .when(F.col("src").endswith(".py"), "python"),
            "base": F.when(relative, joined).otherwise(dotted),
        }
    )
    lookups = keyed.filter("kind IS NOT NULL").groupBy("repo_id", "kind", "base").agg(F.lit(1).alias("_one"))
    tried = lookups.select(
        "repo_id", "kind", "base", F.posexplode(_candidates(F.col("kind"), F.col("base"))).alias("rule_pos", "path")
    )
    found = (
        tried.join(files.select("repo_id", "path"), ["repo_id", "path"])
        .groupBy("repo_id", "kind", "base")
        .agg(F.min_by("path", "rule_pos").alias("dst"), F.min("rule_pos").cast("bigint").alias("rule_pos"))
    )
    return keyed.join(found, ["repo_id", "kind", "base"], "left").select(
        "repo_id", "src", "pos", "spec", "dst", "rule_pos"
    )


def import_edges(resolved: DataFrame) -> DataFrame:
    """Distinct importer → target edges with the number of statements."""
    return (
        resolved.filter("dst IS NOT NULL").groupBy("repo_id", "src", "dst").agg(F.count(F.lit(1)).alias("mult"))
    )


def fan_in(edges: DataFrame, k: int | None = 30) -> DataFrame:
    """Import statements and distinct importers per file (AGG-10, TOP-03)."""
    counts = edges.groupBy("repo_id", F.col("dst").alias("file")).agg(
        F.sum("mult").alias("n_imports"), F.count(F.lit(1)).alias("fan_in")
    )
    if k is None:
        return counts
    return top_k(counts, k, ["repo_id"], [F.desc("n_imports"), F.asc("file")])


def blast_radius(changeset: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """Importers of changed files at their smallest distance, to the end or up to ``hops`` steps away (JOIN-10)."""
    start = changeset.select("repo_id", F.col("path").alias("origin"))
    steps = edges.select("repo_id", F.col("dst").alias("a"), F.col("src").alias("b"))
    found = reachable(start, steps, hops)
    return found.select("repo_id", F.col("origin").alias("changed"), F.col("node").alias("importer"), "hop")
