"""File-list analytics: languages, path facts, layout, directories and modules, architecture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv
from repolith.functions.ranking import collect_ranked, top_k
from repolith.session import rule_frame


def path_columns(files: DataFrame) -> DataFrame:
    """Path parts beside the path (PRJ-04)."""
    return files.withColumns(C.path_parts("path"))


def drop_ignored(files: DataFrame, ignored: Sequence[str] = fv.IGNORED_DIRS) -> DataFrame:
    """Files outside ignored directories (PRJ-05)."""
    return files.filter(~C.in_ignored_dir("path", ignored))


def with_language(files: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Language per file, null when the extension is unknown (PRJ-06)."""
    return files.withColumn("language", C.language("path", table))


def language_share(files: DataFrame) -> DataFrame:
    """Files and rounded percent per language; the largest is primary (AGG-06, WIN-06)."""
    counts = (
        with_language(drop_ignored(files))
        .filter("language IS NOT NULL")
        .groupBy("repo_id", "language")
        .agg(F.count(F.lit(1)).alias("files"))
    )
    totals = counts.groupBy("repo_id").agg(
        F.sum("files").alias("total"), F.min_by("language", F.struct(-F.col("files"), "language")).alias("primary")
    )
    return counts.join(totals, "repo_id").select(
        "repo_id",
        "language",
        "files",
        C.js_round(F.col("files") / F.col("total") * 100).alias("percentage"),
        (F.col("language") == F.col("primary")).alias("is_primary"),
    )


def test_layout(files: DataFrame, variant: str = "architecture") -> DataFrame:
    """Where test files live: none, mixed, colocated or separate-dir (AGG-09). Paths must be distinct."""
    where = files.select("repo_id", C.test_location("path", variant).alias("loc"))
    counts = where.groupBy("repo_id").agg(
        F.count_if(F.col("loc") == "colocated").alias("colocated"),
        F.count_if(F.col("loc") == "separate").alias("separate"),
    )
    layout = (
        F.when((F.col("colocated") == 0) & (F.col("separate") == 0), "none")
        .when((F.col("colocated") > 0) & (F.col("separate") > 0), "mixed")
        .when(F.col("colocated") > F.col("separate"), "colocated")
        .otherwise("separate-dir")
    )
    return counts.withColumn("layout", layout)


def changed_paths(changes: DataFrame) -> DataFrame:
    """Distinct paths seen in the log."""
    return changes.select("repo_id", "path").distinct()


def explode_ancestors(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every directory above a file, one row each (JOIN-07)."""
    segments = F.split("path", "/")
    n = F.size(segments) - 1
    depth = n if max_depth is None else F.least(n, F.lit(max_depth))
    dirs = F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/")),
    )
    return files.select("*", F.posexplode(dirs).alias("_pos", "dir")).select(
        *files.columns, "dir", (F.col("_pos") + 1).cast("bigint").alias("depth")
    )


def path_facts(files: DataFrame, rules: Sequence[tuple] = fv.PATH_FACTS) -> DataFrame:
    """Rule hits by exact path, or by a directory with that path (JOIN-05)."""
    spark = files.sparkSession
    rows = [(i, *r) for i, r in enumerate(rules)]
    table = rule_frame(spark, rows, "pos BIGINT, kind STRING, rule_path STRING, is_dir BOOLEAN, label STRING")
    depth = max((p.count("/") + 1 for _, p, is_dir, _ in rules if is_dir), default=0)
    keys = files.select("repo_id", F.col("path").alias("rule_path"), F.lit(False).alias("is_dir"))
    if depth:
        dirs = explode_ancestors(files.select("repo_id", "path"), depth).select(
            "repo_id", F.col("dir").alias("rule_path"), F.lit(True).alias("is_dir")
        )
        keys = keys.unionByName(dirs)
    return (
        keys.join(table, ["rule_path", "is_dir"])
        .select("repo_id", "kind", "label", F.col("rule_path").alias("path"), "pos")
        .distinct()
    )


def files_with_frequency(files: DataFrame, freq: DataFrame) -> DataFrame:
    """Change count per tracked file, 0 when never changed (JOIN-06)."""
    counts = freq.select("repo_id", "path", "change_count")
    return (
        files.select("repo_id", "path")
        .join(counts, ["repo_id", "path"], "left")
        .select("repo_id", "path", F.coalesce("change_count", F.lit(0).cast("bigint")).alias("n"))
    )


# --- modules --------------------------------------------------------------------------------


def _prefix_depths(dir_col: Column, prefixes: Sequence[str]) -> Column:
    """Depth of the first occurrence of each source prefix that has something below it."""
    found = []
    for prefix in prefixes:
        head = F.regexp_extract(dir_col, rf"^((?:[^/]+/)*?{prefix})/", 1)
        found.append(F.when(head != "", F.size(F.split(head, "/"))))
    return F.array_compact(F.array(*found))


def module_directories(
    files: DataFrame, prefixes: Sequence[str] = fv.SOURCE_PREFIXES, depth: int = fv.MODULE_DEPTH
) -> DataFrame:
    """File by ancestor directory, marked where the directory lies 1..depth levels below a source prefix.

    Whole path segments are matched. Every file below a candidate finds that candidate in its own
    path, so the module totals are one grouping, without comparing directories to each other.
    """
    dirs = explode_ancestors(files.withColumn("_depths", _prefix_depths(C.directory("path"), prefixes)))
    candidate = F.exists("_depths", lambda p: (F.col("depth") > p) & (F.col("depth") <= p + depth))
    nested = F.contains(C.directory("path"), F.lit("/src/")) & (C.directory("path") != F.col("dir"))
    return dirs.select(*[c for c in files.columns], "dir", candidate.alias("candidate"), nested.alias("nested_src"))


def module_rollup(
    files: DataFrame,
    freq: DataFrame,
    min_files: int = fv.MODULE_MIN_FILES,
    depth: int = fv.MODULE_DEPTH,
    key_files: int = 5,
) -> DataFrame:
    """Module directories with file and change totals, parent and most-changed files (AGG-11, TOP-04, SET-02).

    Modules are directories below a source prefix with enough files, plus directories that hold
    a ``pom.xml`` and have sources below. The tree stays flat: ``parent_dir`` names the parent.
    """
    counted = files_with_frequency(files, freq)
    exploded = module_directories(counted, depth=depth)
    totals = exploded.groupBy("repo_id", "dir").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("n").alias("change_count"),
        F.bool_or("candidate").alias("candidate"),
        F.bool_or("nested_src").alias("has_src"),
        F.bool_or(F.col("path") == F.concat("dir", F.lit("/pom.xml"))).alias("has_pom"),
    )
    roots = totals.filter(
        (F.col("candidate") & (F.col("file_count") >= min_files)) | (F.col("has_pom") & F.col("has_src"))
    )
    parents = roots.select("repo_id", F.col("dir").alias("parent_dir"), F.lit(True).alias("_known"))
    top = (
        top_k(exploded, key_files, ["repo_id", "dir"], [F.desc("n"), F.asc("path")])
        .groupBy("repo_id", "dir")
        .agg(collect_ranked("rank", "path").alias("key_files"))
    )
    return (
        roots.withColumn("parent_dir", C.directory("dir"))
        .join(parents, ["repo_id", "parent_dir"], "left")
        .join(top, ["repo_id", "dir"])
        .select(
            "repo_id",
            "dir",
            F.when(F.col("_known"), F.col("parent_dir")).alias("parent_dir"),
            "file_count",
            "change_count",
            "key_files",
        )
    )


def module_roots(files: DataFrame, freq: DataFrame) -> DataFrame:
    """Modules that have no module above them (SET-02)."""
    modules = module_rollup(files, freq)
    above = explode_ancestors(modules.select("repo_id", F.col("dir").alias("path")))
    nested = above.join(
        modules.select("repo_id", "dir"), ["repo_id", "dir"], "left_semi"
    ).select("repo_id", F.col("path").alias("dir")).distinct()
    return modules.join(nested, ["repo_id", "dir"], "left_anti")


def flatten_modules(nested: DataFrame) -> DataFrame:
    """Nested ``children`` structs of any fixed depth to one row per directory (SET-04)."""
    out, level = None, nested
    while True:
        rows = level.select(*[c for c in level.columns if c != "children"])
        out = rows if out is None else out.unionByName(rows)
        if "children" not in level.columns:
            return out
        level = level.select("repo_id", F.explode("children").alias("c")).select("repo_id", "c.*")


def dir_class_flags(class_names: DataFrame) -> DataFrame:
    """Per directory: number of classes found below it and which class suffixes occur."""
    suffixes = [F.col("class_name").endswith(s) for s, _ in fv.CLASS_SUFFIX_PURPOSES]
    per_file = class_names.groupBy("repo_id", "path").agg(
        F.count(F.lit(1)).alias("n"), *[F.bool_or(c).alias(f"s{i}") for i, c in enumerate(suffixes)]
    )
    return (
        explode_ancestors(per_file)
        .groupBy("repo_id", "dir")
        .agg(F.sum("n").alias("n_classes"), *[F.bool_or(f"s{i}").alias(f"s{i}") for i in range(len(suffixes))])
    )


def module_purpose(modules: DataFrame, class_flags: DataFrame) -> DataFrame:
    """Purpose by directory name, else by a name contained in it, else by class names (PRJ-15)."""
    name = F.lower(C.base_name("dir"))
    purposes = F.create_map(*[F.lit(x) for pair in fv.DIRECTORY_PURPOSES.items() for x in pair])
    partial = C.first_match([(F.contains(name, F.lit(k)), v) for k, v in fv.DIRECTORY_PURPOSES.items()], None)
    by_class = C.first_match(
        [(F.col(f"s{i}"), purpose) for i, (_, purpose) in enumerate(fv.CLASS_SUFFIX_PURPOSES)], None
    )
    count = F.concat(F.col("file_count").cast("string"), F.lit(" files"))
    return modules.join(class_flags, ["repo_id", "dir"], "left").select(
        *modules.columns,
        F.coalesce(F.try_element_at(purposes, name), partial, by_class, count).alias("description"),
        F.coalesce("n_classes", F.lit(0).cast("bigint")).alias("n_classes"),
    )


def meaningful_modules(described: DataFrame, k: int = 12) -> DataFrame:
    """Most changed modules that have a described purpose (TOP-05)."""
    kept = described.filter((F.col("description") != "") & ~F.col("description").endswith("files"))
    return top_k(kept, k, ["repo_id"], [F.desc("change_count"), F.asc("dir")])


def hot_dirs(modules: DataFrame, class_flags: DataFrame, k: int = 10) -> DataFrame:
    """Most changed directories that carry code of their own (AGG-12)."""
    children = (
        modules.filter("parent_dir IS NOT NULL")
        .select("repo_id", F.col("parent_dir").alias("dir"), F.lit(True).alias("has_children"))
        .distinct()
    )
    classes = class_flags.select("repo_id", "dir", "n_classes")
    parts = F.split("dir", "/")
    java = F.array_position(parts, "java")
    shallow_java = (java > 0) & (F.size(parts) - java + 1 <= 3)
    kept = (
        modules.filter((F.col("file_count") >= 3) & (F.col("change_count") >= 5))
        .filter(~shallow_java & ~F.col("dir").rlike(r"^src/(main|test)(/resources)?$"))
        .join(children, ["repo_id", "dir"], "left")
        .join(classes, ["repo_id", "dir"], "left")
        .filter((F.coalesce("n_classes", F.lit(0)) > 0) | F.col("has_children").isNull())
    )
    return top_k(
        kept.select("repo_id", "dir", "change_count"), k, ["repo_id"], [F.desc("change_count"), F.asc("dir")]
    )


def hot_dir_modules(hot: DataFrame, modules: DataFrame) -> DataFrame:
    """Hot directories with their module columns (JOIN-13)."""
    return hot.select("repo_id", "dir", "rank").join(modules, ["repo_id", "dir"])


def types_in_dir(types: DataFrame, dirs: DataFrame, k: int = 10) -> DataFrame:
    """Largest types below each directory (JOIN-14)."""
    below = explode_ancestors(types.withColumnRenamed("file", "path")).drop("depth")
    hits = below.join(dirs.select("repo_id", "dir"), ["repo_id", "dir"], "left_semi")
    order = [F.desc("loc"), F.asc("file"), F.asc("name"), F.asc("line_no")]
    return top_k(hits.withColumnRenamed("path", "file"), k, ["repo_id", "dir"], order)


# --- architecture ---------------------------------------------------------------------------


def _seen(*conditions: Column) -> Column:
    return F.coalesce(F.bool_or(C.any_of(conditions)), F.lit(False))


def _under(path: Column, *dirs: str) -> list[Column]:
    return [path.startswith(f"{d}/") for d in dirs]


def _labelled(path: Column, rules: Sequence[tuple]) -> Column:
    tests = {
        "contains": lambda v: F.contains(path, F.lit(v)),
        "equals": lambda v: path == v,
        "endswith": lambda v: path.endswith(v),
    }
    return F.array_compact(
        F.array(*[F.when(_seen(*[tests[test](v) for v in values]), label) for label, test, values in rules])
    )


def architecture(files: DataFrame) -> DataFrame:
    """Style, entry points, layers, data and API patterns, Docker and IaC flags (AGG-29, AGG-30).

    One pass: every fact is a boolean aggregate, combined map-side, so a repository of any size
    crosses the exchange as one row per task.
    """
    p = F.col("path")
    entries = [path for kind, path, _, _ in fv.PATH_FACTS if kind == "entry_point"]
    contains = lambda *words: [F.contains(p, F.lit(w)) for w in words]
    layers = F.array_compact(
        F.array(
            *[F.when(_seen(*_under(p, *[f"{root}{d}" for root in fv.LAYER_PARENTS])), d) for d in fv.LAYER_DIRS]
        )
    )
    facts = files.groupBy("repo_id").agg(
        _seen(*_under(p, "packages")).alias("packages"),
        _seen(*_under(p, "apps")).alias("apps"),
        _seen(*_under(p, "services")).alias("services"),
        _seen(p.isin(*fv.WORKSPACE_FILES)).alias("workspaces"),
        F.count_if((p == "pom.xml") | p.endswith("/pom.xml")).alias("poms"),
        _seen(*contains("docker-compose", *fv.SERVICE_REGISTRY_WORDS)).alias("composed"),
        _seen(p.isin(*fv.LIBRARY_INDEX_FILES)).alias("lib_index"),
        _seen(*contains(*fv.SERVER_WORDS)).alias("server"),
        F.array_compact(F.array(*[F.when(_seen(p == e), e) for e in entries])).alias("entry_points"),
        layers.alias("layers"),
        _labelled(p, fv.DATABASE_PATTERNS).alias("db_patterns"),
        _labelled(p, fv.API_PATTERNS).alias("api_patterns"),
        _seen(p == "Dockerfile").alias("has_docker"),
        _seen(*_under(p, *fv.IAC_DIRS), p.isin(*fv.IAC_FILES)).alias("has_iac"),
    )
    style = C.first_match(
        [
            ((F.col("packages") | F.col("apps")) & F.col("workspaces"), "monorepo"),
            (F.col("packages") & F.col("apps"), "monorepo"),
            (F.col("services"), "microservices"),
            ((F.col("poms") >= 3) & F.col("composed"), "microservices"),
            (F.col("lib_index") & ~F.col("server"), "library"),
        ],
        "monolith",
    )
    return facts.select(
        "repo_id",
        style.alias("style"),
        "entry_points",
        "layers",
        "db_patterns",
        "api_patterns",
        "has_docker",
        "has_iac",
    )


def key_modules(files: DataFrame, ignored: Sequence[str] = fv.NON_MODULE_DIRS) -> DataFrame:
    """Distinct top directories that are no tooling or dot directories (AGG-31)."""
    return (
        files.filter(F.contains("path", F.lit("/")))
        .select("repo_id", F.element_at(F.split("path", "/"), 1).alias("module"))
        .filter(~F.col("module").isin(*ignored) & ~F.col("module").startswith(".") & (F.col("module") != ""))
        .distinct()
    )


def config_inventory(files: DataFrame) -> DataFrame:
    """Known configuration files with type and summary (PRJ-29)."""
    table = rule_frame(files.sparkSession, fv.CONFIG_FILES, "path STRING, type STRING, summary STRING")
    exact = files.select("repo_id", "path").join(table, "path").select("repo_id", "path", "type", "summary")
    pattern, kind, summary = fv.CONFIG_PATTERN
    by_pattern = files.filter(F.col("path").rlike(pattern)).select(
        "repo_id",
        "path",
        F.lit(kind).alias("type"),
        F.concat(F.lit(f"{summary} ("), C.base_name("path"), F.lit(")")).alias("summary"),
    )
    return exact.unionByName(by_pattern)


def root_package(files: DataFrame) -> DataFrame:
    """First four package directories of the first Java source, else 'src/', else '' (PRJ-30)."""
    marker = "src/main/java/"
    path = F.col("path")
    is_java = path.endswith(".java") & F.contains(path, F.lit(marker))
    facts = files.groupBy("repo_id").agg(
        F.min(F.when(is_java, path)).alias("first"), _seen(path.startswith("src/")).alias("src")
    )
    after = F.substring(F.col("first"), F.instr("first", marker) + len(marker), F.length("first"))
    parts = F.split(after, "/")
    package = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(4), F.size(parts) - 1)), ".")
    return facts.select(
        "repo_id",
        F.when(F.col("first").isNotNull(), package).when(F.col("src"), "src/").otherwise("").alias("root_package"),
    )
