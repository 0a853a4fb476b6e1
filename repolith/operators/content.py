"""Line and text scans: markers, risky calls, descriptions, team rules, services, commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv
from repolith.functions.ranking import collect_ranked, top_k
from repolith.operators.imports import import_specs
from repolith.operators.types import hottest, lines_of, numbered_lines


def _todo_hits(pattern: str) -> Column:
    """Lines of ``text`` with a marker, numbered."""
    lines = F.transform(lines_of("text"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    return F.filter(lines, lambda x: x["line"].rlike(pattern))


def _searched_for_todos() -> Column:
    return ~F.contains("path", F.lit("node_modules")) & ~F.contains("path", F.lit(".min."))


#: Base names of files that are read for what they say about the whole repository.
MANIFEST_NAMES = (
    "README.md", "readme.md", "README.rst", "pom.xml", "package.json", "go.mod", "Cargo.toml", "requirements.txt",
    "requirements-dev.txt", "Pipfile", "Gemfile", "Makefile",
)


def digest(contents: DataFrame) -> DataFrame:
    """One narrow row per file with all that the score family asks of its text, by one reading of it.

    n_todos; ``patterns`` and ``libraries``, flags in the order of the fixed tables, libraries for test files only; ``specs``, the
    imports of a source file; and the whole text of manifests, compose files and leading documents, null for all others.
    """
    text, path = F.col("text"), F.col("path")
    flags = lambda table: F.array(*[C.any_of([F.contains(text, F.lit(x)) for x in literals]) for _, literals, _ in table])
    whole = C.base_name("path").isin(*MANIFEST_NAMES) | F.contains(path, F.lit("docker-compose"))
    todos = F.when(_searched_for_todos(), F.size(_todo_hits(fv.TODO_PATTERN))).otherwise(0)
    return contents.select(
        "repo_id",
        "path",
        todos.cast("bigint").alias("n_todos"),
        flags(fv.CODE_PATTERNS).alias("patterns"),
        F.when(C.is_test_file("path", "library"), flags(fv.TEST_LIBRARY_PATTERNS)).alias("libraries"),
        F.when(C.is_source_file("path"), import_specs(text, F.lower(C.extension("path")))).alias("specs"),
        F.when(whole, text).alias("text"),
    )


def scan_todos(
    contents: DataFrame,
    freq: DataFrame | None = None,
    top_files: int | None = None,
    pattern: str = fv.TODO_PATTERN,
    chars: int | None = None,
) -> DataFrame:
    """Marker comments with kind, trimmed text and line number (PRJ-19).

    Of all files, or of the ``top_files`` hottest by ``freq``; ``chars`` cuts the text.
    """
    read = contents.filter(_searched_for_todos())
    if freq is not None and top_files is not None:
        top = hottest(freq, top_files).select("repo_id", "path")
        read = read.join(top, ["repo_id", "path"], "left_semi")
    rows = read.select("repo_id", "path", F.explode_outer(_todo_hits(pattern)).alias("h")).filter("h IS NOT NULL")
    text = C.strip(F.regexp_extract(F.col("h.line"), pattern, 2))
    return rows.select(
        "repo_id",
        "path",
        F.col("h.line_no").cast("bigint").alias("line_no"),
        F.regexp_extract(F.col("h.line"), pattern, 1).alias("kind"),
        (text if chars is None else F.left(text, F.lit(chars))).alias("text"),
    )


def top_todos(todos: DataFrame, freq: DataFrame, k: int = 30) -> DataFrame:
    """Markers of the hottest files first (TOP-06)."""
    ranked = todos.join(freq.select("repo_id", "path", "change_count"), ["repo_id", "path"], "left")
    order = [F.desc_nulls_last("change_count"), F.asc("path"), F.asc("line_no")]
    return top_k(ranked, k, ["repo_id"], order)


def scan_rules(contents: DataFrame, rules: Sequence[tuple] = fv.RISK_RULES) -> DataFrame:
    """Lines that match a rule of the file's language or a general rule (PRJ-28).

    ``contents`` may carry a ``language`` column; otherwise it follows from the path. The rules
    become one expression over each line, so there is no join of lines with rules.
    """
    if "language" not in contents.columns:
        contents = contents.withColumn("language", C.language("path"))
    # one cheap pattern of all rules first: most lines match none of them
    any_rule = "|".join(f"(?:{pattern})" for _, _, pattern in rules)
    lines = numbered_lines(contents).filter(F.col("line").rlike(any_rule))
    language = F.col("language")
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.lit(True) if lang == "*" else F.coalesce(language == lang, F.lit(False)))
                    & F.col("line").rlike(pattern),
                    F.struct(F.lit(category).alias("category"), F.lit(i).cast("bigint").alias("rule")),
                )
                for i, (lang, category, pattern) in enumerate(rules)
            ]
        )
    )
    return (
        lines.withColumn("h", F.explode_outer(hits))
        .filter("h IS NOT NULL")
        .select("repo_id", "path", "line_no", F.col("h.category").alias("category"), F.col("h.rule").alias("rule"))
    )


def rule_counts(hits: DataFrame) -> DataFrame:
    """Matched rules, distinct lines' files and hits per category (PRJ-28)."""
    per_file = hits.groupBy("repo_id", "category", "path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("repo_id", "category").agg(
        F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_files")
    )


def _first(lines: Column, test) -> Column:
    """1-based position of the first line that passes, 0 when none does."""
    return F.coalesce(F.array_position(F.transform(lines, test), F.lit(True)), F.lit(0))


def _with_paragraph(df: DataFrame, chars: int | None = None) -> DataFrame:
    """Adds ``lead``: the first paragraph after a title line, joined to one line, cut to ``chars`` where given."""
    rest = lambda lines, at: F.slice(lines, at, F.greatest(F.size(lines), F.lit(1)))
    blank = lambda x: C.strip(x) == ""
    df = df.withColumn("_lines", lines_of("text"))
    df = df.withColumn("_at", _first(F.col("_lines"), lambda x: x.startswith("# ") | x.startswith("===")))
    df = df.withColumn("_rest", F.when(F.col("_at") > 0, rest(F.col("_lines"), F.col("_at") + 1)))
    df = df.withColumn("_from", _first(F.col("_rest"), lambda x: ~blank(x)))
    df = df.withColumn("_body", F.when(F.col("_from") > 0, rest(F.col("_rest"), F.col("_from"))))
    df = df.withColumn(
        "_stop", _first(F.col("_body"), lambda x: blank(x) | x.startswith("#") | x.startswith("---"))
    )
    kept = F.when(F.col("_stop") > 0, F.slice("_body", F.lit(1), F.col("_stop") - 1)).otherwise(F.col("_body"))
    joined = F.array_join(F.transform(kept, lambda x: C.strip(x)), " ")
    lead = F.nullif(joined if chars is None else F.left(joined, F.lit(chars)), F.lit(""))
    # the generator keeps later filters from being pushed into, and so repeating, the steps above
    kept_columns = [c for c in df.columns if not c.startswith("_")]
    return df.select(*kept_columns, F.explode_outer(F.array(lead)).alias("lead"))


def lead_paragraph(contents: DataFrame, chars: int | None = None) -> DataFrame:
    """First paragraph after the title, per file; files without one are dropped (PRJ-23)."""
    return _with_paragraph(contents, chars).filter("lead IS NOT NULL").select("repo_id", "path", "lead")


def project_description(contents: DataFrame) -> DataFrame:
    """Best description per repository: README, then pom description or name, then package description (PRJ-23)."""
    path, text, lead = F.col("path"), F.col("text"), F.col("lead")
    pom_text = C.strip(F.regexp_extract(text, r"(?s)<description>(.*?)</description>", 1))
    pom_name = C.strip(F.regexp_extract(text, r"<name>(.*?)</name>", 1))
    package = F.nullif(F.get_json_object(text, "$.description"), F.lit(""))
    sources = [
        ("README.md", lead),
        ("readme.md", lead),
        ("README.rst", lead),
        ("pom.xml", F.when(F.length(pom_text) > 5, pom_text).when(F.length(pom_name) > 3, pom_name)),
        ("package.json", package),
    ]
    found, order = None, None
    for i, (name, value) in enumerate(sources):
        found = F.when(path == name, value) if found is None else found.when(path == name, value)
        order = F.when(path == name, i) if order is None else order.when(path == name, i)
    return (
        _with_paragraph(contents.filter(path.isin(*[n for n, _ in sources])))
        .select("repo_id", found.alias("description"), order.alias("pos"))
        .filter("description IS NOT NULL")
        .groupBy("repo_id")
        .agg(F.min_by("description", "pos").alias("description"))
    )


def extract_rules(
    contents: DataFrame,
    rules_file: str = "code-review.rules",
    rules_dir: str = ".cursor/rules/",
    max_rules: int | None = None,
    max_files: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Team rules: quoted descriptions of the rules file, and rule documents without front matter (PRJ-26).

    All of them, whole, unless limits are given.
    """
    path, text = F.col("path"), F.col("text")
    quoted = F.regexp_extract_all("text", F.lit(r'Description:\s*"(.+?)"'), F.lit(1))
    described = (
        contents.filter(path == rules_file)
        .select(
            "repo_id",
            "path",
            (quoted if max_rules is None else F.slice(quoted, 1, max_rules)).alias("d"),
        )
        .filter(F.size("d") > 0)
        .select("repo_id", "path", F.array_join(F.transform("d", lambda x: F.concat(F.lit("- "), x)), "\n").alias("rule"))
    )
    documents = contents.filter(path.startswith(rules_dir))
    if max_files is not None:
        keep = top_k(documents.select("repo_id", "path"), max_files, ["repo_id"], [F.asc("path")])
        documents = documents.join(keep.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    stripped = C.strip(F.regexp_replace(C.strip(text), r"(?s)^---.*?---\s*", ""))
    rule = stripped if max_chars is None else F.left(stripped, F.lit(max_chars))
    bodies = documents.filter(C.strip(text) != "").select("repo_id", "path", rule.alias("rule"))
    return described.unionByName(bodies)


# --- services -------------------------------------------------------------------------------


def compose_files(files: DataFrame, k: int | None = None) -> DataFrame:
    """Compose files (repo_id, path, staging): all, or the first ``k``, those that are not for staging first (TOP-08)."""
    path = F.col("path")
    found = files.filter(
        F.contains(path, F.lit("docker-compose")) & (path.endswith(".yml") | path.endswith(".yaml"))
    )
    found = found.select("repo_id", "path", F.contains(path, F.lit("staging")).cast("int").alias("staging"))
    return found if k is None else top_k(found, k, ["repo_id"], [F.asc("staging"), F.asc("path")]).drop("rank")


def _service_lines(text: Column) -> Column:
    """Lines that say something, taken apart: number, start of the services, end of them, key with its indent, list item."""
    def part(line: Column, i: Column) -> Column:
        starts = line.rlike(r"^services:\s*$")
        key = F.nullif(F.regexp_extract(line, r"^(\s+)(\w[\w-]*):", 2), F.lit(""))
        item = F.nullif(F.regexp_extract(line, r"^\s+-\s+(.+)", 1), F.lit(""))
        return F.struct(
            (i + 1).cast("bigint").alias("no"),
            starts.alias("starts"),
            (~starts & line.rlike(r"^\S") & ~line.startswith("#")).alias("leaves"),
            key.alias("key"),
            F.when(key.isNotNull(), F.length(F.regexp_extract(line, r"^(\s+)", 1))).alias("indent"),
            F.when(key.isNull(), item).alias("item"),
        )

    return F.filter(F.transform(lines_of(text), part), lambda x: x["starts"] | x["leaves"] | x["key"].isNotNull() | x["item"].isNotNull())


def _service_step(state: Column, x: Column) -> Column:
    """State after a line: whether services are listed, at which indent, the service and property at work, and what was found."""
    within = state["open"] & ~x["starts"] & ~x["leaves"]
    has_key = within & x["key"].isNotNull()
    indent = F.coalesce(state["indent"], F.when(has_key, x["indent"]))
    named = has_key & (x["indent"] == indent)
    service = F.when(named, x["key"]).otherwise(state["service"])
    # a service line ends the property of the service above it; shallower keys change nothing
    inner = F.when(has_key & (x["indent"] > indent), x["key"]).otherwise(state["property"])
    prop = F.when(named, F.lit("")).otherwise(inner)
    item = F.when(within & service.isNotNull(), x["item"])
    port = F.when(prop == "ports", F.nullif(F.regexp_extract(item, r"""["']?(\d{4,5}):\d{4,5}["']?""", 1), F.lit("")))
    plain = C.strip(F.regexp_replace(item, r"""["']""", ""))
    dependency = F.when((prop == "depends_on") & plain.rlike(r"^[\w-]+$"), plain)
    row = F.struct(service.alias("service"), x["no"].alias("line_no"), port.alias("port"), dependency.alias("dependency"))
    tells = named | port.isNotNull() | dependency.isNotNull()
    left = state["left"] | (state["open"] & x["leaves"])
    return F.struct(
        ((state["open"] | x["starts"]) & ~left).alias("open"),
        left.alias("left"),
        indent.alias("indent"),
        service.alias("service"),
        prop.alias("property"),
        F.when(F.coalesce(tells, F.lit(False)), F.concat(state["found"], F.array(row))).otherwise(state["found"]).alias("found"),
    )


def service_map(contents: DataFrame) -> DataFrame:
    """Services of a compose file with first port and dependencies (AGG-34, WIN-04).

    The lines of a text are folded in its own row, carrying the enclosing service and property along; only
    what was found leaves the row.
    """
    none = F.lit(None).cast("string")
    found_type = "array<struct<service:string,line_no:bigint,port:string,dependency:string>>"
    start = F.struct(
        F.lit(False).alias("open"), F.lit(False).alias("left"), F.lit(None).cast("int").alias("indent"),
        none.alias("service"), none.alias("property"), F.array().cast(found_type).alias("found"),
    )
    parsed = contents.select("repo_id", "path", _service_lines(F.col("text")).alias("lines"))
    rows = parsed.select("repo_id", "path", F.inline(F.aggregate("lines", start, _service_step, lambda s: s["found"])))
    return rows.groupBy("repo_id", "path", "service").agg(
        F.min("line_no").alias("line_no"),
        F.min_by("port", F.when(F.col("port").isNotNull(), F.col("line_no"))).alias("port"),
        F.transform(
            F.array_sort(
                F.collect_list(F.when(F.col("dependency").isNotNull(), F.struct("line_no", "dependency")))
            ),
            lambda x: x["dependency"],
        ).alias("depends_on"),
    )


def first_services(services: DataFrame, chosen: DataFrame) -> DataFrame:
    """Services of the first chosen compose file that has any, and their count and names per repository."""
    ranked = services.join(chosen.select("repo_id", "path", "staging"), ["repo_id", "path"])
    best = ranked.groupBy("repo_id").agg(F.min(F.struct("staging", "path")).alias("b")).select("repo_id", "b.path")
    kept = ranked.join(best, ["repo_id", "path"])
    counts = kept.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_services"))
    named = (
        top_k(kept, 5, ["repo_id"], [F.asc("line_no"), F.asc("service")])
        .groupBy("repo_id")
        .agg(F.array_join(collect_ranked("rank", "service"), ", ").alias("names"))
    )
    return counts.join(named, "repo_id")


# --- build commands -------------------------------------------------------------------------


def parent_manifest(contents: DataFrame, name: str = "pom.xml") -> DataFrame:
    """Root manifest, else the shallowest with ``<modules>``, else the shallowest (TOP-09)."""
    path = F.col("path")
    poms = contents.filter((path == name) | path.endswith(f"/{name}"))
    depth = F.size(F.split("path", "/"))
    rank = F.struct((path != name).alias("a"), (~F.contains("text", F.lit("<modules>"))).alias("b"), depth.alias("c"), path)
    return poms.groupBy("repo_id").agg(
        F.min_by("path", rank).alias("parent"),
        F.count(F.lit(1)).alias("n_poms"),
        F.bool_or(F.contains("text", F.lit("spring-boot-maven-plugin"))).alias("spring_boot"),
        F.bool_or(F.contains("text", F.lit("antlr4-maven-plugin"))).alias("antlr"),
        F.min_by("text", rank).alias("parent_text"),
    )


def _command(pos: int, name: Column | str, command: Column, source: Column) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        F.lit(pos).cast("bigint").alias("pos"), as_col(name).alias("name"), as_col(command).alias("command"),
        as_col(source).alias("source"),
    )


def build_commands(contents: DataFrame, files: DataFrame, distinct_names: bool = True) -> DataFrame:
    """Build, test and run commands from manifests and presence rules (AGG-33).

    ``pos`` keeps the order of the sources; with ``distinct_names`` the first command of a name wins.
    """
    path = F.col("path")
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    profile = F.when(
        path.rlike(r"application-(\w+)\.ya?ml$") & F.contains(path, F.lit("resources/")),
        F.regexp_extract(path, r"application-(\w+)", 1),
    )
    poms = parent_manifest(contents)
    presence = files.groupBy("repo_id").agg(
        has(path == "mvnw").alias("mvnw"),
        has(path == "gradlew").alias("gradlew"),
        has(path.isin("build.gradle", "build.gradle.kts")).alias("gradle"),
        has(path == "bun.lockb").alias("bun"),
        has(path == "pnpm-lock.yaml").alias("pnpm"),
        has(path == "yarn.lock").alias("yarn"),
        F.min(profile).alias("first_profile"),
        has(profile == "local").alias("local_profile"),
    )
    wrapped = files.select("repo_id", C.directory("path").alias("dir"), C.base_name("path").alias("n")).filter("n = 'mvnw'")
    nested = (
        poms.select("repo_id", C.directory("parent").alias("dir"))
        .join(wrapped, ["repo_id", "dir"], "left_semi")
        .select("repo_id", F.lit(True).alias("nested_mvnw"))
        .distinct()
    )
    facts = poms.join(presence, "repo_id").join(nested, "repo_id", "left")
    folder = C.directory("parent")
    prefix = F.when(folder != "", F.concat(F.lit("cd "), folder, F.lit(" && "))).otherwise("")
    mvn = F.concat(prefix, F.when(F.col("mvnw") | F.col("nested_mvnw").isNotNull(), "./mvnw").otherwise("mvn"))
    modules = F.regexp_extract_all("parent_text", F.lit(r"<module>(.+?)</module>"), F.lit(1))
    profile_name = F.when(F.col("local_profile"), "local").otherwise(F.col("first_profile"))
    maven = facts.select(
        "repo_id",
        F.explode(
            F.array_compact(
                F.array(
                    _command(1, "build", F.concat(mvn, F.lit(" clean package -DskipTests")), F.col("parent")),
                    _command(2, "test", F.concat(mvn, F.lit(" test")), F.col("parent")),
                    F.when(
                        F.col("spring_boot"),
                        _command(3, "run", F.concat(mvn, F.lit(" spring-boot:run")), F.col("parent")),
                    ),
                    F.when(
                        F.col("antlr"),
                        _command(
                            4, "generate-sources", F.concat(mvn, F.lit(" generate-sources")), F.lit("pom.xml (ANTLR4)")
                        ),
                    ),
                    F.when(
                        (F.col("n_poms") >= 3) & (F.size(modules) > 0),
                        _command(
                            5,
                            "build-module",
                            F.concat(mvn, F.lit(" clean package -pl <module-name> -am")),
                            F.concat(F.lit("Modules: "), F.array_join(modules, ", ")),
                        ),
                    ),
                    F.when(
                        F.col("spring_boot") & F.col("first_profile").isNotNull(),
                        _command(
                            60,
                            "run-local",
                            F.concat(mvn, F.lit(" spring-boot:run -Dspring-boot.run.profiles="), profile_name),
                            F.lit("Spring profiles"),
                        ),
                    ),
                )
            )
        ).alias("c"),
    )
    gradle_cmd = F.when(F.col("gradlew"), "./gradlew").otherwise("gradle")
    gradle = presence.filter("gradle").select(
        "repo_id",
        F.explode(
            F.array(
                _command(10, "build", F.concat(gradle_cmd, F.lit(" build")), F.lit("build.gradle")),
                _command(11, "test", F.concat(gradle_cmd, F.lit(" test")), F.lit("build.gradle")),
            )
        ).alias("c"),
    )
    scripts = contents.filter(path == "package.json").select(
        "repo_id",
        F.explode(
            F.map_entries(F.from_json("text", "scripts MAP<STRING, STRING>")["scripts"])
        ).alias("s"),
    )
    runner = (
        F.when(F.col("bun"), "bun").when(F.col("pnpm"), "pnpm").when(F.col("yarn"), "yarn").otherwise("npm run")
    )
    npm = (
        scripts.filter(F.col("s.key").isin(*fv.SCRIPT_NAMES))
        .join(presence, "repo_id")
        .select(
            "repo_id",
            _command(
                20,
                F.col("s.key"),
                F.concat(runner, F.lit(" "), F.col("s.key")),
                F.concat(F.lit("package.json ("), F.col("s.value"), F.lit(")")),
            ).alias("c"),
        )
    )
    targets = F.regexp_extract_all("text", F.lit(r"(?m)^([a-zA-Z_-]+):"), F.lit(1))
    make = contents.filter(path == "Makefile").select(
        "repo_id",
        F.explode(
            F.transform(targets, lambda t: _command(30, t, F.concat(F.lit("make "), t), F.lit("Makefile")))
        ).alias("c"),
    )
    dockerfiles = files.filter(F.contains(path, F.lit("Dockerfile"))).select("repo_id", "path")
    docker = dockerfiles.select(
        "repo_id",
        _command(
            40, "docker-build", F.concat(F.lit("docker build -f "), path, F.lit(" -t app .")), path
        ).alias("c"),
    )
    parts = maven
    for part in (gradle, npm, make, docker):
        parts = parts.unionByName(part)
    rows = parts.select("repo_id", "c.*")
    if not distinct_names:
        return rows
    return top_k(rows, 1, ["repo_id", "name"], [F.asc("pos"), F.asc("command"), F.asc("source")]).drop("rank")
