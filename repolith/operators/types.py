"""Type declarations, annotations and code patterns read from file contents.

Each file is one row, so the scans are row-local expressions over its lines; only the results
are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv
from repolith.functions.ranking import collect_ranked, top_k

def _empty() -> Column:
    return F.array().cast("array<string>")


_JAVA_DECL = (
    r"(?:public\s+)?(?:abstract\s+)?(?:final\s+)?(class|interface|enum)\s+(\w+)"
    r"(?:\s+extends\s+(\w+))?(?:\s+implements\s+(.+?))?(?:\s*\{|$)"
)
_SCRIPT_DECL = r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface|type|enum)\s+(\w+)"
_PYTHON_DECL = r"^class\s+(\w+)(?:\s*\(([^)]*)\))?:"
_GO_DECL = r"^type\s+(\w+)\s+(struct|interface)\s*\{"
_RUST_DECL = r"^(?:pub\s+)?(struct|trait|enum)\s+(\w+)"
#: (extensions, pattern) of the class-name scan
CLASS_NAME_PATTERNS = (
    ((".java",), r"(?:public\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)"),
    ((".ts", ".tsx", ".js"), r"(?:export\s+)?(?:default\s+)?(?:class|interface|type|enum)\s+(\w+)"),
    ((".py",), r"^class\s+(\w+)"),
    ((".go",), r"^type\s+(\w+)\s+(?:struct|interface)"),
    ((".rs",), r"^(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)"),
)


def lines_of(text: Column | str, head_lines: int | None = None) -> Column:
    parts = F.split(text, "\n")
    return parts if head_lines is None else F.slice(parts, 1, head_lines)


def numbered_lines(contents: DataFrame, head_lines: int | None = None) -> DataFrame:
    """One row per line with its 1-based number."""
    return contents.select(
        *[c for c in contents.columns if c != "text"], F.posexplode(lines_of("text", head_lines)).alias("_p", "line")
    ).select(
        *[c for c in contents.columns if c != "text"], (F.col("_p") + 1).cast("bigint").alias("line_no"), "line"
    )


def class_names(contents: DataFrame, head_lines: int | None = None) -> DataFrame:
    """Class-like names per file, one per declaring line (PRJ-21)."""
    lines = numbered_lines(contents, head_lines)
    ext = C.extension("path")
    name = None
    for exts, pattern in CLASS_NAME_PATTERNS:
        hit = F.regexp_extract("line", pattern, 1)
        name = F.when(ext.isin(*exts), hit) if name is None else name.when(ext.isin(*exts), hit)
    return lines.withColumn("class_name", name).filter("class_name <> ''").select(
        "repo_id", "path", "line_no", "class_name"
    )


def _split_names(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda s: C.strip(s)), lambda s: s != "")


def _declares(line: Column) -> Column:
    """The line declares a type in the language of the column ``ext``."""
    ext, stripped = F.col("ext"), C.strip(line)
    return (
        F.when(ext == ".java", stripped.rlike(_JAVA_DECL))
        .when(ext == ".py", line.rlike(_PYTHON_DECL))
        .when(ext == ".go", line.rlike(_GO_DECL))
        .when(ext == ".rs", line.rlike(_RUST_DECL))
        .otherwise(stripped.rlike(_SCRIPT_DECL))
    )


def _java_context(df: DataFrame) -> DataFrame:
    """Annotations and doc comment above the first declaration of a Java file.

    Each step is a column of its own, so no step is worked out again inside another's loop.
    """
    first = F.try_element_at(F.col("hits"), F.lit(1))["no"]
    above = F.transform(F.slice("ls", F.lit(1), first), lambda x: C.strip(x))
    df = df.withColumn("above", F.when(F.col("ext") == ".java", above))
    opened = F.array_compact(F.transform("above", lambda x, i: F.when(x.startswith("/**"), i + 1)))
    df = df.withColumn("opened", F.try_element_at(opened, F.lit(-1)))
    df = df.withColumn("block", F.slice("above", F.col("opened"), F.size("above")))
    closed = F.array_position(F.transform("block", lambda x: F.contains(x, F.lit("*/"))), F.lit(True))
    df = df.withColumn("closed", closed)
    inside = F.when(F.col("closed") > 0, F.slice("block", F.lit(1), F.col("closed") - 1)).otherwise(F.col("block"))
    words = F.transform(inside, lambda x: C.strip(F.regexp_replace(x, r"^[\s/*]+", "")))
    marks = F.transform(F.filter("above", lambda x: x.startswith("@")), lambda x: F.regexp_extract(x, r"@\w+", 0))
    return df.withColumns(
        {
            "doc": F.array_join(F.filter(words, lambda w: (w != "") & ~w.startswith("@")), " "),
            "above_annotations": F.filter(marks, lambda m: m != ""),
        }
    )


def extract_types(contents: DataFrame, head_lines: int | None = None) -> DataFrame:
    """Type declarations: Java (first of a file), TypeScript, Python, Go, Rust (PRJ-20).

    ``loc`` is the number of lines for Java and TypeScript and 0 for the other languages. A file
    is searched in place; what leaves the row are its few declaring lines.
    """
    script = (".ts", ".tsx")
    ext = F.col("ext")
    known = (
        contents.withColumn("ext", C.extension("path"))
        .filter(ext.isin(".java", *script, ".py", ".go", ".rs"))
        .select("repo_id", "path", "ext", lines_of("text", head_lines).alias("ls"))
    )
    hits = F.array_compact(
        F.transform("ls", lambda x, i: F.when(_declares(x), F.struct((i + 1).alias("no"), x.alias("line"))))
    )
    found = known.withColumn("hits", hits)

    # the hundred characters above a Python class lie within the hundred lines above it
    def dataclass(no: Column) -> Column:
        start = F.greatest(F.lit(1), no - 100)
        before = F.concat(F.array_join(F.slice("ls", start, no - start), "\n"), F.lit("\n"))
        return (ext == ".py") & F.contains(F.right(before, F.lit(100)), F.lit("@dataclass"))

    kept = F.when(ext == ".java", F.slice("hits", 1, 1)).otherwise(F.col("hits"))
    rows = (
        _java_context(found)
        .select(
            "repo_id",
            "path",
            "ext",
            "doc",
            "above_annotations",
            F.when(ext.isin(".java", *script), F.size("ls")).otherwise(0).cast("bigint").alias("loc"),
            # outer: no filter on the array is inferred, which would search the lines twice
            F.explode_outer(
                F.transform(kept, lambda h: F.struct(h["no"].alias("no"), h["line"].alias("line"), dataclass(h["no"]).alias("dc")))
            ).alias("h"),
        )
        .filter("h IS NOT NULL")
        .select("*", F.col("h.no").cast("bigint").alias("line_no"), F.col("h.line").alias("line"), C.strip("h.line").alias("trimmed"))
    )

    def part(java: int, python: int | None, go: int, rust: int, other: int) -> Column:
        trimmed, line = F.col("trimmed"), F.col("line")
        return (
            F.when(ext == ".java", F.regexp_extract(trimmed, _JAVA_DECL, java))
            .when(ext == ".py", F.lit("class") if python is None else F.regexp_extract(line, _PYTHON_DECL, python))
            .when(ext == ".go", F.regexp_extract(line, _GO_DECL, go))
            .when(ext == ".rs", F.regexp_extract(line, _RUST_DECL, rust))
            .otherwise(F.regexp_extract(trimmed, _SCRIPT_DECL, other))
        )

    extends = F.regexp_extract("trimmed", _JAVA_DECL, 3)
    implements = F.transform(
        _split_names(F.regexp_extract("trimmed", _JAVA_DECL, 4)), lambda s: C.strip(F.element_at(F.split(s, "<"), 1))
    )
    supers = (
        F.when(ext == ".java", F.concat(F.when(extends != "", F.array(extends)).otherwise(_empty()), implements))
        .when(ext == ".py", _split_names(F.regexp_extract("line", _PYTHON_DECL, 2)))
        .otherwise(_empty())
    )
    annotations = (
        F.when(ext == ".java", F.col("above_annotations"))
        .when(F.col("h.dc"), F.array(F.lit("@dataclass")))
        .otherwise(_empty())
    )
    typed = rows.select(
        "repo_id",
        F.col("path").alias("file"),
        "line_no",
        part(2, 1, 1, 2, 2).alias("name"),
        part(1, None, 2, 1, 1).alias("kind"),
        supers.alias("super_types"),
        annotations.alias("annotations"),
        "loc",
        F.when(ext == ".java", F.nullif(F.col("doc"), F.lit(""))).alias("doc"),
        (ext == ".java").alias("java"),
    )
    by_annotation = F.when(F.col("java"), C.annotation_role("annotations"))
    return typed.withColumn("description", F.coalesce("doc", by_annotation, C.type_role("name"))).drop("doc", "java")


def hottest(freq: DataFrame, k: int) -> DataFrame:
    """The k most changed paths of every repository."""
    return top_k(freq, k, ["repo_id"], [F.desc("change_count"), F.asc("path")], rank="hot_rank")


def key_types(types: DataFrame, freq: DataFrame | None = None, hot: int | None = None, k: int = 60) -> DataFrame:
    """The ``k`` largest types of files that are no tests, or of the ``hot`` hottest of them by ``freq`` (AGG-32)."""
    f = F.col("file")
    hits = types.filter(~F.contains(f, F.lit("test")) & ~F.contains(f, F.lit("Test")))
    if hot is not None:
        top = hottest(freq, hot).select("repo_id", F.col("path").alias("file"))
        hits = hits.join(top, ["repo_id", "file"], "left_semi")
    return top_k(hits, k, ["repo_id"], [F.desc("loc"), F.asc("file"), F.asc("line_no")])


def annotation_usage(types: DataFrame, examples: int = 3) -> DataFrame:
    """How many types carry each annotation, with example files (AGG-15)."""
    used = types.select("repo_id", "file", "line_no", F.explode("annotations").alias("annotation"))
    counts = used.groupBy("repo_id", "annotation").agg(F.count(F.lit(1)).alias("n"))
    shown = (
        top_k(used, examples, ["repo_id", "annotation"], [F.asc("file"), F.asc("line_no")])
        .groupBy("repo_id", "annotation")
        .agg(collect_ranked("rank", "file").alias("examples"))
    )
    return counts.join(shown, ["repo_id", "annotation"])


def _literal_counts(df: DataFrame, text: Column, patterns: Sequence[tuple]) -> DataFrame:
    """Files per pattern that contain one of its literals; patterns without a hit count 0."""
    hits = [C.any_of([F.contains(text, F.lit(x)) for x in literals]) for _, literals, _ in patterns]
    return flag_counts(df, hits, patterns)


def flag_counts(df: DataFrame, hits: Sequence[Column], patterns: Sequence[tuple]) -> DataFrame:
    """Files per pattern whose flag among ``hits`` is set."""
    counted = df.groupBy("repo_id").agg(*[F.count_if(hit).alias(f"_c{i}") for i, hit in enumerate(hits)])
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("pattern"), F.col(f"_c{i}").alias("n_files"), F.lit(limit).alias("limit"))
            for i, (name, _, limit) in enumerate(patterns)
        ]
    )
    return counted.select("repo_id", F.explode(rows).alias("r")).select(
        "repo_id",
        F.col("r.pattern").alias("pattern"),
        F.col("r.n_files").alias("n_files"),
        (F.col("r.n_files") > F.col("r.limit")).alias("present"),
    )


def pattern_prevalence(
    contents: DataFrame,
    freq: DataFrame | None = None,
    patterns: Sequence[tuple] = fv.CODE_PATTERNS,
    hot: int | None = None,
    chars: int | None = None,
) -> DataFrame:
    """Files that contain a literal, per pattern (AGG-16): all files, or the ``hot`` hottest by ``freq``; whole texts unless ``chars`` is given."""
    read = contents
    if hot is not None:
        top = hottest(freq, hot).select("repo_id", "path")
        read = contents.join(top, ["repo_id", "path"], "left_semi")
    text = F.col("text") if chars is None else F.left(F.col("text"), F.lit(chars))
    return _literal_counts(read, text, patterns)


def test_conventions(contents: DataFrame, sample: int | None = None, chars: int | None = None) -> DataFrame:
    """Test libraries in use (AGG-17): every test file, or the first ``sample`` by path."""
    tests = contents.filter(C.is_test_file("path", "library"))
    if sample is not None:
        keep = top_k(tests.select("repo_id", "path"), sample, ["repo_id"], [F.asc("path")])
        tests = tests.join(keep.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    text = F.col("text") if chars is None else F.left(F.col("text"), F.lit(chars))
    return _literal_counts(tests, text, fv.TEST_LIBRARY_PATTERNS)


def code_patterns(annotations: DataFrame, prevalence: DataFrame, tests: DataFrame) -> DataFrame:
    """Named code patterns per repository: generated code, error handling, injection, test style (AGG-15..17)."""
    notes = annotations.groupBy("repo_id").agg(
        F.bool_or(F.col("annotation").isin(*fv.LOMBOK_ANNOTATIONS)).alias("lombok"),
        F.max(F.when(F.col("annotation") == "@AllArgsConstructor", F.col("n"))).alias("all_args"),
    )
    probes = prevalence.groupBy("repo_id").agg(
        *[
            F.max(F.when(F.col("pattern") == name, F.col("n_files"))).alias(name)
            for name, _, _ in fv.CODE_PATTERNS
        ]
    )
    styled = tests.groupBy("repo_id").agg(F.bool_or("present").alias("styled"))
    facts = notes.join(probes, "repo_id", "full").join(styled, "repo_id", "full")
    zero = F.lit(0).cast("bigint")
    all_args, autowired = F.coalesce("all_args", zero), F.coalesce("autowired", zero)
    names = F.array_compact(
        F.array(
            F.when(F.coalesce("lombok", F.lit(False)), "Lombok annotations"),
            F.when(F.coalesce("either", zero) > 3, "Vavr Either for error handling"),
            F.when(F.coalesce("problem", zero) > 0, "RFC 7807 Problem responses"),
            F.when((all_args > 5) & (autowired < all_args), "Constructor injection via Lombok").when(
                autowired > 5, "Mixed dependency injection"
            ),
            F.when(F.coalesce("styled", F.lit(False)), "Test conventions"),
        )
    )
    return facts.select("repo_id", F.explode(names).alias("pattern"))
