"""Column functions: path parts, predicates, text classes and grades. All built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolith.functions import fixed_values as fv


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(cases: Iterable[tuple[Column, str | None]], default: str | None) -> Column:
    """Ordered ``when`` chain; the first true condition gives its label."""
    chain = None
    for condition, label in cases:
        chain = F.when(condition, F.lit(label)) if chain is None else chain.when(condition, F.lit(label))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def js_round(c: Column) -> Column:
    """Round half up, towards positive infinity."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def strip(c: Column | str) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(_col(c), F.lit(" \t\r\n\f\v"))


# --- paths ----------------------------------------------------------------------------------


def resolve_rename(c: Column | str) -> Column:
    """``pre{old => new}post`` to ``prenewpost``; plain ``old => new`` to ``new`` (PRJ-02)."""
    braced = F.regexp_replace(_col(c), r"^(.*)\{([^}]*) => ([^}]*)\}(.*)$", "$1$3$4")
    plain = F.when(F.contains(braced, F.lit(" => ")), F.element_at(F.split(braced, " => "), -1)).otherwise(braced)
    return F.regexp_replace(plain, "/{2,}", "/")


def base_name(c: Column | str) -> Column:
    return F.element_at(F.split(_col(c), "/"), -1)


def extension(c: Column | str) -> Column:
    """Text from the last dot of the base name, as written; a leading dot starts no extension."""
    return F.regexp_extract(_col(c), r"[^/](\.[^./]*)$", 1)


def stem(c: Column | str) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(c), r"^(.+)\.[^.]*$", "$1")


def directory(c: Column | str) -> Column:
    """Parent directory, or the empty string for a root file."""
    return F.regexp_extract(_col(c), r"^(.*)/[^/]*$", 1)


def path_parts(c: Column | str) -> dict[str, Column]:
    """ext (lower case), name, dir, top_dir (first segment), depth (PRJ-04)."""
    segments = F.split(_col(c), "/")
    return {
        "ext": F.lower(extension(c)),
        "name": F.element_at(segments, -1),
        "dir": directory(c),
        "top_dir": F.element_at(segments, 1),
        "depth": F.size(segments).cast("bigint"),
    }


def in_ignored_dir(c: Column | str, ignored: Sequence[str] = fv.IGNORED_DIRS) -> Column:
    """Any segment of the path is in the ignore set (PRJ-05)."""
    return F.arrays_overlap(F.split(_col(c), "/"), F.array(*[F.lit(d) for d in ignored]))


def language(c: Column | str, table: dict[str, str] | None = None) -> Column:
    """Language of the extension, null when unknown (PRJ-06). A map literal: no join needed."""
    table = fv.EXTENSION_LANGUAGES if table is None else table
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, F.lower(extension(c)))


def is_test_file(c: Column | str, variant: str = "architecture") -> Column:
    return _col(c).rlike(fv.TEST_FILE_PATTERNS[variant])


def test_location(c: Column | str, variant: str = "architecture") -> Column:
    """'separate', 'colocated', or null for a file that is no test (PRJ-07)."""
    path = _col(c)
    separate = any_of([path.startswith(d) for d in fv.TEST_DIRS])
    return F.when(is_test_file(c, variant), F.when(separate, "separate").otherwise("colocated"))


def is_source_file(c: Column | str) -> Column:
    """Files whose imports are read (PRJ-27)."""
    return _col(c).rlike(fv.IMPORT_SOURCE)


def normalise_path(c: Column) -> Column:
    """Fold ``.`` and ``..`` segments; a leading ``..`` that leaves the root is kept."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        pop = (part == "..") & last.isNotNull() & (last != "..")
        return (
            F.when((part == "") | (part == "."), done)
            .when(pop, F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(c, "/"), empty, step), "/")


# --- names and messages ---------------------------------------------------------------------


def commit_style(c: Column | str, styles: Sequence[tuple[str, str]] = fv.COMMIT_STYLES) -> Column:
    """First matching commit style (PRJ-08)."""
    return first_match([(_col(c).rlike(p), name) for name, p in styles if p], "free")


def naming_style(c: Column | str) -> Column:
    """kebab, snake, camel or pascal by base name; null when none fits (PRJ-09)."""
    name = stem(c)
    return first_match([(name.rlike(p), style) for style, p in fv.NAMING_STYLES], None)


def is_naming_source(c: Column | str) -> Column:
    return extension(c).isin(*fv.NAMING_EXTENSIONS)


def is_meaningful_subject(c: Column | str) -> Column:
    """Longer than ten characters and not a trivial word (PRJ-18)."""
    return (F.length(_col(c)) > 10) & ~strip(c).rlike(fv.TRIVIAL_SUBJECT)


def commit_message(subject: Column | str, body: Column | str) -> Column:
    """Subject, blank line, body; the subject alone when there is no body (PRJ-03)."""
    s, b = _col(subject), _col(body)
    return F.when(F.coalesce(b, F.lit("")) == "", s).otherwise(F.concat(s, F.lit("\n\n"), b))


def short_sha(c: Column | str) -> Column:
    return F.left(_col(c), F.lit(7))


# --- dependencies and types -----------------------------------------------------------------


def dependency_group(c: Column | str, groups: Sequence[tuple[str, str]] = fv.DEPENDENCY_GROUPS) -> Column:
    """First matching group, else 'other' (PRJ-12)."""
    return first_match([(_col(c).rlike(f"(?i){p}"), g) for p, g in groups], "other")


def short_name(c: Column | str) -> Column:
    """Text after the last colon (PRJ-24)."""
    return F.element_at(F.split(_col(c), ":"), -1)


def type_role(c: Column | str) -> Column:
    """Role told by the type name, '' when none (PRJ-13)."""
    name = _col(c)
    cases = [
        (name.endswith(word) if at_end else F.contains(name, F.lit(word)), role)
        for word, at_end, role in fv.TYPE_ROLES
    ]
    return first_match(cases, "")


def annotation_role(c: Column | str, table: dict[str, str] | None = None) -> Column:
    """Role of the first annotation that has one (PRJ-14)."""
    table = fv.ANNOTATION_ROLES if table is None else table
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    roles = F.filter(F.transform(_col(c), lambda a: F.try_element_at(literal, a)), lambda r: r.isNotNull())
    return F.try_element_at(roles, F.lit(1))


# --- pull requests --------------------------------------------------------------------------


def pr_topics(title: Column | str, labels: Column | str) -> Column:
    """Topic tags of a pull request; several may apply (PRJ-10)."""
    lower = F.lower(_col(title))
    names = F.transform(_col(labels), lambda x: F.lower(x))
    tags = []
    for tag, words, exact in fv.PR_TOPICS:
        hit = any_of([F.contains(lower, F.lit(w)) for w in words] + [F.array_contains(names, x) for x in exact])
        tags.append(F.when(hit, F.lit(tag)))
    return F.array_compact(F.array(*tags))


def has_test_file(files: Column | str) -> Column:
    """Any changed path is a test file (PRJ-11)."""
    return F.exists(_col(files), lambda f: f.rlike(fv.TEST_FILE_PATTERNS["pull_request"]))


# --- questions ------------------------------------------------------------------------------


def qa_tag(question: Column | str) -> Column:
    """Framework tag of ``[Tag] text``, '' when untagged (PRJ-25)."""
    return F.regexp_extract(_col(question), r"^\[(.+?)\] ", 1)


def qa_text(question: Column | str) -> Column:
    return F.regexp_replace(_col(question), r"^\[.+?\] ", "")


def question_key(c: Column | str) -> Column:
    """Case, spacing and punctuation do not make a different question."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", " "))


# --- grades ---------------------------------------------------------------------------------


def grade(score: Column | str, cuts: Sequence[tuple[int, str]] = fv.CONFIDENCE_CUTS) -> Column:
    """Letter for a score (PRJ-16)."""
    return first_match([(_col(score) >= cut, letter) for cut, letter in cuts], "F")


def test_coverage(n_frameworks: Column, layout: Column) -> Column:
    return (
        F.when((n_frameworks == 0) & (layout == "none"), "none")
        .when(n_frameworks >= 2, "high")
        .when(n_frameworks == 1, "medium")
        .otherwise("low")
    )


def doc_coverage(n_docs: Column) -> Column:
    return F.when(n_docs >= 3, "high").when(n_docs >= 2, "medium").when(n_docs >= 1, "low").otherwise("none")


def ci_coverage(n_ci: Column) -> Column:
    """Coverage buckets (PRJ-17)."""
    return F.when(n_ci >= 2, "full").when(n_ci == 1, "partial").otherwise("none")
