"""The wide fact row of every repository, from its tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions import fixed_values as fv
from repolith.operators import content, deps, history, imports, score, structure, types
from repolith.session import stage


@dataclass
class Tables:
    """Tables of a fleet. Texts are read twice, once for ``digest`` and once for ``types``; both are written for all that asks them."""

    commits: DataFrame
    changes: DataFrame
    files: DataFrame
    contents: DataFrame
    rules: DataFrame

    @property
    def freq(self) -> DataFrame:
        return history.file_frequency(self.changes)

    @cached_property
    def digest(self) -> DataFrame:
        return stage(content.digest(self.contents), "digest")

    @cached_property
    def types(self) -> DataFrame:
        return stage(types.extract_types(self.contents), "types")

    @property
    def manifests(self) -> DataFrame:
        return self.digest.filter("text IS NOT NULL").select("repo_id", "path", "text")

    @property
    def import_edges(self) -> DataFrame:
        return imports.import_edges(imports.resolve_imports(imports.spec_rows(self.digest), self.files))


def services(t: Tables) -> DataFrame:
    chosen = content.compose_files(t.files)
    texts = t.manifests.join(chosen.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    return content.first_services(content.service_map(texts), chosen)


def detected(t: Tables) -> DataFrame:
    return deps.detect_signatures(deps.read_manifests(t.manifests), t.files)


def conventions(t: Tables) -> DataFrame:
    """Conventions found per repository: commit style, naming, test layout, style configurations."""
    layout = structure.test_layout(structure.changed_paths(t.changes), "convention").filter("layout <> 'none'")
    configs = structure.path_facts(t.files).filter("kind = 'style_config'")
    naming = history.dominant_naming(t.changes)
    parts = [t.commits.select("repo_id").distinct(), naming.select("repo_id"), layout.select("repo_id"), configs.select("repo_id")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    return rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_conventions"))


def facts(t: Tables) -> DataFrame:
    """All inputs of the confidence score (AGG-19)."""
    count = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    arch = structure.architecture(t.files).select(
        "repo_id",
        "style",
        F.size("entry_points").cast("bigint").alias("n_entry_points"),
        F.size("layers").cast("bigint").alias("n_layers"),
        F.size("api_patterns").cast("bigint").alias("n_api_patterns"),
    )
    flags = lambda name, table: [F.coalesce(F.get(name, F.lit(n)), F.lit(False)) for n in range(len(table))]
    prevalence = types.flag_counts(t.digest, flags("patterns", fv.CODE_PATTERNS), fv.CODE_PATTERNS)
    tests = t.digest.filter("libraries IS NOT NULL")
    tests = types.flag_counts(tests, flags("libraries", fv.TEST_LIBRARY_PATTERNS), fv.TEST_LIBRARY_PATTERNS)
    patterns = types.code_patterns(types.annotation_usage(t.types), prevalence, tests)
    languages = structure.language_share(t.files).filter("is_primary")
    habits = history.commit_patterns(t.commits)
    return score.confidence_facts(
        t.files,
        content.project_description(t.manifests),
        structure.root_package(t.files),
        languages.select("repo_id", F.col("language").alias("primary_language")),
        score.command_facts(content.build_commands(t.manifests, t.files, distinct_names=False)),
        arch,
        services(t),
        count(patterns, "n_patterns"),
        count(types.key_types(t.types), "n_types"),
        count(content.extract_rules(t.rules), "n_rules"),
        conventions(t),
        habits.select("repo_id", F.col("style").alias("commit_style"), "branch_pattern"),
        t.digest.groupBy("repo_id").agg(F.sum("n_todos").alias("n_todos")),
        count(detected(t).filter("kind = 'test_framework'"), "n_test_frameworks"),
        structure.test_layout(t.files).select("repo_id", "layout"),
    )
