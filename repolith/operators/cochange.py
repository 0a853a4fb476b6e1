"""Files that change together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import fixed_values as fv
from repolith.functions.ranking import top_k
from repolith.session import rule_frame, stage


#: Files of a commit whose pairs come from one row; wider commits are dealt as a grid of such parts.
PAIR_PART = 256
#: Changes, and pairs made of them, of a repository that one task takes whole; those of larger ones are dealt.
WHOLE_ROWS, WHOLE_PAIRS = 1 << 20, 1 << 22


def up_to_width(changes: DataFrame, max_files: int) -> DataFrame:
    """Changes of the commits with at most ``max_files`` files."""
    widths = changes.groupBy("repo_id", "commit_id").agg(F.count(F.lit(1)).alias("width"))
    return changes.join(widths.filter(F.col("width") <= max_files), ["repo_id", "commit_id"], "left_semi")


def often_changed(changes: DataFrame, min_count: int) -> DataFrame:
    """Changes of files that change often enough to be part of a pair that is counted ``min_count`` times."""
    if min_count <= 1:
        return changes
    counts = changes.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("n"))
    return changes.join(counts.filter(F.col("n") >= min_count), ["repo_id", "path"], "left_semi")


def by_size(rows: DataFrame, amount: Column, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the repositories whose ``amount`` adds up to ``most`` at the utmost, dealt by repository, and those of larger ones.

    The driver holds the names of the larger ones, of which there is one for each ``most`` of the whole amount at the utmost.
    """
    found = rows.groupBy("repo_id").agg(F.sum(amount).alias("n")).filter(F.col("n") > most).select("repo_id").collect()
    if not found:
        return rows.repartition("repo_id"), None
    large = rule_frame(rows.sparkSession, found, f"repo_id {rows.schema['repo_id'].dataType.simpleString()}")
    return rows.join(large, "repo_id", "left_anti").repartition("repo_id"), rows.join(large, "repo_id", "left_semi")


def _within(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the number of rows of their group; no exchange where they are dealt by some of the keys."""
    return rows.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def pairing_files(rows: DataFrame, min_count: int) -> DataFrame:
    """repo_id, commit_id, path, width: each file of a commit once, where it changes ``min_count`` times and does not change alone.

    A repository of up to ``WHOLE_ROWS`` rows goes through one exchange; the paths of larger ones are counted before they are dealt.
    """
    keys = ["repo_id", "commit_id"]
    small, large = by_size(rows, F.lit(1), WHOLE_ROWS)
    once = small.distinct()
    if min_count > 1:
        once = _within(once, ["repo_id", "path"], "_n").filter(F.col("_n") >= min_count).drop("_n")
    found = _within(once, keys, "width")
    if large is not None:
        # a path that a commit names often would make it as much wider, and its grid that squared
        often = often_changed(large.repartition(*keys).distinct(), min_count)
        found = found.unionByName(_within(often, keys, "width"))
    return found.filter("width > 1")


def explode_pairs(commits: DataFrame) -> DataFrame:
    """One row per unordered file pair of a commit (JOIN-01). Row-local: no self join, no shuffle."""
    return (
        commits.select("repo_id", "files", F.posexplode("files").alias("pos", "file_a"))
        .select(
            "repo_id",
            "file_a",
            F.explode(F.slice("files", F.col("pos") + 2, F.size("files"))).alias("file_b"),
        )
        .filter("file_a < file_b")
    )


def _cells(parts: Column, own: Column) -> Column:
    """Cells (low, high) of the grid in which part ``own`` meets the others and itself."""
    cell = lambda p: F.struct(F.least(p, own).alias("low"), F.greatest(p, own).alias("high"))
    return F.transform(F.sequence(F.lit(0), parts - 1), cell)


def grid_pairs(wide: DataFrame, part: int = PAIR_PART) -> DataFrame:
    """Pairs of the files of wide commits, of rows (repo_id, commit_id, path, width).

    A commit's files fall into parts of about ``part``; every two parts meet in one row, and each part meets
    itself. The rows of one commit are dealt over all tasks, so none holds more than two parts of it.
    """
    parts = F.ceil(F.col("width") / part).cast("int")
    own = F.pmod(F.xxhash64("path"), parts).cast("int")
    dealt = (
        wide.select("repo_id", "commit_id", "path", own.alias("own"), F.inline(_cells(parts, own)))
        .repartition("repo_id", "commit_id", "low", "high")
    )
    met = dealt.groupBy("repo_id", "commit_id", "low", "high").agg(
        F.array_sort(F.collect_set(F.when(F.col("own") == F.col("low"), F.col("path")))).alias("files"),
        F.collect_set(F.when((F.col("own") == F.col("high")) & (F.col("low") < F.col("high")), F.col("path"))).alias("across"),
    )
    later = F.slice("files", F.col("pos") + 2, F.size("files"))
    others = F.when(F.col("low") == F.col("high"), later).otherwise(F.col("across"))
    pairs = met.select("*", F.posexplode("files").alias("pos", "x")).select("repo_id", "x", F.explode(others).alias("y"))
    return pairs.select("repo_id", F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b"))


def _count(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("repo_id", "file_a", "file_b").agg(F.count(F.lit(1)).alias("n"))


def co_change_counts(
    changes: DataFrame, max_files: int | None = None, min_count: int = fv.PAIR_MIN_COUNT, part: int = PAIR_PART
) -> DataFrame:
    """How often two files change in one commit, of any width (JOIN-01, AGG-03).

    A pair counted ``min_count`` times needs two files changed that often: all other changes go before pairs
    are made. The pairs of a commit of up to ``part`` files come from its own row. Where a repository has fewer wider commits than
    ``min_count``, a pair needs the rest of its count from narrow ones: only those pairs are looked up in
    the wide commits, and none is made there. The wide commits of other repositories are dealt as a grid.
    Most pairs occur once or twice, so adding them up before an exchange gains nothing where a repository is small: its
    changes go through the exchange and its pairs are counted where they are made. Only pairs of larger ones are dealt.
    A path counts once per commit; the files that may pair are written once for all branches. ``max_files`` leaves wider commits out, for callers that want it.
    ``changes`` is read more than once: a table, not a plan.
    """
    rows = changes.select("repo_id", "commit_id", "path")
    if max_files is not None:
        rows = up_to_width(rows, max_files)
    rows = rows.dropna()
    files = stage(pairing_files(rows, min_count), "files")
    widths = files.select("repo_id", "commit_id", "width").filter(F.col("width") > part)
    counts = None
    for some in by_size(files.filter(F.col("width") <= part), (F.col("width") - 1) / 2, WHOLE_PAIRS):
        if some is not None:
            commits = some.groupBy("repo_id", "commit_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
            counted = _count(explode_pairs(commits))
            counts = counted if counts is None else counts.unionByName(counted)
    if (max_files is not None and max_files <= part) or widths.isEmpty():
        return counts.filter(F.col("n") >= min_count)

    n_wide = widths.distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_wide"))
    wide = files.filter(F.col("width") > part).join(n_wide, "repo_id")
    many = _count(grid_pairs(wide.filter(F.col("n_wide") >= min_count), part))
    # few wide commits: their pairs are known from narrow ones
    few = wide.filter(F.col("n_wide") < min_count).select("repo_id", "commit_id", "path").distinct()
    likely = counts.join(n_wide.filter(F.col("n_wide") < min_count), "repo_id").filter(F.col("n") >= min_count - F.col("n_wide"))
    seen = (
        likely.select("repo_id", "file_a", "file_b")
        .join(few.withColumnRenamed("path", "file_a"), ["repo_id", "file_a"])
        .join(few.withColumnRenamed("path", "file_b"), ["repo_id", "commit_id", "file_b"], "left_semi")
    )
    total = counts.unionByName(many).unionByName(_count(seen))
    return total.groupBy("repo_id", "file_a", "file_b").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def pair_strength(counts: DataFrame, freq: DataFrame) -> DataFrame:
    """Pair count over the smaller change count of its files; unknown files count 1 (JOIN-02)."""
    f = freq.select("repo_id", "path", "change_count")
    fa = f.withColumnsRenamed({"path": "file_a", "change_count": "freq_a"})
    fb = f.withColumnsRenamed({"path": "file_b", "change_count": "freq_b"})
    smaller = F.least(F.coalesce("freq_a", F.lit(1)), F.coalesce("freq_b", F.lit(1)))
    return (
        counts.join(fa, ["repo_id", "file_a"], "left")
        .join(fb, ["repo_id", "file_b"], "left")
        .select("repo_id", "file_a", "file_b", "n", (F.col("n") / smaller).alias("strength"))
    )


def co_change_pairs(counts: DataFrame, freq: DataFrame, top_n: int | None = 20) -> DataFrame:
    """Strongest pairs per repository (TOP-02)."""
    pairs = pair_strength(counts, freq)
    if top_n is None:
        return pairs
    order = [F.desc("strength"), F.desc("n"), F.asc("file_a"), F.asc("file_b")]
    return top_k(pairs, top_n, ["repo_id"], order)


def missing_partners(
    changeset: DataFrame, pairs: DataFrame, min_strength: float = 0.0, per_file: int | None = None, part: int = PAIR_PART
) -> DataFrame:
    """Usual partners that a change set leaves out (JOIN-09). Change sets are (repo_id, change_id, path).

    ``per_file`` keeps the strongest partners of each file only, chosen before any change set is met, so a
    file that changes with everything meets a change set that often at most. Every row of a change set of up to
    ``part`` files holds all of its paths, so partners are told where they meet it, and only those of wider ones go through another exchange.
    """
    strong = pairs.filter(F.col("strength") >= min_strength)
    both = strong.select("repo_id", F.col("file_a").alias("path"), F.col("file_b").alias("missing"), "n", "strength")
    both = both.unionByName(
        strong.select("repo_id", F.col("file_b").alias("path"), F.col("file_a").alias("missing"), "n", "strength")
    )
    if per_file is not None:
        both = top_k(both, per_file, ["repo_id", "path"], [F.desc("strength"), F.desc("n"), F.asc("missing")])
    columns = ["repo_id", "change_id", F.col("path").alias("changed"), "missing", "n", "strength"]
    change = Window.partitionBy("repo_id", "change_id")
    files = changeset.select("repo_id", "change_id", "path").withColumn("width", F.count(F.lit(1)).over(change))
    # empty for wide changes, whose rows would hold their square; a change without a name has no files of its own
    own = F.collect_set(F.when((F.col("width") <= part) & F.col("change_id").isNotNull(), F.col("path"))).over(change)
    files = stage(files.withColumn("present", own), "present")
    narrow = files.filter(F.col("width") <= part).join(both, ["repo_id", "path"])
    out = narrow.filter(~F.array_contains("present", F.col("missing"))).select(*columns)
    wide = files.filter(F.col("width") > part)
    if wide.isEmpty():
        return out
    present = wide.select("repo_id", "change_id", F.col("path").alias("missing"))
    absent = wide.join(both, ["repo_id", "path"]).join(present, ["repo_id", "change_id", "missing"], "left_anti")
    return out.unionByName(absent.select(*columns))
