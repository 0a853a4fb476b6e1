from collections import Counter
from itertools import combinations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolith.operators import cochange, history, incremental

CHANGES = "repo_id STRING, commit_id BIGINT, committed_at TIMESTAMP_NTZ, path STRING, insertions BIGINT, deletions BIGINT"
COMMITS = "repo_id STRING, commit_id BIGINT, author STRING, email STRING, committed_at TIMESTAMP_NTZ, subject STRING, body STRING, is_merge BOOLEAN"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def changes_of(spark, commits):
    """commits: list of (repo, commit id, paths); the id is the day."""
    return spark.createDataFrame(
        [(r, c, day(c), p, 1, 0) for r, c, paths in commits for p in paths], CHANGES
    )


def test_frequency_fixture(spark, rows):
    df = changes_of(spark, [("r", 1, ["src/a.ts", "src/b.ts"]), ("r", 2, ["src/a.ts"])])
    assert rows(history.hot_files(df), "path", "change_count", "rank") == [("src/a.ts", 2, 1), ("src/b.ts", 1, 2)]
    assert rows(history.hot_files(df, k=1), "path") == [("src/a.ts",)]


def brute_pairs(commits, max_files, min_count):
    counts = Counter()
    for repo, _, paths in commits:
        if len(paths) <= max_files:
            counts.update((repo, a, b) for a, b in combinations(sorted(paths), 2))
    return sorted((*k, n) for k, n in counts.items() if n >= min_count)


paths = st.sets(st.sampled_from("abcdefgh"), min_size=1, max_size=8)
logs = st.lists(st.tuples(st.sampled_from(["r1", "r2"]), paths), min_size=1, max_size=25)
quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@quick
@given(logs)
def test_co_change_equals_brute_force(spark, rows, log):
    commits = [(r, n, sorted(p)) for n, (r, p) in enumerate(log)]
    got = rows(cochange.co_change_counts(changes_of(spark, commits), max_files=5, min_count=2))
    assert sorted(got) == brute_pairs(commits, 5, 2)
    assert all(a < b for _, a, b, _ in got)


@quick
@given(logs, st.integers(0, 25))
def test_merge_of_prefix_and_suffix_equals_batch(spark, rows, log, cut):
    commits = [(r, n, sorted(p)) for n, (r, p) in enumerate(log)]
    whole = changes_of(spark, commits)
    old, new = whole.filter(F.col("commit_id") < cut), whole.filter(F.col("commit_id") >= cut)
    merged = incremental.merge_frequency(history.file_frequency(old), history.file_frequency(new))
    assert rows(merged) == rows(history.file_frequency(whole))
    pairs = incremental.merge_pairs(*[cochange.co_change_counts(x, 5, 1) for x in (old, new)]).filter("n >= 2")
    assert rows(pairs) == rows(cochange.co_change_counts(whole, 5, 2))


@quick
@given(logs, st.integers(1, 4), st.integers(2, 9))
def test_commits_of_any_width(spark, rows, log, min_count, part):
    """Few and many wide commits, by parts of a few files."""
    commits = [(r, n, sorted(p)) for n, (r, p) in enumerate(log)]
    got = rows(cochange.co_change_counts(changes_of(spark, commits), min_count=min_count, part=part))
    assert got == brute_pairs(commits, 99, min_count)


@quick
@given(logs, st.integers(1, 4), st.integers(2, 9), st.integers(0, 30), st.integers(0, 60))
def test_repositories_of_any_size(spark, rows, log, min_count, part, whole_rows, whole_pairs):
    """Counted whole in a task or dealt, the pairs are the same."""
    commits = [(r, n, sorted(p)) for n, (r, p) in enumerate(log)]
    df = changes_of(spark, commits + [(None, 1, ["a", "b"])])
    before = cochange.WHOLE_ROWS, cochange.WHOLE_PAIRS
    cochange.WHOLE_ROWS, cochange.WHOLE_PAIRS = whole_rows, whole_pairs
    try:
        assert rows(cochange.co_change_counts(df, min_count=min_count, part=part)) == brute_pairs(commits, 99, min_count)
    finally:
        cochange.WHOLE_ROWS, cochange.WHOLE_PAIRS = before


def test_pairs_of_small_repositories_are_not_dealt(spark, monkeypatch):
    df = changes_of(spark, [(f"r{c % 3}", c, ["a", "b", "c"]) for c in range(12)])
    plan = lambda: cochange.co_change_counts(df)._jdf.queryExecution().executedPlan().toString()
    dealt = lambda: any("file_a" in keys.split(")")[0] for keys in plan().split("hashpartitioning(")[1:])
    assert not dealt()
    monkeypatch.setattr(cochange, "WHOLE_PAIRS", 1)
    counts = cochange.co_change_counts(df)
    assert dealt() and counts.count() == 9


def test_a_commit_of_5000_files(spark):
    """Pairs of three such commits are counted, of one such commit only those that others make likely."""
    files = [f"f{k:04d}" for k in range(5000)]
    three = [("r", c, files[c:]) for c in range(3)]
    one = [("s", 0, files), ("s", 1, ["f0001", "f0002"]), ("s", 2, ["f0002", "f0001", "f0009"]), ("s", 3, ["f0009", "x"])]
    counts = cochange.co_change_counts(changes_of(spark, three + one)).groupBy("repo_id", "n").count().collect()
    # files 2..4999 are in all of the three
    assert sorted((r["repo_id"], r["n"], r["count"]) for r in counts) == [("r", 3, 4998 * 4997 // 2), ("s", 3, 1)]


def test_no_task_holds_more_than_two_parts(spark):
    wide = changes_of(spark, [("r", 1, [f"f{k}" for k in range(3000)])]).withColumn("width", F.lit(3000))
    cells = 12 * 13 // 2
    sizes = cochange.grid_pairs(wide, 256).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 3000 * 2999 // 2
    plan = cochange.grid_pairs(wide, 256)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(repo_id" in plan and "low" in plan and "high" in plan and cells == 78


def test_a_path_counts_once_a_commit_and_width_can_be_limited(spark, rows):
    df = changes_of(spark, [("r", c, ["a", "b", "a"]) for c in range(3)])
    assert rows(cochange.co_change_counts(df)) == [("r", "a", "b", 3)]
    assert rows(cochange.co_change_counts(df, max_files=2)) == []
    wide = [f"f{k:03d}" for k in range(51)]
    df = changes_of(spark, [("r", c, wide) for c in range(3)] + [("r", 10 + c, wide[:50]) for c in range(3)])
    counts = cochange.co_change_counts(df, max_files=50)
    assert counts.count() == 50 * 49 // 2 and {r["n"] for r in counts.collect()} == {3}
    freq = history.file_frequency(df)
    strengths = {r["strength"] for r in cochange.co_change_pairs(counts, freq, top_n=None).collect()}
    assert strengths == {0.5}


def test_strength_and_missing_partner(spark, rows):
    df = changes_of(spark, [("r", c, ["a", "b"]) for c in range(3)] + [("r", 9, ["a"])])
    pairs = cochange.co_change_pairs(cochange.co_change_counts(df), history.file_frequency(df))
    assert rows(pairs) == [("r", "a", "b", 3, 1.0, 1)]
    changeset = spark.createDataFrame([("r", 9, "a"), ("r", 8, "a"), ("r", 8, "b")], "repo_id STRING, change_id BIGINT, path STRING")
    assert rows(cochange.missing_partners(changeset, pairs)) == [("r", 9, "a", "b", 3, 1.0)]
    assert rows(cochange.missing_partners(changeset, pairs, min_strength=1.1)) == []
    assert rows(cochange.missing_partners(changeset, pairs, per_file=1)) == [("r", 9, "a", "b", 3, 1.0)]
    assert rows(cochange.missing_partners(changeset, pairs, per_file=0)) == []


@quick
@given(logs, logs, st.integers(1, 9))
def test_missing_partners_equal_brute_force(spark, rows, log, sets, part):
    """Narrow and wide change sets, repeated rows and changes without a name."""
    pairs = brute_pairs([(r, n, sorted(p)) for n, (r, p) in enumerate(log)], 99, 1)
    given_rows = [(r, n or None, p) for n, (r, ps) in enumerate(sets) for p in sorted(ps)]
    given_rows += given_rows[:2]
    present = {(r, n, p) for r, n, p in given_rows if n is not None}
    both = [(r, x, y, k) for r, a, b, k in pairs for x, y in ((a, b), (b, a))]
    expected = [(r, n, p, y, k, 1.0) for r, n, p in given_rows for q, x, y, k in both if (q, x) == (r, p) and (r, n, y) not in present]
    frame = spark.createDataFrame([(*x, 1.0) for x in pairs], "repo_id STRING, file_a STRING, file_b STRING, n BIGINT, strength DOUBLE")
    changeset = spark.createDataFrame(given_rows, "repo_id STRING, change_id BIGINT, path STRING")
    assert rows(cochange.missing_partners(changeset, frame, part=part)) == sorted(expected, key=repr)


def test_partners_of_narrow_changes_are_not_dealt_again(spark):
    pairs = spark.createDataFrame([("r", "a", "b", 3, 1.0), ("r", "a", "c", 3, 1.0)], "repo_id STRING, file_a STRING, file_b STRING, n BIGINT, strength DOUBLE")
    changeset = spark.createDataFrame([("r", 1, "a"), ("r", 1, "b"), ("r", 2, "c")], "repo_id STRING, change_id BIGINT, path STRING")
    plan = lambda part: cochange.missing_partners(changeset, pairs, part=part)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan(256) and "LeftAnti" in plan(1)


def commits_of(spark, subjects, merges=()):
    return spark.createDataFrame(
        [("r", n, f"A{n % 2}", "" if n % 2 else "a@x", day(n), s, "", n in merges) for n, s in enumerate(subjects)], COMMITS
    )


def test_conventions_fixture(spark):
    best = history.dominant_commit_style(commits_of(spark, ["feat: a", "fix: b", "docs(x): c"])).first()
    assert (best["pattern"], best["confidence"], best["examples"]) == ("conventional", 1.0, ["docs(x): c", "fix: b", "feat: a"])
    assert history.dominant_commit_style(commits_of(spark, ["AB-1 x", "AB-2 y", "word"])).first()["pattern"] == "jira"
    named = changes_of(spark, [("r", 0, ["user-service.ts", "auth-handler.ts", "api-client.ts", "notes.md"])])
    assert history.dominant_naming(named).first()["pattern"] == "kebab"
    assert history.dominant_naming(changes_of(spark, [("r", 0, ["x.md"])])).count() == 0
    assert history.dominant_commit_style(commits_of(spark, [])).count() == 0


def test_people(spark, rows):
    got = history.contributors(commits_of(spark, ["a", "b", "c", "d"]))
    assert rows(got, "key", "name", "commits") == [("A1", "A1", 2), ("a@x", "A0", 2)]


def test_branch_patterns(spark):
    subjects = ["Merge pull request #1 from acme/feature/dev_x", "work on the thing", "Merge pull request #2 from acme/feature/y", "fix"]
    df = commits_of(spark, subjects, merges=(0, 2))
    new = history.commit_patterns(df).first()
    assert new["branch_pattern"] == "feature/dev_<author>/<description> or feature/<description>"
    assert new["merge_strategy"] == "merge-commit" and new["examples"] == ["work on the thing"] and new["avg_commits_per_pr"] == 1
    assert history.commit_patterns(df, legacy=True).first()["branch_pattern"] == "y, dev_x"


def test_added_deleted(spark, rows):
    df = changes_of(spark, [("r", 0, ["a", "gone"]), ("r", 1, ["b"])])
    files = spark.createDataFrame([("r", "a"), ("r", "b")], "repo_id STRING, path STRING")
    got = rows(history.added_deleted(df, files, newest=1), "path", "event")
    assert got == [("b", "added")]
    assert rows(history.added_deleted(df, files, newest=None), "path", "event") == [
        ("a", "added"), ("b", "added"), ("gone", "added"), ("gone", "deleted"),
    ]


def test_a_path_named_often_does_not_widen_its_commit(spark, rows, monkeypatch):
    """The grid of a wide commit has its different files, however often each is named."""
    seen = []
    grid = cochange.grid_pairs
    monkeypatch.setattr(cochange, "grid_pairs", lambda wide, part: seen.append(wide.count()) or grid(wide, part))
    df = changes_of(spark, [("r", c, [f"f{k}" for k in range(6)] * 50) for c in range(3)])
    assert len(rows(cochange.co_change_counts(df, part=4))) == 15 and seen == [18]
