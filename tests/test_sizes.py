"""Sizes that must not grow with the input: broadcasts, shares of an exchange, files of an export, tasks of a log."""

from pyspark.sql import functions as F

from repolith import session
from repolith.plans import source_queries
from repolith.sources import logsource
from repolith.sources.logsource import LogSplit


def test_a_packed_file_is_not_broadcast_by_its_size(spark, tmp_path):
    """Names that repeat make a file of some KB of rows that take 100 MB."""
    named = spark.range(500_000).select("id", F.repeat(F.lit("name"), 40).alias("name"))
    named.write.parquet(str(tmp_path / "named"))
    joined = lambda: spark.range(10).join(spark.read.parquet(str(tmp_path / "named")), "id", "left")
    plan = lambda: joined()._jdf.queryExecution().executedPlan().toString()
    session.unsize(spark)
    assert "BroadcastHashJoin" in plan()
    try:
        session.size(spark, 0)
        assert "BroadcastHashJoin" not in plan()
        assert joined().filter("name IS NULL").isEmpty()
    finally:
        session.unsize(spark)
    assert "BroadcastHashJoin" in plan()


def test_exchanges_have_more_partitions_for_larger_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    session.unsize(spark)
    try:
        session.size(spark, 1 << 20)
        assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")
        session.size(spark, 6 << 30)
        assert spark.conf.get(key) == "1536"
        session.size(spark, 1 << 20)
        assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        session.unsize(spark)
    assert spark.conf.get(key, None) is None


def test_an_export_has_a_file_per_repository(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("r"), F.col("id") % 50).alias("repo_id"), F.col("id").cast("string").alias("value"))
    out = source_queries._write_by_repository(rows, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("repo_id=*/*.txt"))
    assert len(files) == 50 and spark.read.text(out).count() == 4000


def test_small_splits_share_a_task():
    found = [LogSplit("/", f"f{k}", 0, 1000) for k in range(5000)] + [LogSplit("/", "large", at, at + (64 << 20)) for at in range(0, 1 << 28, 64 << 20)]
    tasks = logsource.packed(found, 10)
    assert [s for t in tasks for s in t.splits] == found
    assert 10 <= len(tasks) < 20 and all(len(t.splits) == 1 for t in tasks if t.splits[0].path == "large")
    assert len(logsource.packed(found[:100], 16)) == 17
    assert len(logsource.packed([LogSplit("/", "", 0, 0)], 16)) == 1


def test_changes_are_grouped_where_the_commits_are_joined(spark):
    """The changes view deals its lines twice, for the parts and for the commits, and its query writes it once."""
    from repolith.plans import registry, testviews

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = testviews.view(spark, "/root/testdata/sf0.001", "v_changes")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4 and "hashpartitioning(repo_id" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    inputs = registry.Inputs(spark, "/root/testdata/sf0.001")
    written = inputs.write("v_changes", "repo_id", "commit_id", "path")
    assert written.columns == ["repo_id", "commit_id", "path"] and inputs.v_changes is written
    read = {name.rsplit("/", 2)[1] for name in inputs.v_changeset.inputFiles()}
    assert "v_changes" in read and not any("lineitem" in name for name in inputs.v_changeset.inputFiles())
