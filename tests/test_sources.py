import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repolith import schemas
from repolith.operators import prs
from repolith.sources import exports, sinks
from repolith.sources.logsource import register
from repolith.sources.versions import Versions
from repolith.streaming.deltas import DeltaTable

SEP = "\x1e"


def header(sha, author="Ann", date="2024-01-01 10:00:00 +0000", subject="feat: x", body="", parents="p1"):
    return SEP.join([sha, author, f"{author.lower()}@x.io", date, subject, body, parents, ""]) + exports.COMMIT_MARK


def log_text(n):
    parts = []
    for k in range(n):
        parts.append(header(f"sha{k:04d}", date=f"2024-01-{1 + k % 28:02d} 10:00:00 +0200", body=f"line one\nline {k}", parents="a b" if k % 5 == 0 else "a"))
        parts.append(f"\n\n{k}\t1\tsrc/f{k % 7}.ts\n-\t-\timg/{k}.png\n2\t0\tsrc/{{old => new}}/g.ts\n")
    return "".join(parts)


WAYS = pytest.mark.parametrize("via", ["source", "text"])


def by_position(rows_):
    """Rows with the log position in place of the byte or record number."""
    order = {at: i for i, at in enumerate(sorted({r[1] for r in rows_}))}
    return sorted(((r[0], order[r[1]], *r[2:]) for r in rows_), key=lambda r: r[:2])


@WAYS
def test_commit_log(spark, tmp_path, rows, via):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "alpha.log").write_text(
        header("abc1234567", body="body text") + "\n\n10\t2\tsrc/a.ts\n-\t-\timg/x.png\n"
        + header("def", author="", parents="p1 p2") + "\n\n1\t0\tsrc/{old => new}/b.ts\n" + "bad" + SEP + "record" + exports.COMMIT_MARK
    )
    (folder / "_SUCCESS").write_text("")
    commits, changes = exports.read_commit_log(spark, str(folder), via=via)
    got = rows(commits, "repo_id", "seq", "commit_id", "author", "body", "is_merge", F.col("committed_at").cast("string"), "_corrupt")
    assert by_position(got) == [
        ("alpha", 0, "abc1234567", "Ann", "body text", False, "2024-01-01 10:00:00", None),
        ("alpha", 1, "def", "", "", True, "2024-01-01 10:00:00", None),
    ]
    assert rows(changes, "commit_id", "path", "insertions", "deletions", "is_binary") == [
        ("abc1234567", "img/x.png", 0, 0, True),
        ("abc1234567", "src/a.ts", 10, 2, False),
        ("def", "src/new/b.ts", 1, 0, False),
    ]


@WAYS
def test_corrupt_records_come_out_as_rows(spark, tmp_path, rows, via):
    folder = tmp_path / "logs"
    folder.mkdir()
    good = header("abc") + "\n\n1\t0\ta.ts\n"
    undated = [SEP.join(["def", "a", "e", date, "s", "b", "p"]) + exports.COMMIT_MARK for date in ("some day", "2024-13-45 10:00:00 +0000")]
    (folder / "alpha.log").write_text(good + "bad" + SEP + "record" + exports.COMMIT_MARK + "".join(undated) + "cut" + SEP + "off")
    got = rows(exports.corrupt_log_records(spark, str(folder), via), "repo_id", "seq", "reason", "record")
    assert [(r[2], r[3][:3]) for r in by_position(got)] == [("fields", "bad"), ("date", "def"), ("date", "def"), ("fields", "cut")]
    commits, _ = exports.read_commit_log(spark, str(folder), via)
    assert rows(commits, "commit_id", F.col("committed_at").isNull(), F.col("_corrupt").isNull()) == [("abc", False, True), ("def", True, False), ("def", True, False)]


@pytest.mark.parametrize("size", [1, 7, 61, 700, 10**6])
def test_commit_log_split_over_tasks(spark, tmp_path, rows, size):
    """A log cut into many splits, within marks and lines too, gives the same rows as one read whole."""
    folder = tmp_path / "logs"
    logs = {"big": log_text(120 if size > 60 else 4), "a%3Ab": "\n" + log_text(3) + "\n", "empty": "", "none": "no record at all"}
    for name, text in logs.items():
        (folder / f"repo_id={name}").mkdir(parents=True)
        (folder / f"repo_id={name}" / "part-0.txt").write_text(text)
    whole = [rows(df.drop("seq")) for df in exports.read_commit_log(spark, str(folder), "text")]
    commits, changes = exports.read_commit_log(spark, str(folder), split_bytes=size)
    assert [rows(commits.drop("seq")), rows(changes.drop("seq"))] == whole
    assert {r[0] for r in whole[0]} == {"big", "a:b"} and len(whole[1]) == 3 * len(whole[0])
    big = sorted((r["seq"], r["commit_id"]) for r in commits.filter("repo_id = 'big'").collect())
    assert [c for _, c in big] == [f"sha{k:04d}" for k in range(len(big))]


def test_commit_log_condition_opens_only_its_files(spark, tmp_path, rows):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.log").write_text(log_text(2))
    (tmp_path / "d.log").symlink_to(tmp_path / "gone")  # opening it would fail
    found = exports.commit_log(spark, str(tmp_path), "repo_id STRING, commit_id STRING")
    assert rows(found.filter("repo_id = 'b'")) == [("b", "sha0000"), ("b", "sha0001")]
    assert rows(found.filter("repo_id IN ('a', 'c') AND commit_id = 'sha0001'")) == [("a", "sha0001"), ("c", "sha0001")]


def test_commit_log_packed(spark, tmp_path, rows):
    import gzip

    (tmp_path / "a.log.gz").write_bytes(gzip.compress(log_text(5).encode()))
    commits, changes = exports.read_commit_log(spark, str(tmp_path), split_bytes=100)
    assert commits.count() == 5 and changes.count() == 15


def test_commit_log_stream(spark, tmp_path, rows):
    """New files arrive between runs; each record comes out once."""
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    for name in ("a", "b"):
        (logs / f"{name}.log").write_text(log_text(3))
        stream = register(spark).readStream.format("commit_log").schema("repo_id STRING, commit_id STRING").option("splitBytes", 150).load(str(logs))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt"))
        query.trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out)) == [(n, f"sha{k:04d}") for n in "ab" for k in range(3)]


def test_offset_dates_are_utc(spark, tmp_path):
    (tmp_path / "r.log").write_text(header("s", date="2024-01-01 10:00:00 +0200") + "\n\n")
    commits, _ = exports.read_commit_log(spark, str(tmp_path / "r.log"))
    assert str(commits.first()["committed_at"]) == "2024-01-01 08:00:00"


def test_file_list_and_contents(spark, tmp_path, rows):
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "a+b.txt").write_text("src/x.ts\n\nREADME.md\n")
    assert rows(exports.read_file_list(spark, str(tmp_path / "lists"))) == [("a+b", "README.md"), ("a+b", "src/x.ts")]
    root = tmp_path / "texts"
    (root / "r1" / "src").mkdir(parents=True)
    (root / "r1" / "src" / "a.ts").write_text("one\ntwo\nthree")
    (root / "r1" / "b.md").write_text("# B")
    (root / "r1" / "bin.ts").write_bytes(b"\xff\xfe\x00")
    got = rows(exports.read_contents(spark, str(root)))
    assert ("r1", "src/a.ts", "one\ntwo\nthree") in got and ("r1", "b.md", "# B") in got and len(got) == 2
    assert rows(exports.read_contents(spark, str(root), glob="*.ts", head_lines=2)) == [("r1", "src/a.ts", "one\ntwo")]
    # files that Spark's own readers take for hidden, and folders that a condition leaves unopened
    (root / "r2" / ".github").mkdir(parents=True)
    (root / "r2" / ".github" / "_ci.yml").write_text("on: push")
    assert rows(exports.read_contents(spark, str(root)).filter("repo_id = 'r2'")) == [("r2", ".github/_ci.yml", "on: push")]
    (root / "stray.txt").write_text("of no repository")
    assert exports.read_contents(spark, str(root)).count() == 3
    # a root whose last folder has the name of one above it, with characters that patterns know
    odd = tmp_path / "re+pos" / "x" / "re+pos"
    (odd / "r9" / "src").mkdir(parents=True)
    (odd / "r9" / "src" / "a b.ts").write_text("x")
    assert rows(exports.read_contents(spark, f"{odd}/")) == [("r9", "src/a b.ts", "x")]


def test_pull_requests(spark, tmp_path, rows):
    pr = {
        "number": 42, "title": "feat: add auth", "body": "b", "author": {"login": "alice"}, "mergedAt": "2024-01-01T10:00:00Z",
        "baseRefName": "main", "additions": 100, "deletions": 5, "files": [{"path": "src/a.ts"}, {"path": "tests/auth.test.ts"}],
        "labels": [{"name": "Breaking-Change"}], "reviews": [{"author": {"login": "bob"}}, {"author": None}, {"author": {"login": "bob"}}],
        "comments": [{"body": "ok"}],
    }
    empty = {"number": 7, "title": None, "author": None, "files": None, "labels": None, "reviews": None, "comments": None}
    (tmp_path / "acme.json").write_text("\n".join(json.dumps(x) for x in (pr, pr, empty)))
    got = {r["number"]: r for r in exports.read_prs(spark, str(tmp_path)).collect()}
    assert len(got) == 2 and got[42]["repo_id"] == "acme"
    assert got[42]["has_tests"] and got[42]["reviewers"] == ["bob"] and got[42]["topics"] == ["breaking-change", "feature"]
    assert str(got[42]["merged_at"]) == "2024-01-01 10:00:00"
    assert got[7]["author"] == "" and got[7]["files"] == [] and got[7]["reviewers"] == [] and got[7]["merged_at"] is None
    summary = prs.pr_summary(exports.read_prs(spark, str(tmp_path)))
    assert rows(summary) == [("acme", "", 1, 0, 0, 0, 0), ("acme", "alice", 1, 2, 100, 5, 1)]


def test_state_and_asked_log(spark, tmp_path, rows):
    (tmp_path / "answers.json").write_text('{"repo_id":"r","project_description":"d"}\n{broken\n')
    state = exports.read_state(spark, str(tmp_path / "answers.json"), schemas.ANSWERS)
    assert rows(state, "repo_id", "project_description") == [("r", "d")]
    (tmp_path / "r.log").write_text("# comment\n\n2024-01-01 | Q1 | Why? | open\n")
    assert rows(exports.read_asked_log(spark, str(tmp_path / "r.log"))) == [("r", "2024-01-01", "Q1", "Why?", "open")]


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("r", "a", 1)], "repo_id STRING, path STRING, change_count BIGINT")
    for _ in range(2):
        sinks.write_snapshot({"freq": df}, str(tmp_path / "snap"), "run1")
    assert rows(sinks.read_snapshot(spark, str(tmp_path / "snap"), "freq", "run1")) == [("r", "a", 1)]
    summary = spark.createDataFrame([("r", 3, None)], "repo_id STRING, commits BIGINT, primary_language STRING").withColumn(
        "last_commit", F.lit("2024-01-01")
    )
    sinks.write_meta(summary, str(tmp_path / "meta"), "1.0", F.lit("2024-02-01"))
    assert sinks.read_meta(spark, str(tmp_path / "meta")).first()["primary_language"] == "Unknown"


def test_a_run_that_breaks_off_leaves_the_one_before(spark, tmp_path, rows):
    path = str(tmp_path / "tables")
    store = Versions(spark, path)
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id BIGINT, name STRING")
    with pytest.raises(ValueError):
        store.read("one")
    assert store.commit({"one": good, "two": good.filter("id = 1")}, run_id="x") == 1
    bad = good.withColumn("name", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.commit({"one": good.filter("id = 2"), "two": bad}, run_id="y")
    assert rows(store.read("one")) == [(1, "a"), (2, "b")] and rows(store.read("two")) == [(1, "a")]
    assert len(store.folder.names("data")) == 1
    # a manifest cut off in its writing is none, and its number is not used again
    store.folder.create("_manifests/v000000000002.json", '{"version": 2, "tab')
    assert store.latest()["version"] == 1
    assert store.commit({"one": good.filter("id = 2")}, run_id="x") == 3
    assert rows(store.read("one", run_id="x")) == [(2, "b")]
    # what no version holds goes, and versions but the last ones
    good.write.parquet(f"{path}/data/stray/one")
    store.vacuum(keep=1)
    assert len(store.folder.names("data")) == 1 and [m["version"] for m in store.manifests()] == [3]
    assert not store.folder.create("_manifests/v000000000003.json", "")


def test_compaction_is_exact(spark, tmp_path, rows):
    """Replays, compactions and reads in between: always the sum of all batches."""
    rng = random.Random(6)
    fold = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    table = DeltaTable(spark, str(tmp_path / "t"), "k STRING, n BIGINT", fold, every=3)
    total: Counter = Counter()
    assert rows(table.read()) == []
    for batch_id in range(11):
        delta = [(rng.choice("abc"), rng.randrange(9)) for _ in range(3)]
        for _ in range(rng.choice([1, 2])):  # a batch may come again
            table.write(spark.createDataFrame(delta, "k STRING, n BIGINT"), batch_id)
        for k, n in delta:
            total[k] += n
        assert rows(table.read()) == sorted(total.items(), key=repr)
        assert len(table.batches()) <= 7 and len(table.base.manifests()) <= 2
    assert table.base.latest()["through"] >= 7
