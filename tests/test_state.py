import datetime as dt
import random

from pyspark.sql import functions as F

from repolith import schemas
from repolith.operators import incremental, knowledge, questions, score
from repolith.sources import sinks
from repolith.streaming import increments
from repolith.streaming.throttle import read_throttle, stream_throttle

REPOS = "repo_id STRING"


def facts_row(spark, **values):
    kinds = {bool: "boolean", int: "bigint", str: "string"}
    frame = spark.range(1).select(F.lit("r").alias("repo_id"), *[F.lit(v).cast(kinds[type(v)]).alias(k) for k, v in values.items()])
    return score.confidence_facts(spark.createDataFrame([("r",)], REPOS), frame)


def scores_of(facts):
    return {r["dimension"]: r["score"] for r in score.confidence_score(facts).collect()}


def test_score_of_nothing(spark):
    facts = facts_row(spark)
    assert scores_of(facts) == {
        "Project Identity": 1, "Build & Run": 0, "Architecture": 0, "Code Patterns": 0, "Domain Context": 0, "Testing": 1,
    }
    assert tuple(score.score_total(score.confidence_score(facts)).first()) == ("r", 2, "F")
    found = [(r["dimension"], r["impact"]) for r in score.gaps(facts).orderBy("pos").collect()]
    assert found == [
        ("Project Identity", "high"), ("Project Identity", "high"), ("Build & Run", "high"), ("Architecture", "high"),
        ("Domain Context", "high"), ("Architecture", "medium"), ("Architecture", "medium"), ("Code Patterns", "medium"), ("Testing", "low"),
    ]
    build = score.gaps(facts).filter("dimension = 'Build & Run'").first()
    assert build["question"] == "What are the commands to build, test, run/start this project?"
    assert build["context"] == "Only found 0 commands. Missing: build, test, run/start."


def test_score_caps(spark):
    facts = facts_row(
        spark, description="d", root_package="src/", primary_language="Go", has_build=True, build_explicit=True, has_test=True,
        has_run=True, run_explicit=True, has_lint=True, style="monolith", n_entry_points=2, n_layers=1, n_api_patterns=1, n_services=3,
        n_patterns=9, n_types=500, n_rules=9, n_conventions=9, commit_style="free-form", branch_pattern="x", n_todos=1,
        n_test_frameworks=2, layout="mixed",
    )
    assert scores_of(facts) == {
        "Project Identity": 20, "Build & Run": 16, "Architecture": 20, "Code Patterns": 15, "Domain Context": 15, "Testing": 10,
    }
    assert score.gaps(facts).count() == 0


def test_command_facts(spark):
    rows = [("r", 1, "build", "mvn x", "pom.xml"), ("r", 20, "build", "npm run build", "package.json (tsc)"), ("r", 30, "lint", "make lint", "Makefile")]
    got = score.command_facts(spark.createDataFrame(rows, "repo_id STRING, pos BIGINT, name STRING, command STRING, source STRING")).first()
    assert got["has_build"] and not got["build_explicit"] and got["lint_explicit"] and not got["has_test"] and got["n_commands"] == 3


def test_uplift_and_open_gaps(spark):
    facts = facts_row(spark)
    answers = spark.createDataFrame(
        [("r", "what", ["make"], "notes", ["di"], ["rule"], "pytest", [("q", "a")] * 5)], schemas.ANSWERS
    )
    lifted = {r["dimension"]: r["score"] for r in score.uplift(score.confidence_score(facts), answers).collect()}
    assert lifted == {"Project Identity": 20, "Build & Run": 20, "Architecture": 10, "Code Patterns": 8, "Domain Context": 15, "Testing": 6}
    assert score.open_gaps(score.gaps(facts), answers).count() == 0
    none = spark.createDataFrame([], schemas.ANSWERS)
    assert score.open_gaps(score.gaps(facts), none).count() == 9
    same = {r["dimension"]: r["score"] for r in score.uplift(score.confidence_score(facts), none).collect()}
    assert same == scores_of(facts)


def test_doc_health(spark):
    files = spark.createDataFrame([("r", "a"), ("r", "b"), ("e", "zzz")], "repo_id STRING, path STRING")
    since = spark.createDataFrame([("r", 11, True)], "repo_id STRING, n_commits BIGINT, stale BOOLEAN")
    health = score.doc_health(files, since, ("a", "b", "c", "d"))
    got = {r["repo_id"]: tuple(r)[1:] for r in health.collect()}
    assert got == {"r": (38, "F", 2, 2, 11), "e": (0, "F", 4, 0, 0)}
    issues = {r["message"] for r in score.doc_issues(files, health, ("a", "b", "c", "d")).filter("repo_id = 'r'").collect()}
    assert issues == {"Missing file: c", "Missing file: d", "2 files may be stale (11 commits since last update)"}


def test_supersession(spark, rows):
    chain = [(f"A-{n}", f"A-{n + 1}") for n in range(200)] + [("A-200", None), ("C-1", "C-2"), ("C-2", "C-1"), ("X", "gone")]
    df = spark.createDataFrame([("r", i, "s", "1", None, n) for i, n in chain], schemas.DECISIONS)
    got = {r["id"]: (r["active_id"], r["hops"]) for r in knowledge.active_decision(df).collect()}
    assert got["A-0"] == ("A-200", 200) and got["A-200"] == ("A-200", 0)
    assert got["C-1"] == (None, None) and got["X"] == ("X", 0) and len(got) == len(chain)


def test_decision_documents(spark, rows):
    text = '---\nid: ARCH-001\ntitle: "Use it"\nstatus: active\nsession: s1\nsupersedes: null\ntags: [db, infra]\nrelated: [ARCH-000]\n---\n\n## Context\n'
    docs = spark.createDataFrame([("r", "d/1.md", text), ("r", "d/2.md", "no front")], schemas.CONTENTS)
    got = knowledge.read_decisions(docs).first()
    assert (got["id"], got["title"], got["supersedes"], got["tags"], got["related"]) == ("ARCH-001", "Use it", None, ["db", "infra"], ["ARCH-000"])
    assert rows(knowledge.decision_index(knowledge.read_decisions(docs))) == [("r", "ARCH", "active", 1)]


def test_new_questions(spark, rows):
    ask = spark.createDataFrame([("r", "Why  so?"), ("r", "How?")], "repo_id STRING, question STRING")
    asked = spark.createDataFrame([("r", "d", "1", "why so", "open")], schemas.ASKED)
    assert rows(questions.new_questions(ask, asked), "question") == [("How?",)]
    titles = spark.createDataFrame([("r", "HOW")], "repo_id STRING, title STRING")
    assert questions.new_questions(ask, asked, titles).count() == 0


def brute_throttle(events, wait):
    taken, ready = [], {}
    for key, second, event in sorted(events):
        if second >= ready.get(key, second):
            taken.append((key, second, event))
            ready[key] = second + wait
    return sorted(taken)


def test_throttle_ways_agree(spark, rows):
    rng = random.Random(5)
    start = 1_704_067_200
    events = [(k, start + rng.randrange(5 * 86_400), n) for n in range(4_000) for k in ["ab"[rng.random() < 0.2]]]
    events += [("tick", start + 37 * n, 10_000 + n) for n in range(6_000)]
    stamped = [(k, dt.datetime.fromtimestamp(s, dt.UTC).replace(tzinfo=None), n) for k, s, n in events]
    df = spark.createDataFrame(stamped, "k STRING, ts TIMESTAMP_NTZ, n BIGINT")
    want = brute_throttle(events, 300)
    for sparse in (0, 2_000, 10**6):
        got = incremental.throttle(df, "k", "ts", "n", sparse=sparse)
        assert rows(got.select("k", F.unix_seconds(F.col("ts").cast("timestamp")), "n")) == sorted(want, key=repr), sparse


def test_ttl(spark, rows):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    cache = spark.createDataFrame([("a", "old", at(-1)), ("b", "live", at(5)), ("c", "x", at(3)), ("c", "y", at(4))], "key STRING, payload STRING, expires_at TIMESTAMP_NTZ")
    new = spark.createDataFrame([("b", "fresh")], "key STRING, payload STRING")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert rows(incremental.ttl_upsert(cache, new, now)) == [("b", "fresh", at(24)), ("c", "y", at(4))]


def test_document_upsert(spark, rows):
    s, e = incremental.AUTO_START, incremental.AUTO_END
    old = spark.createDataFrame([("r", "m", f"top\n{s}1{e}\nend {e}"), ("r", "u", "mine"), ("r", "q", f"{s}2{e}")], "repo_id STRING, path STRING, content STRING")
    new = spark.createDataFrame([("r", p, f"intro {s}2{e} x") for p in "muqn"], "repo_id STRING, path STRING, content STRING")
    got = {r["path"]: (r["content"], r["action"], r["reason"]) for r in incremental.upsert_documents(old, new).collect()}
    assert got == {
        "m": (f"top\n{s}2{e}\nend {e}", "updated", None), "u": ("mine", "skipped", "Manual content preserved"),
        "q": (f"{s}2{e}", "skipped", "Content unchanged"), "n": (f"intro {s}2{e} x", "created", None),
    }
    forced = {r["path"]: r["action"] for r in incremental.upsert_documents(old, new, force=True).collect()}
    assert forced == {"m": "updated", "u": "updated", "q": "updated", "n": "created"}


COMMITS = "repo_id STRING, commit_id STRING, committed_at TIMESTAMP_NTZ, files ARRAY<STRING>"


def test_streams_equal_batch(spark, tmp_path, rows):
    """Three deliveries, one repeated and one with old commits, in several micro-batches."""
    rng = random.Random(3)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    log = [("r", f"{n:040x}", day(n), rng.sample("abcdef", rng.randrange(1, 5))) for n in range(60)]
    landing = str(tmp_path / "landing")
    marks = spark.createDataFrame([("r", None, day(40))], schemas.MARKS)
    for part in (log[40:], log[50:], log[:40]):
        spark.createDataFrame(part, COMMITS).coalesce(1).write.mode("append").parquet(landing)
        for name, start in (
            ("freq", increments.stream_frequency), ("pairs", increments.stream_pairs),
            ("alerts", increments.stream_alerts),
        ):
            stream = increments.read_commit_stream(spark, landing)
            start(stream, str(tmp_path / name), str(tmp_path / f"ckpt-{name}")).trigger(availableNow=True).start().awaitTermination()
    batch = spark.createDataFrame(log, COMMITS)
    assert rows(increments.read_frequency(spark, str(tmp_path / "freq"))) == rows(increments.frequency_delta(batch))
    pairs = increments.pair_delta(batch).filter("n >= 3")
    assert rows(increments.read_pairs(spark, str(tmp_path / "pairs"))) == rows(pairs)
    alerts = str(tmp_path / "alerts")
    assert rows(increments.read_alerts(spark, alerts, marks)) == rows(increments.stale_alerts(batch, marks)) == [("r", 19, 6)]
    # the mark moves on, and the alert clears
    moved = spark.createDataFrame([("r", None, day(58))], schemas.MARKS)
    assert rows(increments.read_alerts(spark, alerts, moved)) == rows(increments.stale_alerts(batch, moved)) == []


def test_pair_delta_of_wide_commits(spark, rows):
    rng = random.Random(4)
    log = [("r", str(n), None, rng.sample("abcdefghijkl", rng.randrange(1, 13)) + ["a"]) for n in range(20)]
    batch = spark.createDataFrame(log, COMMITS)
    assert rows(increments.pair_delta(batch, part=3)) == rows(increments.pair_delta(batch))


EVENTS = "k STRING, ts TIMESTAMP, n BIGINT"


def deliver(spark, tmp_path, parts, delay):
    """Each part is a file and a micro-batch; one far event at the end moves the watermark past all others."""
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        data = [(k, dt.datetime.fromtimestamp(s, dt.UTC), n) for s, k, n in part]
        spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(EVENTS).parquet(landing)
        query = stream_throttle(stream, "k", "ts", "n", out, str(tmp_path / "ckpt"), delay=delay)
        query.trigger(availableNow=True).start().awaitTermination()
    return out


def test_throttle_stream_is_the_batch_whatever_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(9)
    start = 1_704_067_200
    events = [(start + rng.randrange(20_000), k, n) for n, k in enumerate("aab" * 100)]
    events += [(s, k, 1000 - n) for s, k, n in rng.sample(events, 40)]  # the same second again
    rng.shuffle(events)
    out = deliver(spark, tmp_path, [events[:120], events[120:250], events[250:]], "1 day")
    out_of = lambda name: sorted((r["k"], r["second"], r["n"]) for r in read_throttle(spark, out, name).collect())
    assert out_of("accepted") == []  # the watermark is a day behind
    out = deliver(spark, tmp_path, [[(start + 300_000, "end", 0)]], "1 day")
    want = brute_throttle([(k, s, n) for s, k, n in events], 300)
    assert [e for e in out_of("accepted") if e[0] != "end"] == want
    assert out_of("late") == []


def test_throttle_stream_sets_late_events_aside(spark, tmp_path):
    start = 1_704_067_200
    at = lambda s: start + s
    parts = [
        [(at(10), "a", 1), (at(5), "b", 2), (at(700), "a", 3)],
        [(at(3000), "a", 4), (at(650), "a", 6), (at(20), "a", 7)],  # the watermark stands at 100: 7 is late
        [(at(2390), "a", 8), (at(2700), "b", 9)],  # at 2400: 8 is late
        [(at(20_000), "a", 10)],
        [(at(50_000), "end", 11)],
        [(at(50_001), "end", 12)],
    ]
    out = deliver(spark, tmp_path, parts, "10 minutes")
    got = sorted((r["k"], r["second"] - start, r["n"]) for r in read_throttle(spark, out).filter("k <> 'end'").collect())
    assert got == [("a", 10, 1), ("a", 650, 6), ("a", 3000, 4), ("a", 20_000, 10), ("b", 5, 2), ("b", 2700, 9)]
    assert sorted((r["second"] - start, r["n"]) for r in read_throttle(spark, out, "late").collect()) == [(20, 7), (2390, 8)]


def test_report(spark):
    facts = facts_row(spark)
    scores = score.confidence_score(facts)
    asked = spark.createDataFrame([("r", 1, "tribal", "Why?")], "repo_id STRING, pos BIGINT, category STRING, question STRING")
    report = sinks.to_report_json(scores, score.score_total(scores), score.gaps(facts), asked).first()["report"]
    assert '"total":2' in report and '"questions":[{"pos":1,"category":"tribal","question":"Why?"}]' in report


def test_texts_are_read_twice_for_all_facts(spark, tmp_path):
    """Once for the digest and once for the types, whatever asks for facts after that."""
    from repolith.plans import facts as fleet

    contents = spark.createDataFrame(
        [("r", "README.md", "# T\n\nA lead."), ("r", "a.py", "import os\nclass A:\n    pass  # TODO: x"), ("r", "package.json", '{"scripts":{"build":"tsc"}}')],
        "repo_id STRING, path STRING, text STRING",
    )
    reads = spark.sparkContext.accumulator(0)

    def read(text):
        reads.add(1)
        return text

    counted = contents.withColumn("text", F.udf(read, "string")("text"))
    commits = spark.createDataFrame([("r", "1", "Ann", "a@x.io", dt.datetime(2024, 1, 1), "feat: x", "", False)], schemas.COMMITS)
    changes = spark.createDataFrame([("r", "1", dt.datetime(2024, 1, 1), "a.py", 1, 0, False)], schemas.CHANGES)
    t = fleet.Tables(commits, changes, contents.select("repo_id", "path"), counted, contents.filter("false"))
    row = fleet.facts(t).first()
    assert (row["description"], row["n_todos"], row["n_types"], row["has_build"]) == ("A lead.", 1, 1, True)
    assert t.import_edges.count() == 0 and fleet.services(t).count() == 0
    assert reads.value <= 2 * 3
