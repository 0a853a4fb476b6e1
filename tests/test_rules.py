"""Rule tables of any size: literals looked up by trigrams."""

import random
import re

from pyspark.sql import functions as F

from repolith.functions import fixed_values as fv
from repolith.operators import deps, questions, rules


def test_hits_are_those_of_containment(spark, rows):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    texts = [(i, word(rng.choice([0, 1, 2, 5, 40]))) for i in range(80)] + [(90, None), (91, "aaaaaa")]
    literals = [(i, word(rng.choice([1, 2, 3, 4, 6]))) for i in range(60)] + [(70, None), (71, ""), (72, "aaa"), (73, "aaa")]
    got = rules.literal_hits(
        spark.createDataFrame(texts, "t BIGINT, text STRING"), spark.createDataFrame(literals, "rule BIGINT, literal STRING")
    )
    want = [(t, r) for t, text in texts for r, x in literals if text and x and x in text]
    assert rows(got, "t", "rule") == sorted(want, key=repr)


def test_no_rules_and_no_texts(spark):
    texts, table = spark.createDataFrame([("abc",)], "text STRING"), spark.createDataFrame([("b",)], "literal STRING")
    assert rules.literal_hits(texts, table.filter("false")).count() == 0
    assert rules.literal_hits(texts.filter("false"), table).count() == 0
    assert rules.literal_hits(texts, table).columns == ["text", "literal"]


def test_a_hundred_thousand_rules(spark, rows):
    """No expression per rule, no nested loops, and the work follows the hits."""
    rng = random.Random(2)
    names = sorted({f"lib-{rng.randrange(10**7):07d}" for _ in range(100_000)})
    table = spark.createDataFrame([(i, "framework", n, [], [n], 1) for i, n in enumerate(names)], "sig INT, kind STRING, name STRING, paths ARRAY<STRING>, deps ARRAY<STRING>, min_score INT")
    held = rng.sample(names, 200)
    known = spark.createDataFrame([("r", f"@scope/{n}-core") for n in held], "repo_id STRING, dep STRING")
    files = spark.createDataFrame([], "repo_id STRING, path STRING")
    found = deps.detect_signatures(known, files, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(found, "name") == sorted((n,) for n in held)


def test_a_table_of_the_built_in_signatures_finds_the_same(spark, rows):
    signatures = [(n, kind, name, list(paths), list(names), least) for n, (kind, name, paths, names, least) in enumerate(fv.SIGNATURES)]
    table = spark.createDataFrame(signatures, "sig INT, kind STRING, name STRING, paths ARRAY<STRING>, deps ARRAY<STRING>, min_score INT")
    known = [("r", d) for _, _, _, names, _ in fv.SIGNATURES for d in names] + [("s", "react-dom-extra"), ("s", "x-express-y")]
    deps_df = spark.createDataFrame(known, "repo_id STRING, dep STRING")
    files = spark.createDataFrame([("r", p) for _, _, paths, _, _ in fv.SIGNATURES for p in paths], "repo_id STRING, path STRING")
    assert rows(deps.detect_signatures(deps_df, files, table)) == rows(deps.detect_signatures(deps_df, files))


def test_scan_of_lines(spark, rows):
    lines = spark.createDataFrame([("r", "a.py", "Python", 1, "eval(x)"), ("r", "a.ts", "TypeScript", 4, "eval(x); exec(y)"), ("r", "b", None, 2, "exec(")], "repo_id STRING, path STRING, language STRING, line_no BIGINT, line STRING")
    table = spark.createDataFrame([(1, "*", "run", "exec("), (2, "Python", "run", "eval(")], "rule BIGINT, rule_language STRING, category STRING, literal STRING")
    assert rows(rules.scan_literals(lines, table), "path", "line_no", "rule") == [("a.py", 1, 2), ("a.ts", 4, 1), ("b", 2, 1)]


def brute_similar(asked, percent):
    import re

    out = []
    for repo, i, q in asked:
        words = lambda t: set(re.findall(r"[^\W_]+", (t or "").lower()))
        near = [j for r, j, p in asked if r == repo and j < i and words(q) and 100 * len(words(q) & words(p)) >= percent * len(words(q) | words(p))]
        out.append((repo, i, min(near, default=None)))
    return out


def test_similar_questions(spark):
    """Nearly all earlier questions that say the same are found, and nothing else."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.choice([4, 9, 15]))] for _ in range(40)]
    asked = []
    for i in range(400):
        q = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            q[rng.randrange(len(q))] = rng.choice(words)
        asked.append((f"r{i % 2}", i, " ".join(q).upper() if i % 3 else ", ".join(q) + "?"))
    asked += [("r0", 900, None), ("r0", 901, "?!"), ("r0", 902, "?!")]
    got = {(r.repo_id, r.id): r.same_as for r in questions.similar_questions(spark.createDataFrame(asked, "repo_id STRING, id BIGINT, question STRING")).collect()}
    want = {(r, i): near for r, i, near in brute_similar(asked, 70)}
    assert got.keys() == want.keys()
    assert all(want[k] is not None for k, v in got.items() if v is not None)
    found = sum(got[k] is not None for k, v in want.items() if v is not None)
    assert found >= 0.98 * sum(v is not None for v in want.values()) > 100
    assert got["r0", 902] is None


def test_many_equal_questions_meet_once(spark):
    asked = spark.range(3000).select(F.lit("r").alias("repo_id"), "id", F.lit("Why is it so?").alias("question"))
    found = questions.similar_questions(asked).groupBy("same_as").count().collect()
    assert sorted((r["same_as"] is None, r["count"]) for r in found) == [(False, 2999), (True, 1)]


def test_texts_do_not_go_with_trigrams(spark, rows, monkeypatch):
    """A trigram is exchanged with the number of its text; rules of more trigrams than are broadcast hit the same."""
    texts = spark.createDataFrame([("a", "one two three two"), ("b", "three"), ("c", None), ("d", "one two three two")], "path STRING, text STRING")
    table = spark.createDataFrame([("two",), ("three",), ("e",), ("nine",)], "literal STRING")
    found = rules.literal_hits(texts, table)
    exploded = re.findall(r"Generate explode\(.*\), \[([^\]]*)\], false", found._jdf.queryExecution().executedPlan().toString())
    assert exploded and all(re.fullmatch(r"_text#\d+L?", columns) for columns in exploded)
    expected = rows(found)
    monkeypatch.setattr(rules, "MAX_GRAMS", 0)
    assert rows(rules.literal_hits(texts, table)) == expected and len(expected) == 8
