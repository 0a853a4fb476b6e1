import random

import pytest

from repolith.llm import line_chunks

duckdb = pytest.importorskip("duckdb")


def test_chunks_against_sql(frame, tmp_path):
    from pyspark.sql import functions as F

    from repolith.llm import queries

    rng = random.Random(1)
    lines = [f"line {i}" for i in range(30)] + ["", "é"]
    runs = [[rng.choice(lines) for _ in range(rng.randint(2, 12))] for _ in range(12)]
    texts = ["\n".join(x for _ in range(rng.randint(0, 4)) for x in rng.choice(runs)) for _ in range(60)] + [None, "", "\n", "\n\n\n", "a", "long\n" * 3000]
    docs = frame(texts)
    found = line_chunks.remove_repeated_chunks(docs)
    rows = found.collect()
    assert sum(r.n_removed for r in rows) > 0
    for r in rows:
        assert r.text == texts[r.doc_id] and (r.kept is None) == (r.text is None)
        assert len((r.kept or "").split("\n")) <= max(1, r.n_lines)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = found.select("doc_id", "n_lines", "n_removed", "chunks_removed", F.sha2(F.coalesce("kept", F.lit("")), 256))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLES["op9_line_chunks"]).fetchall())


def test_repeats_nulls_and_nothing(frame):
    text = "\n".join(f"l{i}" for i in range(30))
    docs = frame([text, text, None])
    docs = docs.union(docs.filter("doc_id = 1")).union(docs.filter("doc_id = 1").selectExpr("cast(null as long)", "text", "h", "n", "size"))
    # the null id comes first and stays whole; the two rows of id 1 are one place
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed > 0) for r in line_chunks.remove_repeated_chunks(docs).collect()) == [(False, 0, True), (False, 1, True), (False, 1, True), (False, 2, False), (True, 0, False)]
    assert line_chunks.remove_repeated_chunks(docs.filter("false")).count() == 0


def test_plan_is_native(frame):
    plan = line_chunks.remove_repeated_chunks(frame(["a\nb"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
