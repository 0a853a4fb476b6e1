import numpy as np
import pytest
from pyspark.sql import functions as F

from repolith.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def table(llm, rows):
    return llm.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def brute(vectors, k):
    out = {}
    for q in vectors:
        if q % 20 == 0:
            near = sorted((-float((vectors[q] * v).sum()), c) for c, v in vectors.items() if c != q and len(v) == len(vectors[q]))[:k]
            out[q] = [(i + 1, c) for i, (_, c) in enumerate(near)]
    return out


def found(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    return {q: sorted(x) for q, x in out.items()}


def test_exact_when_all_cells_are_visited(llm):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)] + [(1000 + i, [1.0] * 8) for i in range(60)]
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2080, [None] + [1.0] * 7), (2100, [1.0] * 3), (2120, [])]
    rows += [(3000 + i, rng.normal(size=3).tolist()) for i in range(50)]
    vectors = {i: np.array(v, np.float64) for i, v in [*rows, (2100, [1.0] * 3)]}
    assert found(ann.search(table(llm, [*rows, *bad, rows[5]]), F.col("vec_id") % 20 == 0, 20, visit=1.0)) == brute(vectors, 20)


@pytest.mark.parametrize("sigma", [0.0, 0.3, 0.6])
def test_recall(llm, sigma):
    """Of vectors of equal and of very unequal lengths."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 32))
    x *= np.exp(sigma * rng.normal(size=(2000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    exact = brute({i: np.array(v) for i, v in rows}, 20)
    got = found(ann.search(table(llm, rows), F.col("vec_id") % 20 == 0, 20))
    hits = sum(len({c for _, c in got[q]} & {c for _, c in exact[q]}) for q in exact)
    assert hits >= 0.9 * sum(map(len, exact.values()))


def test_few(llm):
    assert ann.search(table(llm, [(0, [1.0, 2.0])]).filter("false"), F.lit(True), 3).count() == 0
    assert ann.search(table(llm, [(0, [1.0, 2.0])]), F.lit(True), 3).count() == 0
    assert found(ann.search(table(llm, [(0, [1.0]), (1, [2.0]), (2, [3.0])]), F.col("vec_id") == 0, 3)) == {0: [(1, 2), (2, 1)]}


def test_cells():
    order = ann.walk(np.array([0.0, 1.0, 5.0]), np.array([0.0, 2.0]), np.array([1, 1, 1, 0, 1, 1]), 4)
    assert order == [0, 2, 1, 4]
    assert ann.shards(np.array([3, 3, 9, 1, 4]), 5) == [(0, 1), (1, 1), (2, 2), (4, 1), (4, 1)]
