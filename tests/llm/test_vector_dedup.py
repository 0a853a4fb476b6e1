import numpy as np
import pytest

from repolith.llm import vector_dedup


def brute(rows, cosine):
    rows = list(dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows))
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                links[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()] - reach:
                reach.add(other)
                todo.append(other)
        least = None if i is None else min(rows[r][0] for r in reach)
        out.append((i, len(links[k]), least, i is None or least == i))
    return sorted(out, key=repr)


def make(kind, seed=0):
    rng = np.random.default_rng(seed)
    bases = rng.normal(size=(25, 24))
    rows = []
    for i in range(300):
        v = bases[rng.integers(0, 25)] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.4, 3.0])
        rows.append((i * 3 % 301, (v * rng.choice([0.01, 1, 50])).astype(kind).astype(float).tolist()))
    rows += [(1000 + i, rows[7][1]) for i in range(20)] + [rows[3], rows[3], (rows[4][0], rows[9][1])]
    rows += [(2000 + i, [1.0, 2.0 + i / 10, 0.5]) for i in range(10)] + [(2100, [4.0]), (2101, [9.0]), (2102, [-1.0])]
    rows += [(3000, None), (3001, [0.0] * 24), (3002, [float("inf")] * 24), (3003, [float("nan"), *[1.0] * 23]), (3004, []), (3005, [None, 1.0]), (None, rows[7][1])]
    return rows


@pytest.mark.parametrize("kind, cells", [("float32", 1 << 14), ("float64", 40), ("float32", 70)])
def test_against_brute_force(llm, rows, kind, cells):
    data = make(kind)
    element = "float" if kind == "float32" else "double"
    table = llm.createDataFrame([(i, v, 1, "x") for i, v in data], f"vec_id long, embedding array<{element}>, node long, component string").repartition(3)
    got = rows(vector_dedup.near_copies(table, 0.9, cell_points=cells))
    assert got == sorted(brute(data, 0.9), key=repr)


def test_empty_and_single(llm, rows):
    one = llm.createDataFrame([(4, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert rows(vector_dedup.near_copies(one.filter("false"))) == []
    assert rows(vector_dedup.near_copies(one)) == [(4, 0, 4, True)]


def test_ranges_reach_every_pair_within_them():
    rng = np.random.default_rng(1)
    points, pivots = rng.normal(size=(400, 5)), rng.normal(size=(12, 5))
    point, cell, own = vector_dedup.cells(points, pivots, 0.8)
    homes = dict(zip(point[own].tolist(), cell[own].tolist()))
    visits = set(zip(point.tolist(), cell.tolist()))
    near = vector_dedup.squares(points, points) <= 0.64
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        assert (i, homes[j]) in visits if homes[j] <= homes[i] else (j, homes[i]) in visits
    assert len(point) < 0.8 * 400 * 13 / 2


def test_some_block_admits_every_link():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64))
    y = x + rng.normal(size=x.shape) * rng.uniform(0.05, 0.45, (500, 1))
    space = vector_dedup.Subspaces(64, 0.9)
    a, b = space.place(x), space.place(y)
    linked = (a * b).sum(1) >= 0.9
    assert linked.any() and (space.first_block(a, b)[linked] >= 0).all()
