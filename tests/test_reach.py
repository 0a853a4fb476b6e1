"""Reachability against breadth-first search: cycles, rings, long chains, limits."""

import random
from collections import defaultdict, deque

import pytest

from repolith.operators import imports, reach


def brute(start, steps, hops=None):
    after = defaultdict(set)
    for r, a, b in steps:
        if a is not None and b is not None:
            after[r, a].add(b)
    out = []
    for r, origin in set(start):
        seen, todo = {origin: 0}, deque([origin])
        while todo:
            node = todo.popleft()
            for b in after[r, node] - seen.keys():
                seen[b] = seen[node] + 1
                todo.append(b)
        out += [(r, origin, b, h) for b, h in seen.items() if b != origin and (hops is None or h <= hops)]
    return sorted(out, key=repr)


def run(spark, rows, start, steps, **limits):
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    found = reach.reachable(frame(start, "repo_id STRING, origin STRING"), frame(steps, "repo_id STRING, a STRING, b STRING"), **limits)
    return rows(found, "repo_id", "origin", "node", "hop")


def tangle(seed, n, m):
    """Random steps with chains that hang on them, rings and self steps."""
    rng = random.Random(seed)
    steps = [("r", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
    for c in range(4):
        ends = [f"n{rng.randrange(n)}", *(f"c{c}-{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12))), f"n{rng.randrange(n)}"]
        steps += [("r", a, b) for a, b in zip(ends, ends[1:])]
    ring = [f"ring{i}" for i in range(7)]
    steps += [("r", a, b) for a, b in zip(ring, ring[1:] + ring[:1])] + [("r", "n0", "n0"), ("s", "n0", "n1"), ("s", None, "n1"), ("s", "n1", None)]
    start = [("r", "n0"), ("r", "n1"), ("r", "ring3"), ("r", "ring5"), ("s", "n0"), ("r", "nowhere"), ("r", None), ("r", "n0")]
    return [(r, o) for r, o in start], steps


@pytest.mark.parametrize("seed, plain", [(1, 24), (1, 0), (2, 1), (3, 0), (4, 2)])
def test_against_breadth_first_search(spark, rows, seed, plain):
    start, steps = tangle(seed, 14, 20)
    known = [s for s in start if s[1] is not None]
    assert run(spark, rows, start, steps, plain_steps=plain) == brute(known, steps)


@pytest.mark.parametrize("hops, plain", [(1, 24), (3, 24), (5, 1)])
def test_limit(spark, rows, hops, plain):
    start, steps = tangle(5, 14, 20)
    known = [s for s in start if s[1] is not None]
    assert run(spark, rows, start, steps, hops=hops, plain_steps=plain) == brute(known, steps, hops)


def test_a_chain_of_1000_steps_that_ends_in_a_ring(spark, rows):
    names = [f"f{i:04d}" for i in range(1001)]
    ring = [f"z{i:03d}" for i in range(300)]
    steps = [("r", a, b) for a, b in zip(names, names[1:])] + [("r", names[-1], ring[0])]
    steps += [("r", a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
    start = [("r", "f0000"), ("r", "f0700"), ("r", "z250")]
    assert run(spark, rows, start, steps, plain_steps=3) == brute(start, steps)


def test_rings_alone_and_nothing(spark, rows):
    ring = [f"k{i:02d}" for i in range(40)]
    steps = [("r", a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
    assert run(spark, rows, [("r", "k07")], steps, plain_steps=0) == brute([("r", "k07")], steps)
    assert run(spark, rows, [], steps) == [] and run(spark, rows, [("r", "x")], []) == []


def test_blast_radius_goes_to_the_end(spark, rows):
    edges = spark.createDataFrame([("r", "a", "b", 1), ("r", "b", "c", 1), ("r", "c", "a", 2), ("r", "d", "a", 1)], "repo_id STRING, src STRING, dst STRING, mult BIGINT")
    changed = spark.createDataFrame([("r", 1, "b")], "repo_id STRING, change_id INT, path STRING")
    assert rows(imports.blast_radius(changed, edges), "importer", "hop") == [("a", 1), ("c", 2), ("d", 2)]


def test_a_round_has_the_same_joins_however_many_came_before(spark, monkeypatch):
    joins = []
    write = reach._Rounds.write

    def watched(self, df, name):
        if name.startswith("found"):
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(self, df, name)

    monkeypatch.setattr(reach._Rounds, "write", watched)
    steps = spark.createDataFrame([("r", f"{i:02d}", f"{i + 1:02d}") for i in range(12)], "repo_id STRING, a STRING, b STRING")
    start = spark.createDataFrame([("r", "00")], "repo_id STRING, origin STRING")
    reach.reachable(start, steps)
    assert len(joins) == 14 and set(joins[1:]) == {2}
