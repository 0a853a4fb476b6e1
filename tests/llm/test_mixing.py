import re

import pytest

from repolith.llm import mixing


def budgets(sizes, weights=(1, 2, 3), rounds=3):
    """Share by weight; what is above ``rounds`` times the size is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = {s for s in names if sizes[s] == 0}
    while True:
        left = sum(sizes.values()) - sum(rounds * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: rounds * sizes[s] if s in capped else weight[s] * left / total for s in names}
        above = {s for s in names if target[s] > rounds * sizes[s]}
        if not above:
            return target
        capped |= above


TEXTS = ["a b c", None, "", "x " * 50, "y z w", *[f"w{i} " * (i % 9) for i in range(120)]]
SOURCES = ["big" if i % 3 == 0 else None if i % 10 == 1 else "é" if i % 10 == 2 else f"s{i % 4}" for i in range(len(TEXTS))]
SOURCES[3] = "tiny"


def test_plan(frame, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    docs = frame(TEXTS, source=SOURCES)
    docs = docs.union(docs.filter("doc_id in (5, 6)"))
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.doc_id] or ""))
        sizes[SOURCES[r.doc_id]] = sizes.get(SOURCES[r.doc_id], 0) + r.size
    target = budgets(sizes)
    for source, size in sizes.items():
        own = [r for r in rows if SOURCES[r.doc_id] == source]
        assert {r.source_size for r in own} == {size}
        assert all(r.target == pytest.approx(target[source]) and 0 <= r.taken <= 3 * r.size for r in own)
        assert sum(r.taken for r in own) == int(own[0].target + 1e-9)
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def test_rows_of_the_mix(frame):
    docs = frame(TEXTS, source=SOURCES, n_chars=[len(t or "") for t in TEXTS])
    plan = mixing.mix_plan(docs)
    taken = {r.doc_id: r.taken for r in plan.collect()}
    mixed = mixing.take(docs, plan)
    assert mixed.columns == docs.columns
    words: dict = {}
    for r in mixed.collect():
        assert TEXTS[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {d: n for d, n in taken.items() if n}


def test_nothing(frame):
    assert mixing.mix_plan(frame(["a"], source=["s"]).filter("false")).count() == 0
    assert [r.taken for r in mixing.mix_plan(frame([None, ""], source=["s", None])).collect()] == [0, 0]
