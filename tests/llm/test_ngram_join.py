import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolith.llm import ngram_join
from repolith.llm.components import components


def shingles(text, n):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute(texts, percent, n):
    sets, root = [shingles(t, n) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " ", "a", "a b", "A b", "A\nB c d", "a b c", "é É"]
    for _ in range(25):
        own = [rng.choice(words) for _ in range(rng.choice([3, 5, 8, 12, 20, 40, 90, 250]))]
        for _ in range(rng.randint(1, 8)):
            text = list(own)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text[rng.randint(0, 1) :]))
    return out


@pytest.mark.parametrize("seed,percent,n,tile", [(1, 85, 4, 1 << 19), (2, 80, 5, 300)])
def test_components(frame, seed, percent, n, tile):
    rows = texts(seed)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(frame(rows), percent, n, tile).collect()}
    assert found == brute(rows, percent, n)


@pytest.mark.parametrize("part", [2, 5, 1000])
def test_sketches_of_shared_blocks_lose_no_link(frame, part):
    """Whatever the size of a cell, the links of a block join all that are alike; a phrase alone joins nothing."""
    rows = [t for t in texts(3) if t and len(t.split()) > 5]
    phrase = " one two three four five six"
    rows += [" ".join(f"{i}x{j}" for j in range(60)) + phrase for i in range(12)]
    docs = ngram_join.base.stage(ngram_join.sketched(frame(rows).selectExpr("doc_id", "doc_id as h", "text"), 80, 5), "t")
    nodes = docs.dropDuplicates(["node"])
    number = {r.doc_id: r.node for r in docs.collect()}
    joined = {r.node: r.component for r in components(ngram_join.admitted(nodes, 80, part)).collect()}
    want = brute(rows, 80, 5)
    for i, (_, root) in want.items():
        a, b = number[i], number[root]
        assert a == b or joined[a] == joined[b]
    assert not any(number[i] in joined for i in range(len(rows) - 12, len(rows)))


def test_large_sets_that_share_a_block_by_chance_are_no_family(frame):
    """Sketches of 2048 bits told no two sets of 5000 apart, so all of these were one family."""
    rng = random.Random(5)
    bases = [[f"{i}x{rng.randrange(10**9)}" for _ in range(size)] for i, size in enumerate((5000, 5100, 5200, 9000, 30000))]
    rows = [" ".join(b) for b in bases] + [" ".join([*b[:-40], *map(str, range(40))]) for b in bases]
    nodes = ngram_join.base.stage(ngram_join.sketched(frame(rows).selectExpr("doc_id", "doc_id as h", "text"), 80, 5), "t").withColumn("keys", F.array(F.lit(1)))
    number = {r.node: r.doc_id for r in nodes.collect()}
    for part in (1000, 3):
        joined = defaultdict(set)
        for r in components(ngram_join.admitted(nodes, 80, part)).collect():
            joined[r.component].add(number[r.node])
        assert sorted(map(sorted, joined.values())) == [[i, i + 5] for i in range(5)]


@pytest.mark.parametrize("few", [0, 100])
def test_texts_of_members(llm, frame, few):
    docs = frame(["a", "b", "c", "c"]).selectExpr("doc_id", "text", "doc_id * 2 as h")
    sized = llm.createDataFrame([(i, 9, d, 2 * d, 5) for i, d in enumerate((1, 3))], "node long, component long, doc_id long, h long, n_shingles long")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = llm.conf.get(threshold)
    llm.conf.set(threshold, -1)
    try:
        found = ngram_join.member_texts(docs, sized, 5, few)
        assert sorted((r.node, r.parts, r.text) for r in found.collect()) == [(0, 2, "b"), (1, 2, "c")]
        # texts stay where they are unless the members are too many
        assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == (few > 0)
    finally:
        llm.conf.set(threshold, before)


def test_one_of_each(frame):
    rows = ["a b c d e f g", "A b c d e f g", "x y z", None, None, "", "q r s"]
    docs = frame(rows, source=["s"] * len(rows))
    docs = docs.union(docs.filter("doc_id = 6")).union(docs.filter("doc_id = 2").selectExpr("null", "text", "source", "h", "n", "size"))
    kept = ngram_join.one_of_each(docs, 80, 5)
    assert kept.columns == docs.columns
    # a null id is the smallest
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.filter("text <> ''").collect()) == [(False, 0, rows[0]), (False, 6, "q r s"), (True, 0, "x y z")]
    assert kept.filter("coalesce(text, '') = ''").count() == 3
    assert ngram_join.one_of_each(docs.filter("false"), 80, 5).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_blocks_never_lose_a_pair(percent):
    rule, rng = ngram_join.Similarity(percent), np.random.default_rng(percent)
    for _ in range(150):
        size = int(rng.integers(1, 400))
        both = rng.integers(0, 2**63, size, dtype=np.uint64)
        a, b = both.copy(), both.copy()
        while True:  # as different as the rule allows
            c, d = (a[1:], b) if rng.random() < 0.5 else (np.append(a, rng.integers(0, 2**63, 1, dtype=np.uint64)), b)
            if not len(c) or not rule.linked(np.unique(c), np.unique(d)):
                break
            a, b = d, c
        assert rule.linked(np.unique(a), np.unique(b))
        assert len(np.intersect1d(ngram_join.block_keys(np.unique(a), percent), ngram_join.block_keys(np.unique(b), percent)))


@pytest.mark.parametrize("percent", [80, 85])
def test_common_blocks_that_are_left_out_lose_no_pair(llm, percent):
    """Sets with phrases of many others and partners as different as the rule allows still share a key that neither leaves out."""
    rule, rng = ngram_join.Similarity(percent), np.random.default_rng(percent)
    draw = lambda n: rng.integers(0, 2**63, int(n), dtype=np.uint64)
    phrases, sets = [draw(12) for _ in range(6)], []
    for _ in range(200):
        own = np.concatenate([draw(rng.integers(1, 300)), *(p for p in phrases if rng.random() < 0.5)])
        a, b = rng.permutation(own), own
        while True:
            c, d = (a[1:], b) if rng.random() < 0.5 else (np.append(a, draw(1)), b)
            if not len(c) or not rule.linked(np.unique(c), np.unique(d)):
                break
            a, b = d, c
        sets += [np.unique(a), np.unique(b)]
    sent = [ngram_join.blocks_sent(s, percent) for s in sets]
    rows = [(i, k.view(np.int64).tolist(), left) for i, (k, left) in enumerate(sent)]
    found = defaultdict(set)
    for r in ngram_join.shared_keys(llm.createDataFrame(rows, "node long, keys array<long>, left array<int>")).collect():
        found[r.node].add(r.key)
    assert all(found[i] & found[i + 1] for i in range(0, len(sets), 2))
    # more than half of what sets share with others than their partner is left out
    strangers = lambda keys: sum(len(keys[i] & keys[j]) for i in range(len(sets)) for j in range(i) if i // 2 != j // 2)
    assert 2 * strangers(found) < strangers({i: set(k) for i, k, _ in rows})


def test_a_phrase_in_all_texts_makes_no_group(frame, monkeypatch):
    """Groups of all texts with a phrase cost the square of their number."""
    phrase, met, stage = " ".join(f"p{i}" for i in range(16)), [], ngram_join.base.stage
    monkeypatch.setattr(ngram_join.base, "stage", lambda df, name: met.append((name, df.count())) or stage(df, name))
    rows = [" ".join([f"{i}x{j}" for j in range(150 + i % 50)] + [phrase]) for i in range(300)]
    found = ngram_join.similar_documents(frame(rows), 80, 5).collect()
    assert {r.component_id for r in found} == set(range(300))
    assert sum(n for name, n in met if name == "shared") < 30


def test_stars(llm):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    near = defaultdict(set)
    for u, v in edges:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    want = {}
    for node in sorted(near):
        todo = [] if node in want else [node]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo += near[x]
    got = components(llm.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_keys_are_deleted_before_texts_meet(llm, frame, copies):
    """Keys of blocks, which take more room than the texts, stayed in the shared folder while texts were dealt."""
    import os

    folder = ngram_join.base.shared_folder(llm).removeprefix("file:")
    before = set(os.listdir(folder))
    texts = copies(9, ["a", "b", "c", "d", "e"], [12, 30])
    assert ngram_join.similar_documents(frame(texts), 80, 3).count() == len(texts)
    new = {name.split("-")[1] for name in set(os.listdir(folder)) - before}
    assert "documents" in new and not new & {"nodes", "shared", "keys", "families"}
