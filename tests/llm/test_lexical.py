import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from repolith.llm import lexical

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(split(text)), []
        for doc, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def table(llm, items):
    return llm.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score long")


@pytest.mark.parametrize("shard_docs, item_bytes", [(1 << 14, 1 << 24), (37, 400)])
def test_against_brute_force(llm, frame, rows, shard_docs, item_bytes):
    rng = random.Random(shard_docs)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "0ÉxYz"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", "-", "\n", "@ "]).join(rng.choices(words, weights, k=n))
    texts = [text(rng.choice([1, 3, 10, 40, 200])) for _ in range(300)]
    texts += [None, "", "...", texts[0], texts[0], "a0 " * 3000]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(40, None), (41, "nowhere"), (42, ""), (43, "a0 a0 A0"), (None, "b0 cx"), (3, text(4))]
    docs = frame(texts, terms=[1] * len(texts), shard=[1] * len(texts), place=[2] * len(texts))
    got = lexical.rank_documents(docs, table(llm, [*items, items[2]]), 10, shard_docs=shard_docs, item_bytes=item_bytes)
    assert rows(got) == sorted(brute(list(enumerate(texts)), items, 10), key=repr)


def test_documents_without_an_id_come_last(llm, rows):
    docs = llm.createDataFrame([(None, "x y"), (5, "x y"), (2, "x y"), (7, "z")], "doc_id long, text string")
    got = rows(lexical.rank_documents(docs, table(llm, [(1, "x")])), "rank", "doc_id")
    assert got == [(1, 2), (2, 5), (3, None)]


def test_empty_tables(llm, frame):
    assert lexical.rank_documents(frame([]), table(llm, [(1, "a")])).count() == 0
    assert lexical.rank_documents(frame(["a", None]), table(llm, [])).count() == 0
    assert lexical.rank_documents(frame([None, "..."]), table(llm, [(1, "a")])).count() == 0


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(2)
    docs, width = 4000, 60
    # documents of twenty subjects, each with terms of its own
    subject = rng.integers(0, 20, docs)
    rows = [np.unique(np.concatenate([rng.integers(1, 3, 2), 2 + 2 * s + rng.integers(1, 3, 2), rng.integers(43, width, 1)])) for s in subject]
    sizes = np.array([len(r) for r in rows])
    term = np.concatenate(rows)
    share = rng.integers(1, 100, len(term)) * np.where(term < 3, 1, 20)
    index = lexical.ShardIndex(sizes, term, share, width)
    dense = np.zeros((docs, width), np.int64)
    dense[np.repeat(np.arange(docs), sizes), term] = share
    scored = 0
    for s in range(20):
        wanted = {1: 1, 3 + 2 * s: 2, 4 + 2 * s: 1, 50: 1}
        total = sum(n * dense[:, t] for t, n in wanted.items())
        best = np.lexsort((np.arange(docs), -total))[:10]
        found, scores, looked = index.search(wanted, np.arange(docs), 10)
        assert found.tolist() == best.tolist() and scores.tolist() == total[best].tolist()
        scored += looked
    assert scored < 20 * docs / 8


def test_summaries_are_the_largest_of_their_blocks():
    term, share = np.array([1, 2, 1, 1, 2]), np.array([5, 7, 9, 2, 3])
    index = lexical.ShardIndex(np.array([2, 1, 2]), term, share, 3)
    members, starts, _ = index.block(1)
    for t in (1, 2):
        dense = {(0, 1): 5, (0, 2): 7, (1, 1): 9, (2, 1): 2, (2, 2): 3}
        want = [max(dense.get((d, t), 0) for d in members[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:])]
        assert index.summary(1, t).tolist() == want
