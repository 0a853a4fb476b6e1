import math
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from repolith.llm import quality

RNG = random.Random(1)
WORDS = ["the", "and", "rain", "over", "house", "morning", "river", "été", "small"]
GOOD = [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(5, 40))) for _ in range(120)]


def brute(texts, order=5):
    """Interpolated modified Kneser-Ney by dictionaries."""
    counts = [None] * order + [Counter()]
    for t in texts:
        padded = "\n" * (order - 1) + t
        counts[order].update(padded[i : i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, left = {}, defaultdict(float), defaultdict(float)
    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        d = [min(i - 0.05, max(0.1, i - (i + 1) * y * of[i + 1] / of[i])) if of[i] and of[i + 1] else min(i - 0.05, 0.5) for i in (1, 2, 3)]
        for g, c in counts[n].items():
            discount[g] = d[min(c, 3) - 1]
            total[g[:-1]] += c
            left[g[:-1]] += discount[g]

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / 4096
        c = g[:-1]
        if not total[c]:
            return lower
        return (max(0, counts[len(g)][g] - discount.get(g, 0)) + left[c] * lower) / total[c]

    return lambda t: -sum(math.log(p(("\n" * (order - 1) + t)[i : i + order])) for i in range(len(t))) / len(t)


def test_entropy_equals_brute_force(llm, frame):
    model = quality.train(frame(GOOD).select("text"))
    want = brute(GOOD)
    tests = [*GOOD[:10], "unseen WORDS !!", "x", "日本", "the and\nrain"]
    rows = {r.doc_id: r._entropy for r in quality.scored(frame([*tests, None, ""]), model).collect()}
    for i, t in enumerate(tests):
        assert rows[i] == pytest.approx(want(t), rel=1e-4), t
    assert rows[len(tests)] is None and rows[len(tests) + 1] is None


def test_no_gram_is_left_out_beyond_the_broadcast_ones(llm, frame, monkeypatch):
    """N-grams and contexts in files give the scores of those that are broadcast."""
    monkeypatch.setattr(quality, "REST_ROWS", 50)
    tests = frame([*GOOD[:10], "unseen WORDS !!", "x", "日本", "the and\nrain", None, ""])
    found = lambda model: {r.doc_id: (r._entropy, r._spread) for r in quality.scored(tests, model, model).collect()}
    whole = found(quality.train(frame(GOOD).select("text")))
    for limit in (0, 40):
        model = quality.train(frame(GOOD).select("text"), limit)
        assert all(len(keys) <= limit for keys, *_ in (*model.grams, *model.contexts))
        assert len(model.grams[-1][2].paths) > 2
        got = found(model)
        assert got.keys() == whole.keys()
        for doc, (entropy, spread) in whole.items():
            assert got[doc] == (None, None) if entropy is None else got[doc] == pytest.approx((entropy, spread), rel=1e-6)


def test_held_out_accuracy(llm, frame):
    clean = [" ".join(RNG.choice(WORDS) for _ in range(30)) for _ in range(60)]
    junk = [" ".join(RNG.choice(WORDS).upper() + "!!" for _ in range(30)) for _ in range(30)]
    texts = [*GOOD, *clean, *junk, None, ""]
    docs = frame(texts, lang=[("a", "b", None)[i % 3] for i in range(len(texts))])
    labels = llm.createDataFrame([(i, 1, 0) for i in range(len(GOOD))] + [(200, 1, 1), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(rows) == len(texts)
    n = len(GOOD) + len(clean)
    assert sum(rows[i]._keep for i in range(len(GOOD), n)) >= 58
    assert not any(rows[i]._keep for i in range(n, n + 30))
    assert rows[n + 30]._keep and rows[n + 31]._keep and rows[n + 30]._entropy is None


def test_nothing_trusted(llm, frame):
    docs = frame(["a", None], lang=["x", None])
    labels = llm.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r._keep for r in quality.judge(docs, labels).collect()] == [True, True]
    assert quality.judge(docs.filter("false"), labels).count() == 0


def test_model_bound(llm, frame):
    counts = llm.createDataFrame([(i, 1 + i % 5) for i in range(100)], "gram long, c long")
    assert quality._commonest(counts, "c", 50).count() == 40
    assert quality._commonest(counts, "c", 100).count() == 100


def test_clean_short_texts_stay(llm, frame):
    rng = random.Random(6)
    weights = [60, 30, 20, 10, 5, 3, 2, 1, 1]
    prose = lambda n: " ".join(rng.choices(WORDS, weights, k=n))
    long, short = [prose(rng.randint(60, 120)) for _ in range(100)], [prose(2) for _ in range(40)]
    texts = [*long, *short, "QX!!QX!!QX!! " * 20]
    labels = llm.createDataFrame([(i, 1, 0) for i in range(len(long))], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r._keep for r in quality.judge(frame(texts, lang=["a"] * len(texts)), labels).collect()}
    n = len(long)
    assert sum(rows[i] for i in range(n, n + len(short))) >= 38
    assert not rows[n + len(short)]


def test_predictable_junk_and_single_bad_words_go(llm, frame):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    bad = lambda: prose(20) + " nitwit " + prose(20)
    good, toxic, clean = [prose(40) for _ in range(100)], [bad() for _ in range(30)], [prose(40) for _ in range(30)]
    texts = [*good, *toxic, *clean, *(bad() for _ in range(20)), *(" ".join([w] * 60) for w in WORDS)]
    labels = llm.createDataFrame([(i, 1, int(i >= 100)) for i in range(130)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r._keep for r in quality.judge(frame(texts, lang=["a"] * len(texts)), labels).collect()}
    assert sum(rows[i] for i in range(130, 160)) >= 28
    assert not any(rows[i] for i in range(160, len(texts)))


def test_texts_are_measured_together(llm):
    """Each text went by itself, with a look-up for each of its characters; now each n-gram of a batch is looked up once."""
    texts = [*GOOD[:30], None, "", "é", "zzz \ud7ff\U0001f600", GOOD[3], "\n\n", GOOD[4] * 30]
    scorers = [quality.Scorer(quality.train(llm.createDataFrame([(t,) for t in some], "text string"))) for some in (GOOD[:60], GOOD[60:70])]
    asked = []
    of = scorers[0].of
    scorers[0].of = lambda codes: asked.append(codes) or of(codes)
    together = quality.measures(texts, *scorers)
    assert len(asked) == 1 and len(np.unique(asked[0])) == len(asked[0])
    assert together == [quality.measures([t], *scorers)[0] for t in texts]
    for text, found in zip(texts, together, strict=True):
        if text:
            nats = -scorers[0].log_probabilities(quality.characters(text))
            assert found[:2] == (float(nats.mean()), float(nats.std()))
        else:
            assert found == (None,) * 5


def test_models_are_mapped_by_workers(llm):
    """Each worker held tables of some hundred bytes for every n-gram; now a model names files, whatever its size."""
    model = quality.train(llm.createDataFrame([(t,) for t in GOOD], "text string"))
    assert len(pickle.dumps(model)) < 5_000
    for table, *_ in (*model.grams, *model.contexts):
        assert all(isinstance(column, np.memmap) for column in table.columns())


def test_table_equals_dictionary(tmp_path):
    rng = np.random.default_rng(3)
    for n in (0, 1, 20_000):
        keys = np.unique(rng.integers(0, 1 << 60, n))
        values = rng.normal(size=len(keys)).astype(np.float32)
        table = quality.Table(keys, values, f"{tmp_path}/{n}/table")
        asked = rng.permutation(np.concatenate([keys, rng.integers(0, 1 << 60, 1000)]))
        want = dict(zip(keys.tolist(), values.tolist()))
        got = quality.Lookup(pickle.loads(pickle.dumps(table)), -9.0, None).get(asked)
        assert got.tolist() == [want.get(k, -9.0) for k in asked.tolist()]
