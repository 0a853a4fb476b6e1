import random
import re
from collections import Counter

import numpy as np
import pytest

from repolith.llm import collocations as c


def brute(rows, max_words, min_count, share, k):
    out = []
    for lang in sorted({lang or "und" for lang, _ in rows}):
        f = Counter()
        for own, text in rows:
            if (own or "und") == lang:
                lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(w[i : i + n]) for n in range(1, max_words + 1) for i in range(len(w) - n + 1))
        n = sum(v for p, v in f.items() if len(p) == 1)
        often = {p: v for p, v in f.items() if len(p) > 1 and v >= min_count}
        found = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and 100 * v >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, v in often.items())
            if not inside:
                score, at = min((1_000_000 * a * a // (f[p[:i]] * f[p[i:]]), i) for i in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:at]], f[p[at:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("max_words, shard, chunk", [(3, 1 << 20, 1 << 16), (4, 30, 7), (2, 100, 16)])
def test_against_brute_force(frame, rows, max_words, shard, chunk):
    rng = random.Random(max_words)
    words = ["the", "The", "a", "ÉÈ", "x\x00y", "on", "und", "é", "zz ", "1-2"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", ""]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " \t", "a " * 400, texts[0], texts[0], "a a. a a"]
    langs = [rng.choice(["en", "en", "fr", None, "und"]) for _ in texts]
    docs = frame(texts, lang=langs, f=[0] * len(texts), phrase=[1] * len(texts), shard=[2] * len(texts))
    got = c.collocations(docs, max_words, min_count=4, share=50, k=15, shard_words=shard, chunk_words=chunk)
    assert rows(got) == sorted(brute(list(zip(langs, texts)), max_words, 4, 50, 15), key=repr)


def test_nothing(frame):
    assert c.collocations(frame([], lang=[])).count() == 0
    assert c.collocations(frame([None, "", "one"], lang=["en", None, "fr"])).count() == 0


def test_large_counts_are_exact(llm):
    rows = llm.createDataFrame([("en", "a b", 9 * 10**14 + 1, [10**15 - 1], [10**15 - 3], 10**15)], "lang string, phrase string, f long, heads array<long>, tails array<long>, n long")
    got = c._scored(rows).first()
    assert got.score == 10**6 * (9 * 10**14 + 1) ** 2 // ((10**15 - 1) * (10**15 - 3))


def test_index_and_names():
    text = np.array([0, 1, 2, 1, 2, 0, 2, 2, 0])
    assert sorted(zip(*(a.tolist() for a in c.Index(text).extensions()))) == [(1, 2, 2), (2, 1, 1), (2, 2, 1)]
    named = c.rename(text, np.array([1, 2]), np.array([2, 2]), np.array([70, 80]), True)
    assert named.tolist() == [0, 70, 0, 70, 0, 0, 80, 0, 0]
    assert c.rename(text, np.array([2]), np.array([0]), np.array([5]), False).tolist() == [0, 0, 5, 0, 5, 0, 5, 5, 0]
    assert c.rename(text, np.array([], int), np.array([], int), np.array([], int), True).tolist() == [0] * 9
