import random

import numpy as np

from repolith.llm import base, decontaminate

RNG = random.Random(8)
VOCABULARY = [f"w{i}" for i in range(400)]
ITEMS = [" ".join(RNG.choice(VOCABULARY) for _ in range(n)) for n in (8, 9, 15, 15, 40, 60, 7, 5, 3, 2, 1)]


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = "new"
        elif kind == 1:
            words.insert(at, "more")
        elif len(words) > 1:
            del words[at]
    return words


def closest(item, words):
    """Edit distance of the item to the best stretch."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(words):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (a != b)))
        row = new
    return min(row)


def test_against_brute_force(llm, frame):
    texts = [None, "", " ", "w1", ITEMS[4].upper() + "!", ITEMS[6], "x " * 30_000 + ITEMS[5]]
    for i in range(60):
        item = ITEMS[i % len(ITEMS)].split()
        words = [RNG.choice(VOCABULARY) for _ in range(RNG.choice([0, 5, 200]))]
        at = RNG.randint(0, len(words))
        texts.append(", ".join(words[:at] + edited(item, RNG.randint(0, int(0.3 * len(item))), RNG) + words[at:]))
    benchmark = llm.createDataFrame([*enumerate(ITEMS), (50, None), (51, ""), (None, ITEMS[2])], "item_id long, text string")
    rows = decontaminate.contaminated(frame(texts), benchmark).collect()
    found = {(r.doc_id, r.item_id): r for r in rows}
    for d, text in enumerate(texts):
        words = decontaminate.normal_words(text or "")
        for i, item in enumerate(ITEMS):
            own = decontaminate.normal_words(item)
            distance = closest(own, words) if len(words) < 1000 else 0 if i == 5 or set(own) <= set(ITEMS[5].split()) and item in ITEMS[5] else None
            near = distance is not None and distance <= (int(0.2 * len(own)) if len(own) >= 8 else 0)
            assert ((d, i) in found) == near, (d, i, distance)
            if near:
                r = found[d, i]
                assert r.distance == distance and r.item_words == len(own)
                assert closest(own, words[r.begin : r.end]) == distance
    assert {r.doc_id for r in rows if r.item_id is None} == {d for d, i in found if i == 2}
    docs = frame(texts)
    clean = decontaminate.without_items(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {r.doc_id for r in rows}


def test_nothing(llm, frame):
    benchmark = llm.createDataFrame([(0, ITEMS[4])], "item_id long, text string")
    assert decontaminate.contaminated(frame([ITEMS[4]]), benchmark.filter("false")).count() == 0
    assert decontaminate.contaminated(frame([ITEMS[4]]).filter("false"), benchmark).count() == 0
    assert decontaminate.without_items(frame([ITEMS[4]]), benchmark.filter("false")).count() == 1
    assert sum(len(b) for b in decontaminate.item_blocks(benchmark.union(benchmark), 1)) == 2


def test_recall_at_the_limit():
    items = decontaminate.Items.build(list(enumerate(ITEMS[:6])), 0.2)
    hashes, rng, hits = base.WordHashes(), random.Random(2), 0
    for trial in range(200):
        i = trial % 6
        words = edited(decontaminate.normal_words(ITEMS[i]), int(items.edits[i]), rng)
        around = [f"z{rng.random()}".encode() for _ in range(50)]
        text = hashes.array([*around[:25], *(w if isinstance(w, bytes) else w.encode() for w in words), *around[25:]])
        hits += any(m[0] == i for m in items.matches(text))
    assert hits >= 198
    far = np.array([[1, 2, 3, 4, 5, 6, 7, 8]], np.uint64)
    assert not decontaminate.collides(far, far[0] + np.uint64(100)).any() and decontaminate.collides(far, far[0]).all()
