import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from repolith.llm import base, phrase_dedup, suffix_dedup, windows


def marks(tokens, length, counts):
    gone = np.zeros(len(tokens), bool)
    for i in range(len(tokens) - length + 1):
        if counts[tuple(tokens[i : i + length])] > 1:
            gone[i : i + length] = True
    return gone


def gone_of_all(rows, length):
    counts = Counter(tuple(r[i : i + length]) for r in rows for i in range(len(r) - length + 1))
    return [marks(r, length, counts) for r in rows]


@pytest.mark.parametrize("anchor", [0.3, 0.9])
def test_bytes(frame, copies, anchor):
    texts = [*copies(1, ["ab", "é", "cde ", "x", "yz"], [3, 20, 40]), "a" * 200, "ab" * 90]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeated_bytes(frame(texts), 24, anchor).collect()}
    rows = [(t or "").encode() for t in texts]
    for i, (raw, gone) in enumerate(zip(rows, gone_of_all(rows, 24), strict=True)):
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = len(re.findall(b"\1+", gone.astype(np.uint8).tobytes()))
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(raw), gone.sum(), runs, hashlib.sha256(kept).hexdigest(), kept)
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed


@pytest.mark.parametrize("anchor", [2, 9])
def test_words(frame, copies, anchor):
    texts = [*copies(2, ["a", "b", "é", "B", "c d"], [5, 20, 45]), "a " * 100, "a b " * 60]
    found = {r.doc_id: r for r in phrase_dedup.remove_repeated_phrases(frame(texts), 10, anchor).collect()}
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for i, (words, gone) in enumerate(zip(rows, gone_of_all(rows, 10), strict=True)):
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        r = found[i]
        assert (r.n_words, r.n_removed, r.kept, r.kept_sha256) == (len(words), gone.sum(), kept, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("remove", [suffix_dedup.remove_repeated_bytes, phrase_dedup.remove_repeated_phrases])
def test_repeated_rows_and_null_ids(frame, remove):
    text = " ".join(f"word{i}" for i in range(120))
    docs = frame([text, "short", text[:100]])
    same = docs.filter("doc_id = 0").union(docs.filter("doc_id = 0"))
    assert {r.n_removed > 0 for r in remove(same).collect()} == {True}
    nulls = docs.filter("doc_id = 0").selectExpr("cast(null as long) doc_id", "text", "h", "n", "size")
    both = remove(nulls.union(docs)).collect()
    assert sorted((r.doc_id is None, r.n_removed > 0) for r in both) == [(False, False), (False, False), (False, True), (True, True)]
    assert remove(docs.filter("false")).count() == 0


def test_anchors_stay_inside_texts(monkeypatch):
    monkeypatch.setattr(windows, "_BLOCK", 50)
    rng = np.random.default_rng(4)
    lengths = np.array([0, 30, 5, 64, 20, 0, 90])
    tokens = rng.integers(0, 3, lengths.sum()).astype(np.uint64)
    grams = windows.Rolling(tokens).all(8)
    place, first, last = windows.anchors(grams, lengths, 20, 8)
    filed = {s: p for p, a, b in zip(place, first, last, strict=True) for s in range(a, b + 1)}
    ends = np.cumsum(lengths)
    assert sorted(filed) == [s for b, e in zip(ends - lengths, ends, strict=True) for s in range(b, e - 19)]
    assert all(s <= p <= s + 12 for s, p in filed.items())


def test_arrays_of_a_task_are_bounded_by_bytes():
    """A batch of 1000 rows of long texts made arrays of a value for each of its bytes, all at once."""
    texts = ["x" * n for n in (0, 700, 10, 5000, 1, 1, 300)] * 150 + [None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    found = list(base.short_pieces([batch, batch.slice(0, 0)], size=2000))
    assert [t for b in found for t in b["text"].to_pylist()] == texts
    assert max(sum(map(len, b["text"].drop_null().to_pylist())) for b in found) <= 2000 + 5000
    assert [b.num_rows for b in base.large_pieces(found, 1 << 30)] == [len(texts)]
    assert not list(base.large_pieces([], 10))


def test_powers_are_made_for_pieces_only():
    """Powers were made for all bytes of a batch of rows."""
    scanned = []
    fake = type("Docs", (), {"select": lambda s, *c: s, "mapInArrow": lambda s, f, schema: scanned.append(f)})()
    windows.spans(fake, suffix_dedup._values, 400, 240)
    rows = 1000
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(rows), pa.int64()), "h": pa.array(range(rows), pa.int64()), "text": ["abcdefghij" * 400] * rows})
    windows._POWERS.up = windows._POWERS.down = np.ones(1, np.uint64)
    assert sum(b.num_rows for b in scanned[0](iter([batch]))) > rows
    assert len(windows._POWERS.up) <= 1 << 20
