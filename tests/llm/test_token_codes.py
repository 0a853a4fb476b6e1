import zlib

import numpy as np
import pytest

from repolith.llm import queries, token_codes

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = ["a  b", "\na b", "a b\n", " a", " ", "", "\n", "a \nb", "a\n\nb", "x \t y", "a\r\n b", "<|endoftext|> a", "it's 'll, so.", " a b  c", "a\u0085 b", "a\x1c b", "x　y z", "naïve, café. 12,5.", 'said "no", ok', "_, a_. b", "éa, b", None]


def whole(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_round_trip(n, bits):
    ids = (np.random.default_rng(n).pareto(0.5, n) * 3).clip(0, 2**31).astype(np.uint32)
    payload = token_codes.pack(ids, bits)
    assert (token_codes.unpack(payload) == ids).all()
    for i in {0, n // 2, n - 1} - {-1} if n else ():
        assert token_codes.token_at(payload, i) == ids[i]
    with pytest.raises(IndexError):
        token_codes.token_at(payload, n)


def test_encoder_equals_whole_texts():
    coder = token_codes.Encoder(queries.vocabulary(), limit=5)
    for _ in range(2):
        texts = [t or "" for t in ODD]
        assert [np.frombuffer(raw, np.uint32).tolist() + [0] for raw in coder.encode(texts)] == whole(texts)


def test_lines_are_encoded_many_at_once(monkeypatch):
    """Words after line breaks and words with marks went to the library one by one."""
    coder, sent = token_codes.Encoder(queries.vocabulary()), []
    ids = coder.ids
    monkeypatch.setattr(coder, "ids", lambda texts: sent.extend(texts) or ids(texts))
    odd = ["<|endoftext|>", "a<|endoftext|>b", "it's", "'s", "x!", "'", "é,.", "12.", "²3", "\u0301a", "a\u200bb", "\x00", "日本,", "a_b"]
    texts = ["\n".join(f"{w}{o}" for w in "abcdefghijkl" for o in odd), " ".join(f"{o}{n}," for o in odd for n in "abcdefghijkl"), "x " + " ".join(odd), "x\n" + "\n".join(odd)]
    assert [np.frombuffer(raw, np.uint32).tolist() + [0] for raw in coder.encode(texts)] == whole(texts)
    coder.encode(["x\n" + "\n".join(f"line{i}" for i in range(400)) + " " + " ".join(f"mark{i}!" for i in range(400))])
    assert sum(t.count("line") + t.count("mark") for t in sent) >= 800 and sum("line" in t or "mark" in t for t in sent) < 10


def test_files(llm, frame, tmp_path):
    docs = frame(ODD + ["word " * 4000])
    docs = docs.union(docs.filter("doc_id = 3")).union(docs.filter("doc_id = 4").selectExpr("null", "text", "h", "n", "size"))
    path = str(tmp_path / "tokens")
    token_codes.write_tokens(docs, path, queries.vocabulary(), segment_ids=64)
    rows = token_codes.read_documents(llm, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD) + 1)]
    texts = [*ODD, "word " * 4000]
    start, stream = 0, []
    for r in rows:
        (ids,) = whole([" " if r.doc_id is None else texts[r.doc_id]])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    got = {r.start: r.ids for r in token_codes.read_ids(llm, path).collect()}
    assert sum((got[s] for s in sorted(got)), []) == stream
    asked = [0, 1, len(stream) // 2, len(stream) - 1, len(stream), 1]
    found = token_codes.lookup(llm.createDataFrame([(p,) for p in asked], "pos long"), path, span=100).collect()
    assert sorted((r.pos, r.token) for r in found) == sorted((p, stream[p]) for p in asked if p < len(stream))


def test_empty(llm, frame, tmp_path):
    path = str(tmp_path / "none")
    assert token_codes.encode_documents(frame(["a"]).filter("false"), queries.vocabulary(), path).count() == 0
