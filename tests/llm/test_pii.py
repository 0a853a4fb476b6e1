import random
import re

import pytest
from pyspark.sql import Row

from repolith.llm import pii


def luhn(value):
    own = [int(c) for c in value if c.isdigit()][::-1]
    return 13 <= len(own) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(own)) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= sum(c.isdigit() for c in v) <= 15),
}


def plain(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_base_spans(frame):
    rng = random.Random(5)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))) for alphabet in ("ab1290.@-+ ()_%é\n4", "0123456789 -.+", "a.@-b") for _ in range(500)]
    texts += [None, "", "a." * 20_000 + "@b", "4111111111111111 " * 1500, "x@y.z" * 3000, "1." * 20_000, "😀a@b.co 4111 1111 1111 1111 +1 (389) 555-5010", "10.0.0.1 10.0.0.256 +49 30 1234567"]
    found = pii.find_personal_data(frame(texts)).collect()
    assert len(found) == len(texts)
    for r in found:
        assert [tuple(s) for s in r.base] == plain(texts[r.doc_id])
        own = [tuple(s) for s in r.spans]
        assert set(plain(texts[r.doc_id])) <= set(own)
        assert own == sorted(own, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_method_adds_spans(frame):
    texts = [f"write an email to ann{i}@site.com or call +1 (389) 555-{1000 + i} now" for i in range(40)]
    texts += [f"call the phone (389) 555-{2000 + i} please" for i in range(10)] + ["clean text with 12 words and 2024"] * 10
    found = {r.doc_id: r for r in pii.find_personal_data(frame(texts)).collect()}
    more = [s for r in found.values() for s in r.spans if s not in r.base]
    assert more and all(s.kind == "phone" for s in more)
    assert all(not found[i].spans for i in range(50, 60))


def test_empty(frame):
    assert pii.find_personal_data(frame(["a"]).filter("false")).count() == 0


def test_estimates():
    good, bad = [1, 1, 1, 0, 0], [-1, -1, 0, 0, -1]
    counts = [Row(kind="card", votes=good, length=1, n=90), Row(kind="card", votes=bad, length=2, n=60), Row(kind="card", votes=[1, 0, 1, 0, 0], length=1, n=20)]
    says, posterior = pii.reliabilities(counts)
    assert posterior["card", tuple(good)] > 0.9 > 0.1 > posterior["card", tuple(bad)]
    assert says["card", 0, 1][1] > says["card", 0, 0][1]
    weights = pii.span_classifier(counts, posterior)
    total = lambda votes, length: sum(weights[f] for f in pii.features("card", votes, length))
    assert total(good, 1) > 0 > total(bad, 2)
    assert pii.reliabilities([]) == ({}, {}) and pii.span_classifier([], {}) == {}


@pytest.mark.parametrize("hint", pii._HINTS.items())
def test_hints_stand_in_patterns(hint):
    assert hint[1] in pii.BASE_PATTERNS[hint[0]]
