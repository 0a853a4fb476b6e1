import random

import pytest

from repolith.llm import base


@pytest.fixture(scope="session")
def llm(spark):
    return base.prepare(spark)


@pytest.fixture
def frame(llm):
    """Documents of the given texts: ids by place, dealt over tasks, with columns of clashing names."""

    def make(texts, **columns):
        rows = [(i, t, *(c[i] for c in columns.values())) for i, t in enumerate(texts)]
        schema = ", ".join(["doc_id long", "text string", *(f"{name} {'string' if name in ('lang', 'source') else 'long'}" for name in columns), "h string", "n string", "size string"])
        return llm.createDataFrame([(*r, "x", None, "y") for r in rows], schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def copies():
    """Texts that share runs of words: copies with edits, ties, nulls, white space, a long text."""

    def make(seed, words, lengths, n=40, edits=3):
        rng = random.Random(seed)
        bases = [[rng.choice(words) for _ in range(rng.choice(lengths))] for _ in range(n // 4)]
        texts = []
        for _ in range(n):
            text = list(rng.choice(bases))
            for _ in range(rng.randint(0, edits)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", " \t"]).join(text + rng.choice(bases)[: rng.randint(0, 8)]))
        return [*texts, texts[0], texts[0], None, "", " \n", " ".join(bases[0] * 40)]

    return make
