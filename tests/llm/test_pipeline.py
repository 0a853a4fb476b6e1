import os

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_stages_against_small_brute_force(llm):
    """Each stage keeps what it should of its own input."""
    from test_decontaminate import closest
    from test_ngram_join import brute

    from repolith.llm import base, decontaminate, mixing

    docs = base.table(llm, SF, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(base.stage(stage(llm, tables[-1], SF), name))
    assert all(t.columns == docs.columns for t in tables[:5])
    rows = [{r.doc_id: r.text for r in t.select("doc_id", "text").collect()} for t in tables[:5]]
    labels = {r.doc_id: r for r in base.table(llm, SF, "labels").collect()}
    good = [d for d in rows[0] if d in labels and labels[d].quality == 1 and labels[d].toxic == 0]
    assert sum(d in rows[1] for d in good) >= 0.97 * len(good)
    ids = sorted(rows[1])
    parts = brute([rows[1][d] for d in ids], corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE)
    assert set(rows[2]) == {ids[root] for _, root in parts.values()}
    items = [decontaminate.normal_words(r.text) for r in base.table(llm, SF, "benchmark").collect()]
    hit = {d for d in rows[2] if any(closest(i, decontaminate.normal_words(rows[2][d])) <= int(0.2 * len(i)) for i in items if set(i) & set(decontaminate.normal_words(rows[2][d])) and len(set(i) - set(decontaminate.normal_words(rows[2][d]))) <= int(0.2 * len(i)))}
    assert set(rows[3]) == set(rows[2]) - hit
    taken = {r.doc_id for r in mixing.mix_plan(tables[3]).filter("taken > 0").collect()}
    assert set(rows[4]) == taken
    assert tables[5].count() == tables[4].count()


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert all(any(name.startswith(f"op{n}_") for name in __spark_entry__.queries()) for n in range(1, 14))


def test_a_worker_keeps_the_tables_of_one_operator():
    """The models of the quality stage stayed in the Python workers of all later stages."""
    from repolith.llm import base, quality

    none = np.empty(0, np.int64), np.empty(0, np.float32), None
    model = quality.Model("m", [none] * quality.ORDER, [none] * quality.ORDER)
    first = quality._scorer(model)
    assert quality._scorer(model) is first
    base.kept("token_codes")["x"] = 1
    assert base.kept("token_codes") == {"x": 1}
    assert quality._scorer(model) is not first
    assert base.kept("token_codes") == {}


def test_a_task_begins_without_what_others_left():
    """Counting n-grams kept the tokenizer of the run before in memory until texts were scored."""
    from repolith.llm import base

    base.kept("token_codes")["x"] = 1
    run = base.lean("quality")(lambda batches: iter([dict(base._KEPT), *batches]))
    assert list(run(iter([1, 2]))) == [{"quality": {}}, 1, 2]
