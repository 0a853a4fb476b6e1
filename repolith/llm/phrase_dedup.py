"""Removal of word windows that occur twice, located by repeated-phrase automata.

Recurring windows are confirmed first (:mod:`repolith.llm.windows`), each as part of a passage: a run
of words in one document that stands for all documents with the same words. Documents are then dealt into
batches, and every passage goes to the batches that hold its anchor. A batch compiles its passages into an
Aho-Corasick automaton over its own word numbers and streams all its documents through it; every
occurrence of a passage is removed. Automata are bounded by the size of a batch, and matching is on the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import base, windows

WINDOW = 35
ANCHOR = 8
#: Text of a batch, about.
BATCH_CHARS = 4 << 20


def _words(text: str) -> list[bytes]:
    """Words as bytes: bytes.split() knows ASCII white space only."""
    return text.encode().split()


def _values() -> windows.Values:
    hashes = base.WordHashes()

    def values(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [_words(t) for t in texts]
        return hashes.array(list(chain.from_iterable(words))), np.array([len(w) for w in words], np.int64)

    return values


def passages(docs: DataFrame, found: windows.Recurring, window: int) -> DataFrame:
    """anchor, span, passage: the words of every recurring run, from the place that stands for its kind."""
    whole = found.kinds.filter("not differ").select("anchor", "span", "doc_id", "h", "first", "last")
    parts = found.kinds.filter("differ").join(found.runs, "span")
    parts = parts.select("anchor", "span", "doc_id", "h", (F.col("first") + F.col("b")).alias("first"), (F.col("first") + F.col("e")).alias("last"))
    asked = whole.union(parts).groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "span", "first", "last")).alias("asked"))
    texts = docs.alias("d").join(asked.alias("a"), windows.same_document("d", "a")).select("d.doc_id", "d.h", "text", "asked").dropDuplicates(["doc_id", "h"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.pieces(batches, 200):
            out: list[tuple] = []
            for text, asked in zip(batch["text"].to_pylist(), batch["asked"].to_pylist(), strict=True):
                words = _words(text)
                out.extend((a["anchor"], a["span"], b" ".join(words[a["first"] : a["last"] + window]).decode()) for a in asked)
            anchor, span, passage = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(span, pa.int64()), pa.array(passage, pa.string())], names=["anchor", "span", "passage"])

    return texts.mapInArrow(scan, "anchor long, span long, passage string")


def automaton(patterns: list[list[bytes]]):
    """Automaton over word numbers, and the numbers of the words in passages, from 1."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    numbers: dict[bytes, int] = {}
    for words in patterns:
        if words:
            made.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words))
    if len(made):
        made.make_automaton()
    return made, numbers


def covered(made, key: np.ndarray, least: int) -> np.ndarray:
    """Which words an occurrence covers; ``key`` has 0 for words of no passage.

    An occurrence lies in a run of words that passages have, and is ``least`` words long at least. Shorter runs are
    not fed to the automaton, whose root looks through a branch for every first word.
    """
    change = np.zeros(len(key) + 1, np.int64)
    if len(made):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], key > 0, [0]])))
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin >= least:
                for last, length in made.iter(tuple(key[begin:end].tolist())):
                    change[begin + last + 1 - length] += 1
                    change[begin + last + 1] -= 1
    return np.cumsum(change)[:-1] > 0


def remove_repeated_phrases(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept for each row of ``docs (doc_id, text)``.

    Every word covered by a window of ``window`` words that starts anywhere else as well goes; all are
    judged on the input. ``kept`` joins the remaining words with single spaces. A null text has no words;
    null and repeated ids are fine; rows alike in doc_id and text are copies of each other like any
    others. Other columns are ignored. ``anchor`` and ``batch_chars`` change the cost, not the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = windows.recurring_windows(rows, _values, window, anchor)
    texts = base.stage(passages(rows, found, window), "passages")

    chars = docs.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    batches = max(4 * base.partitions(spark), -(-chars // batch_chars))
    batch = F.pmod(F.xxhash64("doc_id", "h"), F.lit(batches)).alias("batch")
    routed = found.spans.select("anchor", "span", batch).distinct().join(texts, ["anchor", "span"]).select("batch", "passage")
    routed = base.stage(routed, "routed")
    base.drop_staged(texts, found.spans, found.kinds, found.runs)
    dealt = rows.select(batch, "doc_id", "text")
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}

    def locate(own: pa.Table, patterns: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in types}
        words = [_words(text) for text in own["text"].to_pylist()]
        made, numbers = automaton([p.encode().split(b" ") for p in set(patterns["passage"].to_pylist())])
        for doc_id, ws in zip(own["doc_id"].to_pylist(), words, strict=True):
            gone = covered(made, np.fromiter(map(numbers.get, ws, repeat(0)), np.int64, len(ws)), window)
            kept = b" ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g] if gone.any() else ws)
            for name, value in zip(types, (doc_id, len(ws), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                out[name].append(value)
        return pa.table([pa.array(out[n], t) for n, t in types.items()], names=list(types))

    return dealt.groupBy("batch").cogroup(routed.groupBy("batch")).applyInArrow(locate, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
