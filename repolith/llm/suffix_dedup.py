"""Removal of byte strings that occur twice, by anchors in place of a radix sort of suffixes.

Of the suffixes of all texts only the first ``length`` bytes matter: suffixes equal that far are a repeated
window, whatever follows. :mod:`repolith.llm.windows` files them under anchors and groups anchors, spans and
window hashes; no suffix is ordered. Groups of one leave after each pass, and the groups that are left after
the last one are the repeated windows, up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import base, windows

LENGTH = 400
_BYTES = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)


def _values() -> windows.Values:
    def values(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        return _BYTES[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(r) for r in raw], np.int64)

    return values


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, anchor: float = 0.6) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans for each row of ``docs (doc_id, text)``.

    Every byte covered by a string of ``length`` bytes that starts anywhere else as well goes; matches
    never cross documents and all are judged on the input. ``kept`` holds the remaining bytes, ``spans``
    the removed runs (begin, end). A null text is empty; null and repeated ids are fine; rows alike in
    doc_id and text are copies of each other like any others. Other columns are ignored.

    ``anchor`` is the share of a window that its anchor takes; it changes the cost, not the result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = windows.repeated_windows(rows, _values, length, max(1, int(length * anchor)))
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.short_pieces(batches):
            out: dict[str, list] = {name: [] for name in types}
            for text, runs in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                raw, runs = text.encode(), windows.merged(runs)
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True))
                values = (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"begin": b, "end": e} for b, e in runs])
                for name, value in zip(list(types)[1:], values, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(out[n], t) for n, t in list(types.items())[1:])], names=list(types))

    return windows.with_runs(rows, found).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<begin:int,end:int>>")
