"""Windows of a fixed length that occur more than once, over sequences of 64-bit token values.

Comparing every window of a large corpus means one row per position. Instead each window is filed under
its *anchor*: the run of ``k`` tokens with the smallest hash inside it. Equal windows have equal anchors at
equal places, and neighbouring windows mostly share theirs, so a document has one row per anchor, which
stands for a range of window starts (its *span*).

Three passes follow, each on what the last one could not settle, as in a radix sort that starts with
the most significant digit:

1. anchors that occur once leave, with all windows filed under them;
2. where all spans of an anchor are equal, all their windows recur;
3. where spans differ, one of each kind lists its windows, and those found twice recur.

The passes group hashes of 64 bits, with map-side combine. The joins back to the rows of an anchor meet one
row per anchor, so Spark may split the rows of a very common one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import base

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_POSITION = 24
#: Windows whose anchors are sought at a time.
_BLOCK = (1 << _POSITION) - (1 << 20)


class _Powers:
    """Powers of an odd factor and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = base.two_to_the(n)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, f, np.uint64))]) for f in (_FACTOR, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


class Rolling:
    """Hashes of any run of a sequence in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = _POWERS.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def hash(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        down = self.down[: len(self.sums)][begin]
        return base.mix((self.sums[end] - self.sums[begin]) * down)

    def all(self, length: int) -> np.ndarray:
        """Of every run of ``length`` tokens, by start."""
        n = len(self.sums) - length
        return self.hash(slice(0, n), slice(length, None)) if n > 0 else np.empty(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by start."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(grams: np.ndarray, lengths: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows that lie inside one of the texts that follow each other with these lengths.

    Place of the anchor, first and last window start filed under it. ``grams`` has the hash of every run of
    ``k`` tokens. Of equal hashes the leftmost counts, which depends on the window alone.
    """
    width, n = window - k + 1, int(lengths.sum()) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    ends = np.repeat(np.cumsum(lengths), lengths)[:n]
    inside = np.arange(window, n + window) <= ends
    place = np.empty(n, np.int64)
    low = np.uint64((1 << _POSITION) - 1)
    for at in range(0, n, _BLOCK):
        some = grams[at : at + min(_BLOCK, n - at) + width - 1]
        smallest = sliding_min((some & ~low) | np.arange(len(some), dtype=np.uint64), width)
        place[at : at + len(smallest)] = (smallest & low).astype(np.int64) + at
    place[~inside] = -1
    change = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [n]]) - 1
    full = place[first] >= 0
    first, last = first[full], last[full]
    return place[first], first, last


SPANS = "doc_id long, h long, place int, first int, last int, anchor long, span long"
#: Token values of some texts, one after the other, and the number of each text's tokens.
Values = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def spans(docs: DataFrame, values: Callable[[], Values], window: int, k: int) -> DataFrame:
    """``SPANS`` of ``docs (doc_id, h, text)``; ``values()`` makes the function from texts to token values."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = values()
        for batch in base.short_pieces(batches):
            tokens, lengths = of(batch["text"].to_pylist())
            rolling = Rolling(tokens)
            grams = rolling.all(k)
            place, first, last = anchors(grams, lengths, window, k)
            # the span's hash also knows where the anchor stands in it
            whole = rolling.hash(first, last + window) ^ base.mix((place - first).astype(np.uint64))
            begins = np.cumsum(lengths) - lengths
            row = np.searchsorted(begins + lengths, first, side="right")
            columns = [batch["doc_id"].take(pa.array(row)), batch["h"].take(pa.array(row))]
            columns += [pa.array((x - begins[row]).astype(np.int32)) for x in (place, first, last)] + [base.signed(grams[place]), base.signed(whole)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "place", "first", "last", "anchor", "span"])

    return docs.select("doc_id", "h", "text").mapInArrow(scan, SPANS)


def same_document(a: str, b: str) -> F.Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def recurring_spans(found: DataFrame) -> DataFrame:
    """Passes 1 and 2: spans whose anchor recurs, with ``differ``: whether not all its spans are equal."""
    groups = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("low"), F.max("span").alias("high"))
    groups = groups.filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("differ"))
    # a table of its own, so that the join may split the rows of a very common anchor
    groups = base.stage(groups, "anchors")
    return found.join(groups, "anchor")


def window_hashes(docs: DataFrame, kinds: DataFrame, values: Callable[[], Values], window: int) -> DataFrame:
    """span, offset, hash of every window of ``kinds (anchor, span, doc_id, h, first, last)``.

    The texts meet the list of spans they are asked for, never more than one document's.
    """
    asked = kinds.groupBy("doc_id", "h").agg(F.collect_list(F.struct("span", "first", "last")).alias("asked"))
    # rows alike in doc_id and text would list the same windows twice
    texts = docs.alias("d").join(asked.alias("a"), same_document("d", "a")).select("d.doc_id", "d.h", "text", "asked").dropDuplicates(["doc_id", "h"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = values()
        for batch in base.short_pieces(batches):
            tokens, lengths = of(batch["text"].to_pylist())
            rolling, asked = Rolling(tokens), batch["asked"]
            each = asked.flatten()
            first, last, span = (np.array(each.field(c), np.int64) for c in ("first", "last", "span"))
            begins = np.repeat(np.cumsum(lengths) - lengths, np.array(asked.value_lengths(), np.int64))
            counts = last - first + 1
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start = np.repeat(first + begins, counts) + offset
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(span, counts)), pa.array(offset.astype(np.int32)), base.signed(rolling.hash(start, start + window))], names=["span", "offset", "hash"])

    return texts.mapInArrow(scan, "span long, offset int, hash long")


class Recurring(NamedTuple):
    """``spans``: the spans whose anchor recurs (``SPANS`` and ``differ``). ``kinds``: each distinct (anchor, span)
    with its count ``n`` and one place (doc_id, h, first, last). ``runs``: span, b, e, the first and last
    offset of windows that recur, for the kinds of anchors whose spans differ.
    """

    spans: DataFrame
    kinds: DataFrame
    runs: DataFrame


def recurring_windows(docs: DataFrame, values: Callable[[], Values], window: int, k: int) -> Recurring:
    """All three passes over ``docs (doc_id, h, text)``, with ``h`` a hash of the text."""
    # both passes over the spans read this table, so the texts are scanned once
    found = base.stage(spans(docs, values, window, k), "found")
    recurring = base.stage(recurring_spans(found), "spans")
    base.drop_staged(found)
    kinds = recurring.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("n"), F.max("differ").alias("differ"), F.min(F.struct("doc_id", "h", "first", "last")).alias("at"))
    kinds = base.stage(kinds.select("anchor", "span", "n", "differ", "at.*"), "kinds")
    # windows found under two kinds of spans
    listed = base.stage(window_hashes(docs, kinds.filter("differ"), values, window), "windows")
    groups = listed.groupBy("hash").agg(F.min("span").alias("low"), F.max("span").alias("high")).filter("low <> high")
    groups = base.stage(groups.select("hash"), "hashes")
    again = listed.join(groups, "hash", "left_semi").select("span", "offset")
    runs = again.groupBy("span").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))
    # all windows of a kind that stands in two places
    whole = kinds.filter("differ and n > 1").select("span", F.sequence(F.lit(0), F.col("last") - F.col("first")).alias("offsets"))
    # written first, as a lambda would sort the array anew for each of its elements
    runs = base.stage(runs.union(whole), "offsets")
    begins = F.filter("offsets", lambda o, i: (i == 0) | (F.get("offsets", i - 1) != o - 1))
    ends = F.filter("offsets", lambda o, i: (i == F.size("offsets") - 1) | (F.get("offsets", i + 1) != o + 1))
    runs = runs.select("span", F.explode_outer(F.arrays_zip(begins.alias("b"), ends.alias("e"))).alias("r"))
    runs = runs.select("span", "r.b", "r.e").distinct()
    out = Recurring(recurring, kinds, base.stage(runs, "runs"))
    base.drop_staged(listed, groups)
    return out


def repeated_windows(docs: DataFrame, values: Callable[[], Values], window: int, k: int) -> DataFrame:
    """doc_id, h, begin, end: runs of tokens covered by windows that start anywhere else too.

    Runs of one document may touch or overlap, and rows alike in doc_id and text give each run twice;
    :func:`merged` puts them in order.
    """
    found = recurring_windows(docs, values, window, k)
    equal = found.spans.filter("not differ").select("doc_id", "h", "first", "last")
    hit = found.spans.filter("differ").select("span", "doc_id", "h", "first").join(found.runs, "span")
    hit = hit.select("doc_id", "h", (F.col("first") + F.col("b")).alias("first"), (F.col("first") + F.col("e")).alias("last"))
    return equal.union(hit).select("doc_id", "h", F.col("first").alias("begin"), (F.col("last") + window).alias("end"))


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    """Sorted, disjoint runs; those that touch are one."""
    out: list[list[int]] = []
    for r in sorted((r["begin"], r["end"]) for r in runs or []):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [(b, e) for b, e in out]


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, text and ``runs``, an array of (begin, end) or null, for every row of ``docs``."""
    lists = runs.groupBy("doc_id", "h").agg(F.collect_set(F.struct("begin", "end")).alias("runs"))
    return docs.alias("d").join(lists.alias("r"), same_document("d", "r"), "left").select("d.doc_id", "text", "runs")
