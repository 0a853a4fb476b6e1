"""Benchmark items in documents, with edits, by a random-walk embedding.

The embedding reads a word sequence with a pointer: at step j it writes the word under the pointer and a random
bit of (j, word) says whether the pointer moves on. Two sequences read by the same bits fall back into
step after an edit, so a small edit distance becomes a small Hamming distance. Repeated sampling of a few
places of several such walks finds item-sized windows whose samples all agree with an item's; the
edit distance then decides.

Not every window is walked. A window within d edits of an item of n words shares at least
n + 1 - g (d + 1) runs of g words with it, on diagonals at most 2 d apart, so windows without them cannot
match; they are left out, and no match is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import base

#: Edits allowed for an item of n words: this share of n, rounded down.
EDITS = 0.2
#: Items of fewer words allow no edit: with few words an edit makes another text.
MIN_WORDS = 8
GRAM = 3
WALKS, TABLES, SAMPLE = 4, 24, 3
#: Items that are searched for in one pass over the documents.
ITEM_BLOCK = 5000
_BLANKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normal_words(text: str) -> list[bytes]:
    """Words in lower case; every ASCII character but letters and digits parts them."""
    return text.lower().encode().translate(_BLANKS).split()


@lru_cache(maxsize=4096)
def _samples(n: int, walk: int) -> np.ndarray:
    """Places of the walk that each table compares."""
    return np.stack([np.random.default_rng([5, walk, t]).choice(2 * n, SAMPLE, replace=False) for t in range(TABLES)])


@lru_cache(maxsize=64)
def _salts(walk: int) -> np.ndarray:
    return np.random.default_rng([9, walk]).integers(0, 2**64, 1 << 16, dtype=np.uint64)


_GRAM_FACTORS = base.multipliers(GRAM, 21)
_FILTER_BITS = 20


def gram_codes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``GRAM`` words; the words are hashes already."""
    count = max(0, len(words) - GRAM + 1)
    return sum((words[i : i + count] * f for i, f in enumerate(_GRAM_FACTORS)), np.zeros(count, np.uint64))


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """The first 2 n words that a walk writes for each row of ``windows`` (rows, n); 0 after its end."""
    rows, n = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    salts = _salts(walk)
    at, everyone = np.zeros(rows, np.int64), np.arange(rows)
    out = np.empty((rows, 2 * n), np.uint64)
    for j in range(2 * n):
        word = padded[everyone, at]
        out[:, j] = word
        at = np.minimum(n, at + (base.mix(word ^ salts[j % len(salts)]) & np.uint64(1)).astype(np.int64))
    return out


def collides(windows: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which windows agree with the item in all samples of some table."""
    hit = np.zeros(len(windows), bool)
    for walk in range(WALKS):
        same = embed(windows, walk) == embed(item[None], walk)
        hit |= same[:, _samples(len(item), walk)].all(2).any(1)
    return hit


def distances(item: np.ndarray, segment: np.ndarray, anchored: bool = False) -> np.ndarray:
    """Edit distance of the item to the best stretch of the segment that ends before each place.

    ``anchored``: to the stretch from the segment's beginning.
    """
    steps = np.arange(len(segment) + 1)
    row = steps.copy() if anchored else np.zeros(len(segment) + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (segment != word))
        row = np.minimum.accumulate(new - steps) + steps
    return row


@dataclass
class Items:
    """Items of one block, with their runs of ``GRAM`` words in order."""

    ids: list
    words: list[np.ndarray]
    edits: np.ndarray
    grams: np.ndarray
    likely: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    #: items shorter than a run, by their first word
    short: dict[int, list[int]]

    @classmethod
    def build(cls, rows: list, share: float) -> Items:
        hashes = base.WordHashes()
        ids, words = [], []
        for item_id, text in rows:
            own = hashes.array(normal_words(text or ""))
            if len(own):
                ids.append(item_id)
                words.append(own)
        grams = [gram_codes(w) for w in words]
        item = np.concatenate([np.full(len(g), i) for i, g in enumerate(grams)]) if grams else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        unique, first = np.unique(flat[order], return_index=True)
        likely = np.zeros(1 << _FILTER_BITS, bool)
        likely[unique >> np.uint64(64 - _FILTER_BITS)] = True
        edits = np.array([int(share * len(w)) if len(w) >= MIN_WORDS else 0 for w in words])
        short: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) < GRAM:
                short.setdefault(int(w[0]), []).append(i)
        return cls(ids, words, edits, unique, likely, np.append(first, len(flat)), item[order], place[order], short)

    def shared(self, item: int) -> int:
        """Runs that a window within the allowed edits has in common with the item."""
        return len(self.words[item]) + 1 - GRAM * (int(self.edits[item]) + 1)

    def starts(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items and places at which a window may match."""
        for word, some in self.short.items():
            at = np.flatnonzero(words == np.uint64(word))
            for i in some if len(at) else ():
                yield i, at
        grams = gram_codes(words)
        at = np.flatnonzero(self.likely[grams >> np.uint64(64 - _FILTER_BITS)])
        if not len(at):
            return
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[slot] == grams[at]
        at, slot = at[same], slot[same]
        if not len(at):
            return
        counts = self.first[slot + 1] - self.first[slot]
        each = np.repeat(self.first[slot], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        item, diagonal = self.item[each], np.repeat(at, counts) - self.place[each]
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        bounds = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
        for b, e in zip(bounds[:-1], bounds[1:], strict=True):
            i = int(item[b])
            need, edits = self.shared(i), int(self.edits[i])
            own = diagonal[b:e]
            if len(own) < need:
                continue
            # runs of enough diagonals within 2 * edits
            close = np.flatnonzero(own[need - 1 :] - own[: len(own) - need + 1] <= 2 * edits)
            if len(close):
                near = own[close][:, None] + np.arange(-edits, edits + 1)
                yield i, np.unique(np.clip(near, 0, max(0, len(words) - 1)))

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """item, edit distance, begin and end of the best stretch for every item found."""
        for i, starts in self.starts(words):
            item, edits = self.words[i], int(self.edits[i])
            n = len(item)
            padded = np.concatenate([words, np.zeros(n, np.uint64)])
            if not edits:
                same = starts[(padded[starts[:, None] + np.arange(n)] == item).all(1)]
                if len(same):
                    yield i, 0, int(same[0]), int(same[0]) + n
                continue
            starts = starts[collides(padded[starts[:, None] + np.arange(n)], item)]
            best = None
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else []:
                low, high = max(0, int(group[0]) - edits), min(len(words), int(group[-1]) + n + 2 * edits)
                row = distances(item, words[low:high])
                end = int(row.argmin())
                if row[end] <= edits and (best is None or row[end] < best[0]):
                    back = distances(item[::-1], words[low : low + end][::-1], anchored=True)
                    length = int(np.flatnonzero(back == row[end])[0])
                    best = (int(row[end]), low + end - length, low + end)
            if best:
                yield (i, *best)


def item_blocks(benchmark: DataFrame, size: int = ITEM_BLOCK) -> Iterator[list[tuple]]:
    """Items (item_id, text) in blocks of about ``size``, which bounds what is broadcast."""
    numbered = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("hash", F.xxhash64("item_id", "text"))
    blocks = max(1, -(-benchmark.count() // size))
    for block in range(blocks):
        rows = numbered.filter(F.pmod("hash", F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, item_words, distance, begin, end: items found in ``docs (doc_id, text)``.

    ``benchmark (item_id, text)``. Words are in lower case, parted by ASCII characters that are neither letter nor digit. A document holds an
    item of n words if some stretch of its words is within ``edits`` * n (rounded down) edits of it; of
    several stretches the closest, then the first counts, as words [begin, end). Items under ``MIN_WORDS``
    words are found without edits only. Null and empty texts and items match nothing. Ids may be null or repeat: rows are answered each. Other
    columns are ignored; an empty table on either side gives no rows.

    Items are taken in blocks of ``ITEM_BLOCK``, each a pass over the documents without any exchange.
    """
    spark = docs.sparkSession
    rows = base.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "text"])
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = ["doc_id", "item_id", "item_words", "distance", "begin", "end"]
    out = spark.createDataFrame([], "doc_id long, item_id long, item_words int, distance int, begin int, end int")
    for some in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(some)

        @base.lean("decontaminate")
        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, hashes = Items.build(shared.value, edits), base.WordHashes()
            for batch in base.pieces(batches):
                found = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    found.extend((doc_id, items.ids[i], len(items.words[i]), d, b, e) for i, d, b, e in items.matches(hashes.array(normal_words(text))))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

        out = out.union(rows.mapInArrow(scan, out.schema))
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all their columns."""
    for some in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(some)

        @base.lean("decontaminate")
        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, hashes = Items.build(shared.value, edits), base.WordHashes()
            for batch in base.pieces(batches):
                stays = [next(items.matches(hashes.array(normal_words(t or ""))), None) is None for t in batch["text"].to_pylist()]
                yield batch.filter(pa.array(stays, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
