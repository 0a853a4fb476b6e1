"""Ranked lexical search with geometrically blocked posting lists.

Documents are dealt over shards, and a shard keeps, for the terms that the items use, the exact share that each
document's term adds to a score. The posting list of a term is cut into blocks of documents that resemble each other:
sample members of the list are pivots, the others join the nearest one by a random projection of their terms. A block's
summary holds the largest share of each term among its documents.

An item visits the lists of its terms, the most promising first. The sum of a block's summary over the terms not
yet visited bounds the score of all its documents that no earlier list held, so a block is skipped exactly when
that sum is below the k-th best score so far; documents of the others are scored whole from the forward index.
Coordinates of summaries are computed when first asked for, and kept. No document of the answer is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions.ranking import top_k
from repolith.llm import base

#: Documents, and postings of item terms, of a shard, about.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21
#: Bytes of the texts of items that are searched for in one scan of the documents; more items take more scans.
ITEM_BYTES = 1 << 24
#: Dimensions of the projection by which documents of a list are grouped.
PROJECTION = 16
#: Summary coordinates that a shard keeps at a time.
KEPT_COORDINATES = 1 << 17

_LETTERS = bytes(range(48, 58)) + bytes(range(97, 123))
_TABLE = bytes(b if b >= 128 or b in _LETTERS else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return (text or "").encode().translate(_TABLE).split()


def forward(docs: DataFrame, doc_id: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tf of every text with a term: its length, and the terms of the vocabulary it holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.pieces(batches):
            rows: list[tuple] = []
            for i, text in enumerate(batch["text"].to_pylist()):
                if found := terms(text):
                    times = Counter(filter(None, map(vocabulary.get, found)))
                    rows.append((i, len(found), list(times), list(times.values())))
            at, *columns = zip(*rows, strict=True) if rows else [()] * 4
            arrays = [batch["doc_id"].take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text"))
    return base.spread(rows, ["doc_id", "text"]).mapInArrow(scan, "doc_id long, n long, terms array<int>, tf array<long>")


class ShardIndex:
    """Forward index and blocked posting lists of a shard. Shares are whole numbers, so all bounds are exact."""

    def __init__(self, sizes: np.ndarray, term: np.ndarray, share: np.ndarray, width: int):
        self.docs = len(sizes)
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.term, self.share = term, share
        doc = np.repeat(np.arange(self.docs), sizes)
        # by term, and by share below it: the last of some equal targets of an assignment is the largest
        order = np.lexsort((share, term))
        self.list_doc, self.list_share = doc[order], share[order]
        self.list_at = np.searchsorted(term[order], np.arange(width + 1))
        self.width = width
        signs = np.random.default_rng(5).choice(np.array([-1.0, 1.0], np.float32), (PROJECTION, width))
        self.place = np.zeros((self.docs, PROJECTION), np.float32)
        for d in range(PROJECTION):
            self.place[:, d] = np.bincount(doc, share * signs[d][term], self.docs)
        self.place /= np.maximum(np.linalg.norm(self.place, axis=1, keepdims=True), 1e-12)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.summaries: dict[tuple[int, int], np.ndarray] = {}

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        some = slice(self.list_at[t], self.list_at[t + 1])
        return self.list_doc[some], self.list_share[some]

    def largest(self, t: int) -> int:
        at, end = self.list_at[t], self.list_at[t + 1]
        return int(self.list_share[end - 1]) if end > at else 0

    def block(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a list by block, where each block begins, and the block of every document of the shard."""
        if t not in self.blocks:
            docs = np.sort(self.postings(t)[0])
            count = math.isqrt(len(docs) - 1) + 1
            pivots = self.place[docs[np.linspace(0, len(docs) - 1, count).astype(np.int64)]]
            nearest = (self.place[docs] @ pivots.T).argmax(1)
            _, nearest = np.unique(nearest, return_inverse=True)
            order = np.argsort(nearest, kind="stable")
            starts = np.searchsorted(nearest[order], np.arange(nearest.max() + 2))
            of = np.full(self.docs, len(starts) - 1, np.int32)  # one more block, for documents of other lists
            of[docs] = nearest
            self.blocks[t] = docs[order], starts, of
        return self.blocks[t]

    def summary(self, t: int, coordinate: int) -> np.ndarray:
        """Largest share of ``coordinate`` in each block of the list of ``t``."""
        if (t, coordinate) not in self.summaries:
            if len(self.summaries) >= KEPT_COORDINATES:
                self.summaries.clear()
                self.blocks.clear()
            _, starts, of = self.block(t)
            docs, share = self.postings(coordinate)
            most = np.zeros(len(starts), np.int64)
            most[of[docs]] = share
            self.summaries[t, coordinate] = most[:-1]
        return self.summaries[t, coordinate]

    def score(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores; ``query`` holds the repeats of every term."""
        size = self.offset[docs + 1] - self.offset[docs]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self.offset[docs] - first, size)
        # sums of whole numbers by cumulation: exact
        total = np.concatenate([[0], np.cumsum(query[self.term[at]] * self.share[at])])
        return total[first + size] - total[first]

    def search(self, wanted: dict[int, int], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best documents, their scores, and the number of documents scored."""
        query = np.zeros(self.width, np.int64)
        query[list(wanted)] = list(wanted.values())
        lists = sorted(((n * self.largest(t), t) for t, n in wanted.items()), reverse=True)
        lists = [(most, t) for most, t in lists if most > 0]
        remaining = [sum(most for most, _ in lists[i:]) for i in range(len(lists))]
        seen = np.zeros(self.docs, bool)
        best, scores, floor = np.empty(0, np.int64), np.empty(0, np.int64), 1
        for i, (_, t) in enumerate(lists):
            if remaining[i] < floor:
                break
            members, starts, _ = self.block(t)
            bound = np.zeros(len(starts) - 1, np.int64)
            for _, other in lists[i:]:
                bound += wanted[other] * self.summary(t, other)
            order = np.argsort(-bound, kind="stable")
            at, step = 0, 2
            while at < len(order) and bound[order[at]] >= floor:
                some = order[at : at + step]
                some = some[bound[some] >= floor]
                docs = np.concatenate([members[starts[b] : starts[b + 1]] for b in some.tolist()])
                docs = docs[~seen[docs]]
                seen[docs] = True
                best, scores = np.concatenate([best, docs]), np.concatenate([scores, self.score(docs, query)])
                keep = np.lexsort((ids[best], -scores))[:k]
                best, scores = best[keep], scores[keep]
                if len(best) == k:
                    floor = max(1, int(scores[-1]))
                at, step = at + step, 2 * step
        keep = scores > 0
        return best[keep], scores[keep], int(seen.sum())


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", shard_docs: int = SHARD_DOCS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item.

    Terms are runs of letters, digits and non-ASCII characters of ``text``, A-Z in lower case. N counts the documents
    with a term, L all their terms, n those of one document, df the documents that hold a term, tf its occurrences
    in one. With w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 25 + 75nN div L, a document's score is the sum
    of w * (1000000000tf div (1000tf + 8m)) over the item's terms, repeats included.

    Best first, ties to the smaller id, documents without an id last; scores of 0 are left out. Null and empty texts hold nothing. Every row is a document, repeated ones too; rows of items alike in id and text
    count once, and items that share an id only are ranked on their own. Other columns are ignored, empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    asked = base.stage(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scans = size // item_bytes + 1
    found = None
    for scan in range(scans):
        some = asked.filter(F.pmod(F.xxhash64("item"), F.lit(scans)) == scan)
        part = _search(docs, some, k, doc_id, shard_docs)
        found = part if found is None else found.unionByName(part)
    found = found.withColumn("last", F.col("doc_id").isNull())
    best = top_k(found, k, ["item"], [F.desc("score"), F.col("last"), F.col("doc_id")])
    return best.join(asked, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search(docs: DataFrame, items: DataFrame, k: int, doc_id: str, shard_docs: int) -> DataFrame:
    """item, doc_id, score: the best documents of every shard for items of bounded size."""
    spark = docs.sparkSession
    queries = {r["item"]: Counter(terms(r["text"])) for r in items.select("item", "text").toLocalIterator()}
    vocabulary: dict[bytes, int] = {}
    for q in queries.values():
        for t in q:
            vocabulary.setdefault(t, len(vocabulary) + 1)
    width = len(vocabulary) + 1
    wanted = {item: {vocabulary[t]: n for t, n in q.items()} for item, q in queries.items()}

    held = base.stage(forward(docs, doc_id, vocabulary).withColumn("place", F.monotonically_increasing_id()), "forward")
    total = held.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms"))).first()
    n_docs, n_terms, postings = (int(x or 0) for x in total)
    # one count for each term of the items
    weight = np.zeros(width, np.int64)
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weight[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    shards = max(1, -(-n_docs // shard_docs), -(-postings // SHARD_POSTINGS))
    held = held.filter(F.size("terms") > 0).withColumn("shard", F.pmod("place", F.lit(shards)))
    no_id = np.iinfo(np.int64).max

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        ids = table["doc_id"].fill_null(no_id).to_numpy()
        sizes = np.array([len(x) for x in table["terms"]], np.int64)
        term, tf = (pa.concat_arrays(table[c].chunks).flatten().to_numpy() for c in ("terms", "tf"))
        m = np.repeat(25 + 75 * table["n"].to_numpy() * n_docs // n_terms, sizes)
        index = ShardIndex(sizes, term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m)), width)
        rows: list[tuple[int, np.ndarray, np.ndarray]] = []
        for item, q in wanted.items():
            best, scores, _ = index.search(q, ids, k)
            if len(best):
                rows.append((item, ids[best], scores))
        if not rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["item", "doc_id", "score"])
        item = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
        doc = np.concatenate([r[1] for r in rows])
        return pa.table([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=doc == no_id), pa.array(np.concatenate([r[2] for r in rows]))], names=["item", "doc_id", "score"])

    parts = min(shards, base.partitions(spark))
    return held.repartition(parts, "shard").groupBy("shard").applyInArrow(search, "item long, doc_id long, score long")
