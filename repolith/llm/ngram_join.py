"""Jaccard join of word shingles by parity sketches.

A document's shingles set bits of a long sketch by exclusive or, so two sketches differ in at most as
many bits as the sets differ in elements. For two sets of sizes s and t that reach the similarity, that
difference is bounded by d(s + t). Sizes fall into bands; a pair that reaches the similarity lies in
one band or in two that follow each other, so each document takes part in the scheme of its own band and of
the one below. A scheme cuts its sketch into d + 1 + e blocks: with d bits to differ in, 1 + e blocks
are equal. All blocks have one order: empty ones, those of one bit, then all others, each by the number of sets that
send them, the commonest first. Every set leaves out the first e of its blocks in that order, so of the 1 + e that two sets share
the last is left out by neither. What a phrase in many texts or an empty block has in common joins nothing that way.
Documents that share a block are candidates; no pair that reaches the similarity is lost.

Candidates are not spelled out as pairs. A block's documents go to the first of them: all that share some block with the
same first document meet once, with their sizes and sketches of the whole sets, in tiles of two parts where they are many.
A sketch has two bits for each element or more, so that large sets do not look alike. Of the pairs
that sizes and sketches admit a task returns a forest, and the components of these are families, outside of which no
pair exists. A family's members meet with their texts, again in tiles, and what is not joined yet and not ruled out by
sketches is verified on the sets themselves. A task returns links that join its members, at most one for each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm import base
from repolith.llm.components import components

#: Sketch bits of a block: so many that different runs hardly meet by chance, as only bits that are set are kept.
BLOCK_BITS = 1 << 32
#: Hundredths of the bits to differ in that a scheme has more blocks for, which sets may leave out.
SPARE = 40
#: Last bits of a key: whether its scheme is odd, and how many bits its block holds, two for all above.
ODD, KIND = 4, 3
#: Bits of the sketch of a whole set, at least.
SHORT_BITS = 2048
#: Documents with such sketches that meet in one cell, on a side, and that a task handles together; fewer with longer ones.
BLOCK_PART, BUCKET_ROWS = 8192, 1 << 16
#: Shingles of a family that one tile may hold on a side, about: some 7 MB of text, sent once for each such part of the family.
TILE_SHINGLES = 1 << 20
#: Members of families that are broadcast to fetch their texts; of more, all texts go through an exchange.
BROADCAST_MEMBERS = 1 << 20


class Similarity:
    """The rule ``100 * intersection >= percent * union`` in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def difference(self, total: int | np.ndarray):
        """Most elements in which two sets may differ whose sizes add up to ``total``."""
        return total - 2 * -(-self.percent * total // (100 + self.percent))

    def largest(self, size: int) -> int:
        """Size of the largest partner."""
        return 100 * size // self.percent

    def sizes_admit(self, size: int, others: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(size, others) >= self.percent * np.maximum(size, others)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


@lru_cache(maxsize=4)
def band_starts(percent: int, limit: int = 1 << 40) -> np.ndarray:
    starts = [1]
    while starts[-1] < limit:
        starts.append(100 * starts[-1] // percent + 1)
    return np.array(starts)


@lru_cache(maxsize=4096)
def scheme(percent: int, band: int) -> tuple[int, int]:
    """Blocks of a band's scheme, and how many of them a set leaves out."""
    rule, starts = Similarity(percent), band_starts(percent)
    low, high = int(starts[band]), int(starts[band + 1]) - 1
    top = high + rule.largest(high)
    differ = max(int(rule.difference(total)) for total in range(max(2 * low, top - 100), top + 1))
    spare = -(-SPARE * differ // 100) + 2 if differ else 0
    return differ + 1 + spare, spare


def shingles(text: str, hashes: base.WordHashes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``n`` words; of fewer words, one for the whole sequence."""
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    values = hashes.array(words)
    return np.unique(base.gram_hashes(values, n) if len(values) >= n else base.gram_hashes(values, len(values), seed=100 + len(values)))


def blocks_sent(shingle_hashes: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """Keys of the sketch blocks that a set sends, for both of its schemes, and ``4 * more + kind`` for even and for odd ones.

    Kinds of which all blocks are left out are not sent; of the next ``kind``, the commonest ``more`` are still to be left out.
    """
    band = int(np.searchsorted(band_starts(percent), len(shingle_hashes), side="right")) - 1
    out, left = [], [0, 0]
    for s in (band, band - 1) if band else (band,):
        blocks, spare = scheme(percent, s)
        block = ((shingle_hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        bit, times = np.unique(block * np.uint64(BLOCK_BITS) + shingle_hashes % np.uint64(BLOCK_BITS), return_counts=True)
        bit = bit[times % 2 == 1]
        block = (bit // np.uint64(BLOCK_BITS)).astype(np.int64)
        values, weight = np.zeros(blocks, np.uint64), np.bincount(block, minlength=blocks)
        if len(bit):
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            values[block[first]] = np.bitwise_xor.reduceat(base.mix(bit), first)
        kind, more, of_kind = 0, spare, np.bincount(np.minimum(weight, 2), minlength=3).tolist()
        while kind < 2 and of_kind[kind] <= more:
            more -= of_kind[kind]
            kind += 1
        sent = np.flatnonzero(weight >= kind)
        left[s % 2] = 4 * more + kind
        marks = (np.minimum(weight[sent], 2) + ODD * (s % 2)).astype(np.uint64)
        keys = base.mix(values[sent] ^ base.mix(sent.astype(np.uint64) | np.uint64(s + 1 << 40)))
        out.append(keys & ~np.uint64(ODD | KIND) | marks)
    return np.concatenate(out), left


def block_keys(shingle_hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the sketch blocks that a set sends, for both of its schemes."""
    return blocks_sent(shingle_hashes, percent)[0]


def parity(shingle_hashes: np.ndarray) -> bytes:
    """Sketch of a whole set, packed; its length follows the set's size."""
    bits = max(SHORT_BITS, base.two_to_the(2 * len(shingle_hashes)))
    odd = np.bincount((shingle_hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of some sets. Two differ in at most as many bits as the sets in elements, also when the longer is folded to the shorter."""

    def __init__(self, packed: list[bytes]):
        self.length = np.array([len(p) // 8 for p in packed], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in np.unique(self.length).tolist():
            rows = np.flatnonzero(self.length >= length)
            place, table = np.zeros(len(packed), np.int64), np.empty((len(rows), length), np.uint64)
            place[rows] = np.arange(len(rows))
            for row, i in zip(table, rows.tolist(), strict=True):
                row[:] = np.bitwise_xor.reduce(np.frombuffer(packed[i], np.uint64).reshape(-1, length))
            self.folded[length] = place, table

    def differ(self, i: int, others: np.ndarray) -> np.ndarray:
        """Bits in which the sketch of ``i`` differs from others."""
        out, length = np.empty(len(others), np.int64), np.minimum(self.length[others], self.length[i])
        for n in np.unique(length).tolist():
            place, table = self.folded[n]
            same = length == n
            out[same] = np.bitwise_count(table[place[others[same]]] ^ table[place[i]]).sum(1, dtype=np.int64)
        return out


def sketched(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """doc_id, h, n_shingles, node, keys, left, sketch. Equal sets have the same ``node``."""

    @base.lean("ngram_join")
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = base.WordHashes()
        for batch in base.pieces(batches):
            sets = [shingles(text, hashes, n) for text in batch["text"].to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            node = np.array([base.mix(np.array([s.sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0] for s in sets], np.uint64)
            keys, left = zip(*(blocks_sent(s, percent) if len(s) else (None, None) for s in sets))
            keys = pa.array([k if k is None else k.view(np.int64) for k in keys], pa.list_(pa.int64()))
            short = pa.array([parity(s) if len(s) else None for s in sets], pa.binary())
            columns = [batch["doc_id"], batch["h"], pa.array(size), base.signed(node), keys, pa.array(left, pa.list_(pa.int32())), short]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n_shingles", "node", "keys", "left", "sketch"])

    return docs.select("doc_id", "h", "text").mapInArrow(scan, "doc_id long, h long, n_shingles long, node long, keys array<long>, left array<int>, sketch binary")


def forest(rule: Similarity, size: np.ndarray, sketches: Sketches, side: np.ndarray, across: bool) -> Iterator[tuple[int, int]]:
    """Links that join all members whose sizes and sketches admit a pair; between the two sides only if ``across``."""
    root, everyone = np.arange(len(size)), np.arange(len(size))
    for i in everyone.tolist():
        others = everyone[:i]
        others = others[(root[others] != root[i]) & ((side[others] != side[i]) | (not across))]
        # most pairs go by their sizes alone
        others = others[rule.sizes_admit(size[i], size[others])]
        others = others[sketches.differ(i, others) <= rule.difference(size[i] + size[others])]
        for r in np.unique(root[others]).tolist():
            yield i, int(others[root[others] == r][0])
            root[root == r] = root[i]


def shared_keys(nodes: DataFrame) -> DataFrame:
    """key, node of the keys that several of ``nodes`` send, without those that a set leaves out as its commonest."""
    # most keys are of one document: those go in the one exchange of all keys, as rows that are sorted and may spill
    sent = nodes.select("node", F.explode("keys").alias("key"))
    common = base.stage(sent.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1"), "common")
    odd, kind = F.col("key").bitwiseAND(ODD), F.col("key").bitwiseAND(KIND)
    own = Window.partitionBy("node", "odd").orderBy("kind", F.desc("n"), "key")
    ranked = common.select("node", "key", "n", odd.alias("odd"), kind.alias("kind")).withColumn("rank", F.row_number().over(own))
    left = F.when(F.col("odd") == 0, F.col("left")[0]).otherwise(F.col("left")[1])
    ranked = ranked.join(nodes.select("node", "left"), "node").withColumn("left", left)
    goes = (F.col("kind") == F.col("left").bitwiseAND(3)) & (F.col("rank") <= F.shiftright("left", 2))
    out = ranked.filter(~goes).select("key", "node")
    out.staged_inputs = [common]
    return out


def admitted(nodes: DataFrame, percent: int, block_part: int = BLOCK_PART) -> DataFrame:
    """u, v: links between documents of ``nodes`` whose sizes and sketches admit a pair and that share a block, or each one with the first of its documents.

    All documents that share a block and admit a pair are joined by them.
    """
    rule, spark = Similarity(percent), nodes.sparkSession
    by_key = Window.partitionBy("key").orderBy("node")
    first = F.first("node").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    alone = F.lag("node").over(by_key).isNull() & F.lead("node").over(by_key).isNull()
    kept = shared_keys(nodes)
    shared = kept.select("node", first.alias("first"), alone.alias("alone"))
    # near copies share many blocks, most of them with the same first document
    shared = base.stage(shared.filter("not alone").select("first", "node").distinct(), "shared")
    base.drop_staged(*kept.staged_inputs)
    groups = shared.join(nodes.select("node", F.octet_length("sketch").alias("n_bytes")), "node").groupBy("first").agg(F.sum("n_bytes").alias("n_bytes"))
    groups = groups.select("first", "n_bytes", F.ceil(F.col("n_bytes") * 8 / (SHORT_BITS * block_part)).cast("int").alias("parts"))
    groups = base.stage(groups, "keys")
    total = groups.agg(F.sum(F.col("n_bytes") * F.col("parts"))).first()[0] or 0
    members = shared.join(groups, "first")
    parts, own = F.col("parts"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(F.least(p, own).alias("low"), F.greatest(p, own).alias("high")))
    dealt = members.select("first", "node", own.alias("part"), F.inline(cells))
    buckets = max(base.partitions(spark), total // (BUCKET_ROWS * SHORT_BITS // 8))
    bucket = F.pmod(F.xxhash64("first", "low", "high"), F.lit(buckets)).alias("bucket")
    rows = dealt.join(nodes.select("node", "n_shingles", "sketch"), "node").select(bucket, "first", "low", "high", "part", "node", "n_shingles", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending"), ("low", "ascending"), ("high", "ascending"), ("node", "ascending")]).combine_chunks()
        first, low, high, part, node, size = (table[c].to_numpy() for c in ("first", "low", "high", "part", "node", "n_shingles"))
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        edges = np.append(np.flatnonzero(new), len(node)).tolist()
        found: list[tuple[int, int]] = []
        for begin, end in zip(edges, edges[1:]):
            some = slice(begin, end)
            sizes, sketches, across = size[some], Sketches(table["sketch"][some].to_pylist()), bool(low[begin] < high[begin])
            others = np.arange(1, end - begin)
            whole = not across and rule.sizes_admit(sizes[0], sizes[1:]).all() and (sketches.differ(0, others) <= rule.difference(sizes[0] + sizes[1:])).all()
            pairs = ((i, 0) for i in others.tolist()) if whole else forest(rule, sizes, sketches, part[some] == high[begin], across)
            found.extend((int(node[begin + i]), int(node[begin + j])) for i, j in pairs)
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    out = rows.repartition(base.partitions(spark), "bucket").groupBy("bucket").applyInArrow(compare, "u long, v long").distinct()
    out.staged_inputs = [shared, groups]
    return out


class Tile:
    """Members of a family that are compared in one task."""

    def __init__(self, rule: Similarity, nodes: list[int], sets: list[np.ndarray]):
        self.rule, self.nodes, self.sets = rule, np.array(nodes), sets
        self.size = np.array([len(s) for s in sets])
        self.sketches = Sketches([parity(s) for s in sets])
        self.root = np.arange(len(sets))

    def compare(self, i: int, others: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links between member ``i`` and others of components that it is not yet in."""
        others = others[(self.root[others] != self.root[i]) & self.rule.sizes_admit(self.size[i], self.size[others])]
        differ = self.sketches.differ(i, others)
        bound = self.rule.difference(self.size[others] + self.size[i])
        others, differ = others[differ <= bound], differ[differ <= bound]
        for j in others[np.argsort(differ, kind="stable")].tolist():
            if self.root[j] != self.root[i] and self.rule.linked(self.sets[i], self.sets[j]):
                yield int(self.nodes[i]), int(self.nodes[j])
                self.root[self.root == self.root[j]] = self.root[i]


def member_texts(docs: DataFrame, sized: DataFrame, tile: int, broadcast_members: int = BROADCAST_MEMBERS) -> DataFrame:
    """component, node, part, parts, text of ``sized (node, component, doc_id, h, n_shingles)``; a family's parts hold about ``tile`` shingles each.

    Most documents are in no family, so their texts are not dealt where the members can be broadcast.
    """
    parts = sized.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") / tile)).cast("int").alias("parts"))
    members = sized.join(parts, "component").withColumn("part", F.pmod(F.xxhash64(F.col("node")), F.col("parts")).cast("int"))
    few = sized.limit(broadcast_members + 1).count() <= broadcast_members
    members = F.broadcast(members) if few else members
    texts = docs.alias("d").join(members.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.h") == F.col("m.h")))
    return texts.dropDuplicates(["node"]).select("component", "node", "part", "parts", "text")


def links(docs: DataFrame, nodes: DataFrame, percent: int, n: int, tile: int) -> DataFrame:
    """u, v: links that hold together all documents of ``nodes (node, doc_id, h, n_shingles, keys, left, sketch)`` that are linked.

    ``nodes`` is a staged table; its files are deleted once the families are known, as keys take more room than texts.
    """
    rule = Similarity(percent)
    near = admitted(nodes, percent)
    families = base.stage(components(near), "families")
    sized = base.stage(families.join(nodes.select("node", "doc_id", "h", "n_shingles"), "node"), "members")
    base.drop_staged(nodes, families, *near.staged_inputs)

    texts = member_texts(docs, sized, tile)
    # every two parts of a family meet once, and every part with itself
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, "part").alias("low"), F.greatest(p, "part").alias("high")))
    tiles = texts.withColumn("t", F.explode(pairs)).select("component", "t.low", "t.high", "node", "part", "text")

    def compare(table: pa.Table) -> pa.Table:
        hashes = base.WordHashes()
        found: list[tuple[int, int]] = []
        table = table.sort_by("node")
        made = Tile(rule, table["node"].to_pylist(), [shingles(t, hashes, n) for t in table["text"].to_pylist()])
        part, low, high = (table[c].to_numpy() for c in ("part", "low", "high"))
        everyone = np.arange(len(made.sets))
        for i in everyone.tolist():
            others = everyone[:i] if low[i] == high[i] else everyone[part == high[i]] if part[i] == low[i] else everyone[:0]
            found.extend(made.compare(i, others))
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return tiles.groupBy("component", "low", "high").applyInArrow(compare, "u long, v long")


def similar_documents(docs: DataFrame, percent: int, n: int, tile: int = TILE_SHINGLES) -> DataFrame:
    """doc_id, h, n_shingles, component, component_id for each row of ``docs (doc_id, text)``; ``h`` is a hash of the text.

    Texts in lower case (A-Z) are sets of runs of ``n`` words; two are linked when their intersection is at
    least ``percent`` hundredths of their union. ``component_id`` is the smallest doc_id that links
    reach, ``component`` a number of its own, null where there is no shingle. A text of fewer words is one shingle, the whole of it; a null text or one without words
    has none and is linked with nothing. Rows of equal sets are linked; ids may be null or repeat, and a
    component without any id has a null one. Other columns are ignored. An empty table gives an
    empty result.

    Equal sets are one node from the start, named by a 64-bit hash of the set.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = base.stage(sketched(rows, percent, n), "sketches")
    each = base.stage(found.select("doc_id", "h", "n_shingles", "node"), "documents")
    first = F.min(F.struct("doc_id", "h")).alias("at")
    nodes = found.filter("n_shingles > 0").groupBy("node").agg(first, *(F.first(c).alias(c) for c in ("n_shingles", "keys", "left", "sketch")))
    nodes = base.stage(nodes.select("node", "at.doc_id", "at.h", "n_shingles", "keys", "left", "sketch"), "nodes")
    base.drop_staged(found)
    joined = components(links(rows, nodes, percent, n, tile))

    named = each.filter("n_shingles > 0").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    columns = ("doc_id", "h", "n_shingles", "component", "component_id")
    out = named.join(smallest, "component").select(*columns)
    alone = each.filter("n_shingles = 0").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return out.union(alone.select(*columns))


def one_of_each(docs: DataFrame, percent: int, n: int, tile: int = TILE_SHINGLES) -> DataFrame:
    """Rows of ``docs`` without all but one of each group: that of the smallest (doc_id, text hash) stays.

    Of rows alike in doc_id and text one stays; documents without words all stay.
    """
    found = similar_documents(docs, percent, n, tile)
    stays = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("at")).select("at.doc_id", "at.h").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    wordless = ~F.coalesce("_row.text", F.lit("")).rlike(base.WORD)
    first = keyed.filter(~wordless).join(stays, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")), "left_semi").dropDuplicates(["_id", "_h"])
    return first.unionByName(keyed.filter(wordless)).select("_row.*")
