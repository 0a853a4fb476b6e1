"""Token ids as directly addressable codes.

Documents are put in ascending ``doc_id`` order by a range partition, encoded, and their ids written
as segments. A segment holds the ids of whole documents, a few hundred thousand at most unless one
document is longer. Its payload stores the ids in levels of ``bits`` bits each: level 0 has the low
chunk of every id and a bitmap that says whether an id goes on; level 1 has the next chunk of those
that go on, in the same order, and so on. A directory holds the set bits before every block of 512,
so the place of an id's next chunk is one directory entry and a count inside one block: any id is read
without decoding its neighbours.

Payload: header ``n_levels, bits``, then per level ``n``, chunks, bitmap bytes, directory (uint32).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.llm import base

#: Ids of a segment, unless one document has more.
SEGMENT_IDS = 1 << 18
BLOCK = 512
END_ID = 0
SEGMENTS = "shard int, seq long, first long, n_ids long, payload binary, doc_ids array<long>, doc_first array<long>, doc_n array<long>"


# ---- payload ----------------------------------------------------------------------------------


def pack(ids: np.ndarray, bits: int = 8) -> bytes:
    """Payload of an array of ids."""
    dtype = {8: np.uint8, 16: np.uint16}[bits]
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(bits)
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bitmap.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
        rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32) if len(ones) else ones
        chunks = (rest & np.uint32((1 << bits) - 1)).astype(dtype)
        levels.append(struct.pack("<I", len(rest)) + chunks.tobytes() + bitmap.tobytes() + rank.tobytes())
        if not goes_on.any():
            return struct.pack("<BB", len(levels), bits) + b"".join(levels)
        rest = more[goes_on]


def _levels(payload: bytes) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Bits, and of each level its ids and the offsets of chunks, bitmap and directory."""
    n_levels, bits = struct.unpack_from("<BB", payload)
    at, out = 2, []
    for _ in range(n_levels):
        (n,) = struct.unpack_from("<I", payload, at)
        chunks = at + 4
        bitmap = chunks + n * bits // 8
        blocks = -(-n // BLOCK)
        rank = bitmap + blocks * BLOCK // 8
        out.append((n, chunks, bitmap, rank))
        at = rank + 4 * blocks
    return bits, out


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a payload."""
    bits, levels = _levels(payload)
    dtype = {8: np.uint8, 16: np.uint16}[bits]
    value = np.empty(0, np.uint32)
    for n, chunks, bitmap, rank in reversed(levels):
        low = np.frombuffer(payload, dtype, n, chunks).astype(np.uint32)
        goes_on = np.unpackbits(np.frombuffer(payload, np.uint8, rank - bitmap, bitmap), count=n, bitorder="little").astype(bool)
        low[goes_on] |= value << np.uint32(bits)
        value = low
    return value


def token_at(payload: bytes, i: int) -> int:
    """The ``i``-th id of a payload, by rank alone."""
    bits, levels = _levels(payload)
    if not 0 <= i < levels[0][0]:
        raise IndexError(i)
    value = shift = 0
    for n, chunks, bitmap, rank in levels:
        width = bits // 8
        value |= int.from_bytes(payload[chunks + i * width : chunks + (i + 1) * width], "little") << shift
        if not payload[bitmap + i // 8] >> (i % 8) & 1:
            return value
        block = i // BLOCK
        inside = payload[bitmap + block * BLOCK // 8 : bitmap + i // 8] + bytes([payload[bitmap + i // 8] & ((1 << i % 8) - 1)])
        i = struct.unpack_from("<I", payload, rank + 4 * block)[0] + int.from_bytes(inside, "little").bit_count()
        shift += bits
    raise ValueError("payload ends inside an id")


# ---- encoding ---------------------------------------------------------------------------------

#: Text whose pieces are numbered together, about.
ENCODED_BYTES = 1 << 22
_WORD_SPACE = re.compile(r" (?=\S)")
#: White space as Python knows it; texts where it runs together or stands at an end; pieces without any and with a line break first.
_SPACE = r"\t-\r\x1c-\x20\x{85}\pZ"
_LOOSE = rf"[{_SPACE}][{_SPACE}]|\A[{_SPACE}]|[{_SPACE}]\z"
_PLAIN, _BROKEN, _ENDED = rf"\A[^{_SPACE}]+\z", rf"\A\n[^{_SPACE}]+\z", r"\A\pL+[,.]\z"
_MARKS = (",", ".")


class Ids:
    """Ids of pieces, one after the other."""

    def __init__(self, lists: list[list[int]]):
        self.ids, self.length = np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))
        self.added: list[tuple[np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return len(self.length) + sum(len(length) for _, length in self.added)

    def add(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.added.append((ids, length))

    def joined(self, other: Ids) -> Ids:
        """These and then the others'."""
        self.ids, self.length = (np.concatenate(parts) for parts in zip((self.ids, self.length), *self.added))
        self.added, out = [], Ids([])
        out.ids, out.length = np.concatenate([self.ids, other.ids]), np.concatenate([self.length, other.length])
        return out

    def copies(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places, one after the other, and where each ends."""
        taken, begin = self.length[place], np.cumsum(self.length) - self.length
        ends = np.cumsum(taken)
        return self.ids[np.arange(taken.sum()) + np.repeat(begin[place] - (ends - taken), taken)], ends


class Encoder:
    """Ids of whole texts, equal to encoding each text in one call.

    The vocabulary's rule never joins a space that a word follows to what stands before it, and a line
    break between two words is a token of its own. Texts are cut there, and every distinct piece is
    encoded once by the library. Where white space runs together, a text is cut only before a single
    space that a word follows. The words of a text are numbered by Arrow, so no object is made for each.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        alone = self.ids(["\n"])[0]
        self.line_break = alone[0] if len(alone) == 1 else None
        self.marks = Ids(self.ids(list(_MARKS)))
        self.known: dict[str, int] = {}
        self.held = Ids([])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, texts: pa.LargeStringArray) -> pa.LargeListArray:
        """Pieces of each text; each but the first had a space before it, unless it starts with a line break."""
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        loose = pc.match_substring_regex(texts, _LOOSE)
        if not pc.any(loose).as_py():
            return pieces
        other = pa.array([_WORD_SPACE.split(t) for t in pc.filter(texts, loose).to_pylist()], pieces.type)
        where = np.arange(len(texts))
        where[loose.to_numpy(zero_copy_only=False)] = len(texts) + np.arange(len(other))
        return pa.concat_arrays([pieces, other]).take(pa.array(where))

    def learn(self, new: pa.LargeStringArray) -> None:
        """Encode new pieces. Those without white space are encoded many in one text, with line breaks between them."""
        kinds = [pc.match_substring_regex(new, rule).to_numpy(zero_copy_only=False) & (self.line_break is not None) for rule in (_PLAIN, _BROKEN)]
        for kind, before in ((kinds[0], "\n "), (kinds[1], "\n")):
            some = new.filter(pa.array(kind)).to_pylist()
            for at in range(0, len(some), 500):
                self._learn_together(some[at : at + 500], before)
        self._learn_each(new.filter(pa.array(~(kinds[0] | kinds[1]))).to_pylist())

    def _learn_together(self, pieces: list[str], before: str) -> None:
        lead = before if before == "\n " else ""
        ids = np.array(self.ids([lead + lead.join(pieces)])[0], np.uint32)
        breaks = np.flatnonzero(ids == self.line_break)
        if len(breaks) != len(pieces):
            return self._learn_each(pieces)
        length = np.diff(np.append(breaks, len(ids)))
        # the break that pieces have themselves is theirs
        self._add(pieces, *((np.delete(ids, breaks), length - 1) if lead else (ids, length)))

    def _learn_each(self, pieces: list[str]) -> None:
        if pieces:
            found = Ids(self.ids([p if p[:1] == "\n" else " " + p for p in pieces]))
            self._add(pieces, found.ids, found.length)

    def _add(self, pieces: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.held.add(ids, length)

    def numbers(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """Place of each of the distinct pieces among the known ones."""
        if len(self.known) > self.limit:
            self.known, self.held = {}, Ids([])
        names = pieces.to_pylist()
        number = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        unknown = number < 0
        new = pieces.filter(pa.array(unknown))
        ended = pc.match_substring_regex(new, _ENDED)
        self.learn(new.filter(pc.invert(ended)))
        # letters and a last comma or full stop are tokens apart, so the letters are encoded once for all
        ended = new.filter(ended).to_pylist()
        stems = [p[:-1] for p in ended]
        self.learn(pa.array([p for p in dict.fromkeys(stems) if p not in self.known], pa.large_string()))
        if ended:
            both = np.empty(2 * len(ended), np.int64)
            both[::2] = np.fromiter(map(self.known.__getitem__, stems), np.int64, len(stems))
            both[1::2] = len(self.held) + np.fromiter((_MARKS.index(p[-1]) for p in ended), np.int64, len(ended))
            ids, ends = self.held.joined(self.marks).copies(both)
            self._add(ended, ids, np.diff(ends[1::2], prepend=0))
        number[unknown] = np.fromiter(map(self.known.__getitem__, new.to_pylist()), np.int64, len(new))
        return number

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian uint32."""
        if not texts:
            return []
        cuts = self.cut(pa.array(texts, pa.large_string()))
        # what stands first in a text had no space before it
        offsets = cuts.offsets.to_numpy() - cuts.offsets[0].as_py()
        words, first = cuts.flatten(), np.zeros(offsets[-1], bool)
        first[offsets[:-1]] = True
        heads = self.ids(words.take(pa.array(offsets[:-1])).to_pylist())
        coded = words.filter(pa.array(~first)).dictionary_encode()
        # the words are as large as the texts and not needed while their pieces are numbered
        del cuts, words
        number = self.numbers(coded.dictionary)
        place = np.empty(len(first), np.int64)
        place[first], place[~first] = len(self.held) + np.arange(len(heads)), number[coded.indices.to_numpy()]
        del coded, number
        ids, ends = self.held.joined(Ids(heads)).copies(place)
        raw, edges = ids.tobytes(), (4 * np.append(0, ends)[offsets]).tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:])]


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    encoders = base.kept("token_codes")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


# ---- files ------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, bits: int = 8) -> None:
    """Encode ``docs (doc_id, text)`` and write the segments to ``path`` in ascending ``doc_id`` order.

    A null text is empty; a null ``doc_id`` comes first; repeated ids stay, ordered by a hash of the
    text. Other columns are ignored. The range partition is on (doc_id, hash), so many rows of one id
    are still dealt out. ``tokenizer`` is a vocabulary file that every executor has at this place.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text"))
    parts = max(base.partitions(spark), 2 * spark.sparkContext.defaultParallelism)
    ordered = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    @base.lean("token_codes")
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq, first, code = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer)
        end = struct.pack("<I", end_id)
        raw: list[bytes] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raw), np.uint32)
            begins = (np.cumsum(sizes) - sizes + first).tolist()
            row = {"shard": [shard], "seq": [seq], "first": [first], "n_ids": [len(ids)], "payload": [pack(ids, bits)], "doc_ids": [doc_ids], "doc_first": [begins], "doc_n": [sizes]}
            return pa.RecordBatch.from_pydict(row, schema=_SCHEMA)

        for batch in base.large_pieces(batches, ENCODED_BYTES):
            ids = batch["doc_id"].to_pylist()
            for doc_id, code_bytes in zip(ids, code.encode(batch["text"].to_pylist()), strict=True):
                raw.append(code_bytes + end)
                doc_ids.append(doc_id)
                sizes.append(len(raw[-1]) // 4)
                if sum(sizes[-1:]) >= segment_ids or (len(raw) % 64 == 0 and sum(sizes) >= segment_ids):
                    yield segment()
                    seq, first = seq + 1, first + sum(sizes)
                    raw, doc_ids, sizes = [], [], []
        if raw:
            yield segment()

    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("seq", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]
    + [(name, pa.list_(pa.int64())) for name in ("doc_ids", "doc_first", "doc_n")]
)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``base``, the ids of all shards before theirs. The sums run over one row per shard."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    return segments.join(F.broadcast(shards), "shard")  # a row for each file of the writing job


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard, seq."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.pieces(batches, 1):
            row = {k: v[0] for k, v in batch.to_pydict().items()}
            raw, at = unpack(row["payload"]).tobytes(), row["first"]
            crc = [zlib.crc32(raw[4 * (f - at) : 4 * (f - at + n)]) for f, n in zip(row["doc_first"], row["doc_n"], strict=True)]
            n = len(crc)
            out = {"doc_id": row["doc_ids"], "start": [row["base"] + f for f in row["doc_first"]], "n_tokens": row["doc_n"], "ids_crc32": crc, "shard": [row["shard"]] * n, "seq": [row["seq"]] * n}
            types = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return read_segments(spark, path).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, seq long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.pieces(batches, 1):
            row = {k: v[0] for k, v in batch.to_pydict().items()}
            ids, at = unpack(row["payload"]).astype(np.int32), row["first"]
            parts = [ids[f - at : f - at + n] for f, n in zip(row["doc_first"], row["doc_n"], strict=True)]
            starts = [row["base"] + f for f in row["doc_first"]]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return read_segments(spark, path).mapInArrow(documents, "doc_id long, start long, ids array<int>")


def lookup(positions: DataFrame, path: str, span: int = 1 << 16) -> DataFrame:
    """``positions (pos)`` with the id at each global place, read by rank: pos, token.

    A segment names the spans of ``span`` places it covers, so the match is an equi-join. Positions
    outside the files are left out; repeated ones are answered each.
    """
    spark = positions.sparkSession
    begin = F.col("base") + F.col("first")
    covered = read_segments(spark, path).filter("n_ids > 0").select(
        begin.alias("begin"), "n_ids", "payload",
        F.explode(F.sequence(F.floor(begin / span), F.floor((begin + F.col("n_ids") - 1) / span))).alias("span"),
    )
    asked = positions.select("pos", F.floor(F.col("pos") / span).alias("span"))
    found = asked.join(covered, "span").filter((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("begin") + F.col("n_ids")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (p - b for p, b in zip(batch["pos"].to_pylist(), batch["begin"].to_pylist(), strict=True))
            tokens = [token_at(p.as_buffer().to_pybytes(), i) for p, i in zip(batch["payload"], at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["pos"].cast(pa.int64()), pa.array(tokens, pa.int32())], names=["pos", "token"])

    return found.select("pos", "begin", "payload").mapInArrow(read, "pos long, token int")


def encode_documents(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the files of ``docs`` and return what :func:`read_documents` finds in them."""
    spark = docs.sparkSession
    path = path or base.new_folder(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_documents(spark, path)
