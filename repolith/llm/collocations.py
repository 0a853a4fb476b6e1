"""Collocations from an index of word ids per shard.

The words of a shard of documents become numbers, and the text a sequence of them with breaks between pieces.
An index sorts the places of the sequence by their first word; the column of preceding words is its Burrows-Wheeler
transform. A step of backward extension sorts the rows of all phrases by their preceding word, stably, so each
run of equal (word, phrase) is the interval of a longer phrase and its length the count. The index of the
reversed sequence gives the same for following words. Steps are taken to the wanted depth only, so no suffix
is ordered beyond it.

Counts of all shards are summed. A frequent phrase has frequent parts, so after every step the places of a shard
are renamed by the phrases that are frequent over all shards: two neighbouring names are then a phrase that is
a word longer, and the next step is the same again. The phrases of a shard travel in hash buckets, packed; a bucket sums
the counts of all shards, names the frequent phrases and tells the shards that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.ranking import top_k
from repolith.llm import base

#: Words of a shard, about; a longer text is a shard of its own.
SHARD_WORDS = 1 << 19
#: Words of a row of a shard.
CHUNK_WORDS = 1 << 15
#: Words whose phrases meet in one bucket, about.
BUCKET_WORDS = 1 << 20

_BREAK = b"\xff"  # in no UTF-8 text
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_BREAKS + bytes(range(65, 91)), _BREAK * len(_BREAKS) + bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    """Words of a text in lower case (A-Z), with a break for each separator."""
    return (text or "").encode().translate(_TABLE).replace(_BREAK, b" \xff ").split()


class Shard:
    """Words of one language as numbers from 1, by first occurrence; 0 breaks."""

    def __init__(self):
        self.ids: dict[bytes, int] = {_BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        found = words(text)
        ids = self.ids
        for word in dict.fromkeys(found):
            if word not in ids:
                ids[word] = len(ids)
        numbers = np.fromiter(map(ids.__getitem__, found), np.int32, len(found))
        self.parts.append(np.append(numbers, np.int32(0)))
        self.size += len(found) + 1


def build_shards(docs: DataFrame, shard_words: int, chunk_words: int) -> DataFrame:
    """lang, shard, at, word, n, text: the counted words of shards, ``at`` their numbers, and texts in rows of bounded size, ``at`` a place.

    No text is shuffled.
    """
    fields = {"lang": pa.string(), "shard": pa.int64(), "at": pa.int64(), "word": pa.string(), "n": pa.int64(), "text": pa.list_(pa.int64())}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, filling = TaskContext.get().partitionId(), 0, {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            shard, number = filling.pop(lang), task << 32 | made
            made += 1
            text = np.concatenate(shard.parts)
            counts = np.bincount(text, minlength=len(shard.ids))
            held = [w.decode() for w in list(shard.ids)[1:]]
            for at in range(0, len(held), chunk_words):
                some = held[at : at + chunk_words]
                numbers = np.arange(at + 1, at + 1 + len(some))
                yield _rows(fields, len(some), lang=lang, shard=number, at=numbers, word=some, n=counts[numbers])
            for at in range(0, len(text), chunk_words):
                yield _rows(fields, 1, lang=lang, shard=number, at=[at], text=[text[at : at + chunk_words].astype(np.int64)])

        for batch in base.pieces(batches):
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                shard = filling.setdefault(lang, Shard())
                shard.add(text)
                if shard.size >= shard_words:
                    yield from close(lang)
        for lang in list(filling):
            yield from close(lang)

    rows = base.spread(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text")), ["lang", "text"])
    return rows.mapInArrow(scan, "lang string, shard long, at long, word string, n long, text array<long>")


def _rows(fields: dict[str, pa.DataType], count: int, **values) -> pa.RecordBatch:
    """A batch of ``count`` rows: single values are repeated, columns without any are null."""
    arrays = []
    for name, kind in fields.items():
        value = values.get(name)
        if value is None:
            arrays.append(pa.nulls(count, kind))
        elif isinstance(value, (str, int)):
            arrays.append(pa.repeat(pa.scalar(value, kind), count))
        else:
            arrays.append(pa.array(value, kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


class Index:
    """Places of a sequence of names sorted by name, each beside the name before it; 0 names nothing."""

    def __init__(self, text: np.ndarray):
        self.names, compact = np.unique(np.append(text, 0), return_inverse=True)
        zero = int(np.searchsorted(self.names, 0))
        self.text = compact.ravel()
        places = np.flatnonzero(self.text != zero)
        rows = places[np.argsort(self.text[places], kind="stable")]
        # the transform: what stands before each row; the place before the first one is the appended 0
        self.before, self.here, self.zero = self.text[rows - 1], self.text[rows], zero

    def extensions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every (name before, name) with its count: the intervals after one step of backward extension.

        A stable sort by the name before keeps the order by name, so the rows of a pair follow each other.
        """
        real = np.flatnonzero(self.before != self.zero)
        order = real[np.argsort(self.before[real], kind="stable")]
        x, y = self.before[order], self.here[order]
        if not len(order):
            return x, y, np.empty(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        return self.names[x[first]], self.names[y[first]], np.diff(np.append(first, len(order)))


def rename(text: np.ndarray, x: np.ndarray, y: np.ndarray, name: np.ndarray, pairs: bool) -> np.ndarray:
    """Each place named after what begins there: the name of its pair with the next place, or of itself; 0 for none."""
    names = np.unique(np.concatenate([text, x, y, [0]]))
    width = len(names)
    key = np.searchsorted(names, x) * width + np.searchsorted(names, y)
    order = np.argsort(key)
    key, name = key[order], name[order]
    nothing = np.zeros(len(text), np.int64)
    after = np.append(text[1:], 0) if pairs else nothing
    own = np.searchsorted(names, text) * width + np.searchsorted(names, after)
    if not len(key):
        return nothing
    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
    return np.where(key[at] == own, name[at], 0)


def pack(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs and their counts by byte planes, which compress well: most high bytes are alike."""
    return np.stack([x, y, n]).astype("<i8").view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(3, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[:, :, 0]


def _extend(texts: DataFrame, names: DataFrame, pairs: bool, keep_text: bool, chunk_words: int, buckets: int) -> DataFrame:
    """shard, at, text, pairs: texts by their new names, ``at`` a place, and counted pairs of neighbours, ``at`` a bucket."""
    fields = {"shard": pa.int64(), "at": pa.int64(), "text": pa.list_(pa.int64()), "pairs": pa.binary()}

    def step(texts: pa.Table, names: pa.Table) -> pa.Table:
        if not texts.num_rows or not names.num_rows:
            return pa.Table.from_batches([_rows(fields, 0)])
        shard, texts = texts["shard"][0].as_py(), texts.sort_by("at")
        whole = pa.concat_arrays(texts["text"].chunks).flatten().to_numpy()
        whole = rename(whole, *(names[c].to_numpy() for c in ("old_x", "old_y", "id")), pairs)
        x, y, n = Index(whole).extensions()
        bucket = (base.mix(x.view(np.uint64) * np.uint64(3) ^ base.mix(y)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        filled, first = np.unique(bucket[order], return_index=True)
        ends = np.append(first, len(x))[1:]
        packed = [pack(x[some], y[some], n[some]) for some in (order[i:j] for i, j in zip(first, ends, strict=True))]
        batches = [_rows(fields, len(filled), shard=shard, at=filled, pairs=packed)]
        starts = range(0, len(whole) if keep_text else 0, chunk_words)
        batches.append(_rows(fields, len(starts), shard=shard, at=list(starts), text=[whole[at : at + chunk_words] for at in starts]))
        return pa.Table.from_batches(batches)

    parts = base.partitions(texts.sparkSession)
    names = names.toDF("of", "old_x", "old_y", "id")
    left, right = texts.repartition(parts, "shard").groupBy("shard"), names.repartition(parts, "of").groupBy("of")
    return left.cogroup(right).applyInArrow(step, "shard long, at long, text array<long>, pairs binary")


def _frequent(stepped: DataFrame, min_count: int, tell_shards: bool) -> DataFrame:
    """shard, x, y, id, f: the pairs with ``min_count`` occurrences in all shards, named; for each shard that holds them,
    after one row without a shard.
    """
    fields = dict.fromkeys(("shard", "x", "y", "id", "f"), pa.int64())

    def merge(table: pa.Table) -> pa.Table:
        bucket = table["at"][0].as_py()
        lists = [unpack(p) for p in table["pairs"].to_pylist()]
        shard = np.repeat(table["shard"].to_numpy(), [p.shape[1] for p in lists])
        x, y, n = np.concatenate(lists, axis=1)
        order = np.lexsort((y, x))
        x, y, n, shard = x[order], y[order], n[order], shard[order]
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        size, total = np.diff(np.append(first, len(x))), np.add.reduceat(n, first)
        keep = np.flatnonzero(total >= min_count)
        number = bucket << 36 | np.arange(1, len(keep) + 1)
        out = [_rows(fields, len(keep), x=x[first[keep]], y=y[first[keep]], id=number, f=total[keep])]
        if tell_shards:
            held = np.repeat(total >= min_count, size)
            out.append(_rows(fields, int(held.sum()), shard=shard[held], x=x[held], y=y[held], id=np.repeat(number, size[keep])))
        return pa.Table.from_batches(out)

    packed = stepped.filter("pairs is not null").select("shard", "at", "pairs")
    return packed.repartition(base.partitions(stepped.sparkSession), "at").groupBy("at").applyInArrow(merge, "shard long, x long, y long, id long, f long")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, share: int = 50, k: int = 2000, shard_words: int = SHARD_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``k`` best phrases of 2 to ``max_words`` words of every language.

    Texts in lower case (A-Z) are cut into pieces at ``.,;:!?`` and line breaks, pieces into words at spaces and tabs.
    ``a`` counts all occurrences within pieces, ``n`` all words of the language; ``l`` and ``r`` count the two parts of the
    cut with the lowest ``score``, which is floor(1000000 * a * a / (l * r)); ties go to the shorter first part. Phrases
    with ``a`` below ``min_count`` are left out, and so are those that lie in a longer one, itself frequent, with at least
    ``share`` hundredths of their count. Best score first, then larger ``a``, then the phrase in byte order.

    A null text is empty, a null language is ``und``. Every row counts, repeated ones too; other columns are
    ignored. No phrase, no row. Counts above 10**15 are not supported.
    """
    shards = base.stage(build_shards(docs, shard_words, chunk_words), "shards")
    held = shards.filter("word is not null").select("lang", "shard", "at", "word", "n")
    sizes = base.stage(held.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    buckets = max(base.partitions(docs.sparkSession), (sizes.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS)

    counted = held.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    none = F.array().cast("array<long>")
    number = (F.monotonically_increasing_id() + 1).alias("id")
    grams = base.stage(counted.select("lang", F.col("word").alias("first"), F.col("word").alias("phrase"), "f", none.alias("heads"), none.alias("tails"), number), "words")
    names = held.join(grams.select("lang", F.col("phrase").alias("word"), "id"), ["lang", "word"]).select("shard", "at", F.lit(0).cast("long").alias("y"), "id")
    before, out = shards, None
    for size in range(2, max_words + 1):
        texts = before.filter("text is not null").select("shard", "at", "text")
        stepped = base.stage(_extend(texts, names, size > 2, size < max_words, chunk_words, buckets), "phrases")
        base.drop_staged(before)
        frequent = base.stage(_frequent(stepped, min_count, size < max_words), "frequent")
        longer = base.stage(_joined(frequent.filter("shard is null").select("x", "y", "id", "f"), grams), "grams")
        if size > 2:
            out = _outstanding(grams, longer, share, out)
        names = frequent.filter("shard is not null").select("shard", "x", "y", "id")
        grams, before = longer, stepped
    base.drop_staged(before)
    best = grams if out is None else out.unionByName(grams.select(*out.columns))
    best = _scored(best.join(sizes, "lang"))
    found = top_k(best, k, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")])
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _joined(frequent: DataFrame, grams: DataFrame) -> DataFrame:
    """Phrases (x, y, id, f) with their words and the counts of their parts: ``x`` lacks the last word, ``y`` the first."""
    x = grams.select(F.col("id").alias("x"), "lang", "first", F.array_append("heads", F.col("f")).alias("heads"))
    y = grams.select(F.col("id").alias("y"), F.col("phrase").alias("rest"), F.array_prepend("tails", F.col("f")).alias("tails"))
    both = frequent.join(x, "x").join(y, "y")
    return both.select("x", "y", "id", "lang", "first", F.concat_ws(" ", "first", "rest").alias("phrase"), "f", "heads", "tails")


def _outstanding(grams: DataFrame, longer: DataFrame, share: int, before: DataFrame | None) -> DataFrame:
    """Phrases without those that a phrase one word longer holds too often.

    A phrase longer by more words holds one longer by a word, which is no less frequent.
    """
    extended = longer.select(F.col("x").alias("id"), "f").union(longer.select(F.col("y").alias("id"), "f"))
    extended = extended.groupBy("id").agg(F.max("f").alias("most"))
    kept = grams.join(extended, "id", "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("f")))
    kept = kept.select("lang", "phrase", "f", "heads", "tails")
    return kept if before is None else before.unionByName(kept)


def _scored(rows: DataFrame) -> DataFrame:
    """Phrases with the cut of the lowest score: its parts' counts and the score."""
    big = lambda c: c.cast("decimal(15,0)")
    rows = rows.withColumn("square", F.lit(1_000_000).cast("decimal(7,0)") * big(F.col("f")) * big(F.col("f")))

    def judged(cut: Column, i: Column) -> Column:
        score = F.call_function("div", F.col("square"), big(cut["heads"]) * big(cut["tails"]))
        return F.struct(score.alias("score"), i.alias("at"), cut["heads"].alias("l"), cut["tails"].alias("r"))

    rows = rows.withColumn("cut", F.array_min(F.transform(F.arrays_zip("heads", "tails"), judged)))
    return rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
