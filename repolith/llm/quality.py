"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Tokens are characters, five to an n-gram. A character takes 12 bits (code points from 4096 on share
the upper part), so an n-gram is one long, its context a shift and its suffix a mask: all counts are groupings and
equi-joins on longs, sharded by n-gram. Counts cover all trusted text; the highest order has plain counts,
lower ones the number of different characters seen before. The probability of an n-gram joins its count, the
sums of its context and the probability of its suffix.

The ``MODEL_GRAMS`` commonest n-grams of each order are a table by hash in a file of the shared folder. Where more were seen, all
others lie sorted in files, searched for what the table does not hold: none is left out. Tasks map all these files, so the workers of
a machine share one copy of them, whatever their size. A document's score is its cross-entropy in nats per character;
its perplexity is exp of that. Per language a threshold is set from quantiles of the trusted documents; it
is wider for short texts, by the standard error of their mean.

Junk may well be predictable, and one bad word hardly moves a mean. So a second model is trained on the
rejected labels, and a document also goes for its worst passage, the ``PASSAGE`` characters with the largest
log likelihood ratio of rejected to trusted text, and for the share of words that repeat the word before.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.llm import base
from repolith.sources.logsource import file_system

ORDER = 5
BITS = 12
#: N-grams of each order in a table by hash at most; more are searched for in sorted files.
MODEL_GRAMS = 1 << 22
#: N-grams to a file, about.
REST_ROWS = 1 << 20
#: Trusted ids are sent to all tasks up to this number (32 MB); more are joined by shuffling.
BROADCAST_IDS = 4_000_000
#: A language's own quantiles are used from this many trusted documents on.
OWN_QUANTILES = 50
#: Standard errors by which a mean may exceed the threshold of long texts.
ERRORS = 2.0
#: Characters over which the likelihood ratio is summed.
PASSAGE = 24
#: Bytes of text whose n-grams are looked up together, unless one text is longer.
SCORED_BYTES = 1 << 17
#: Bytes of text whose n-grams are counted together, unless one text is longer.
COUNTED_BYTES = 1 << 21
#: What ``scored`` measures of a text beside its entropy.
MEASURES = ("_spread", "_worst", "_repeats", "_words")
_MASK = (1 << BITS) - 1


def characters(text: str) -> np.ndarray:
    """Symbols of a text after ``ORDER - 1`` line breaks."""
    points = np.frombuffer(("\n" * (ORDER - 1) + text).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where(points <= _MASK, points, 2048 + points % 2048)


def grams(symbols: np.ndarray, n: int = ORDER) -> np.ndarray:
    """Codes of all n-grams that end at a character of the text."""
    count = len(symbols) - ORDER + 1
    code = np.zeros(count, np.int64)
    for i in range(ORDER - n, ORDER):
        code = code << BITS | symbols[i : i + count]
    return code


def gram_counts(texts: DataFrame) -> DataFrame:
    """gram, c: counts of all n-grams of the highest order in ``texts (text)``."""

    @base.lean("quality")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.short_pieces(batches, size=COUNTED_BYTES):
            codes = np.concatenate([grams(characters(t)) for t in batch["text"].to_pylist()])
            codes.sort()
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(codes[first]), pa.array(np.diff(first, append=len(codes)))], names=["gram", "c"])

    return texts.select("text").mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the number of n-grams seen once to four times."""
    n = {r["c"]: r["n"] for r in counts.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [n.get(i, 0) for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    ratio = lambda i: (i + 1) - (i + 2) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0.5
    return tuple(min(i + 0.95, max(0.1, ratio(i))) for i in range(3))


class Table:
    """Keys and float values in a file that tasks map, so that all workers of a machine share it.

    The file has the first row of every bucket, the keys by bucket, and their values.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, path: str):
        self.rows, self.path, self.mapped = len(keys), path, None
        self.bits = int(base.two_to_the(2 * max(8, len(keys)))).bit_length() - 1
        order = np.argsort(bucket := self.bucket(keys), kind="stable")
        first = np.zeros((1 << self.bits) + 1, np.uint32)
        first[1:] = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=1 << self.bits))
        system, path = file_system(path)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            for part in (keys[order].astype(np.int64), first, values[order].astype(np.float32)):
                out.write(part.tobytes())

    def __len__(self) -> int:
        return self.rows

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mapped": None}

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First row of every bucket, keys, values."""
        if self.mapped is None:
            system, path = file_system(self.path)
            if isinstance(system, fs.LocalFileSystem):
                raw = np.memmap(path, np.uint8, "r")
            else:
                with system.open_input_stream(path) as stream:
                    raw = np.frombuffer(stream.read(), np.uint8)
            keys, first = 8 * self.rows, 4 * ((1 << self.bits) + 1)
            self.mapped = raw[keys : keys + first].view(np.uint32), raw[:keys].view(np.int64), raw[keys + first :].view(np.float32)
        return self.mapped


class Rest:
    """Sorted keys and values in files, a range of keys to a file, which a task maps when it first asks for one of its keys."""

    def __init__(self, parts: list[tuple[int, str]]):
        self.first, self.paths = np.array([first for first, _ in parts], np.int64), [path for _, path in parts]
        self.mapped: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mapped": {}}

    def _part(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.mapped:
            system, path = file_system(self.paths[n])
            if not isinstance(system, fs.LocalFileSystem):
                local = f"{tempfile.mkdtemp(prefix='rest-')}/part"
                fs.copy_files(path, local, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
                path = local
            rows = np.memmap(path, _REST, "r")
            self.mapped[n] = rows["key"], rows["value"]
        return self.mapped[n]

    def fill(self, out: np.ndarray, keys: np.ndarray, at: np.ndarray) -> None:
        """Set ``out[at]`` to the values of ``keys[at]`` where there are any."""
        part = np.searchsorted(self.first, keys[at], "right") - 1
        for n in np.unique(part[part >= 0]):
            own, values = self._part(n)
            here = at[part == n]
            place = np.minimum(np.searchsorted(own, keys[here]), len(own) - 1)
            hit = own[place] == keys[here]
            out[here[hit]] = values[place[hit]]


_REST = np.dtype([("key", np.int64), ("value", np.float32)], align=True)


@dataclass
class Model:
    """Per order, lowest first: n-grams and their log probabilities; contexts and their log back-off weights. Of both the commonest, what those not seen have, and the rest."""

    name: str
    grams: list[tuple[Table, float, Rest | None]]
    contexts: list[tuple[Table, float, Rest | None]]


def _capped(count: str) -> Column:
    return F.least(F.col(count), F.lit(10_000))


def _cut(df: DataFrame, count: str, limit: int) -> tuple[int, int]:
    """The count above which at most ``limit`` rows remain, and how many rows do not exceed it."""
    sizes = df.groupBy(_capped(count).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, cut = 0, 0
    for r in sorted(sizes, key=lambda r: -r["c"]):
        if total + r["n"] > limit:
            cut = r["c"]
            break
        total += r["n"]
    return cut, sum(r["n"] for r in sizes) - total


def _commonest(df: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows whose count is high enough that at most ``limit`` remain."""
    return df.filter(_capped(count) > _cut(df, count, limit)[0])


def _tables(df: DataFrame, key: str, value: str, count: str, limit: int, missing: float) -> tuple[Table, float, Rest | None]:
    """The commonest rows in a table, all others sorted in files."""
    cut, rest = _cut(df, count, limit)
    picked = df.select(key, F.col(value).cast("float").alias(value), (_capped(count) > cut).alias("common"))
    common = picked.filter("common").drop("common").toArrow()
    held = Table(common[key].to_numpy(), common[value].to_numpy(), f"{base.new_folder(df.sparkSession, 'model')}/table")
    return held, missing, _rest(picked.filter("not common"), key, value, rest) if rest else None


def _rest(df: DataFrame, key: str, value: str, rows: int) -> Rest:
    folder = base.new_folder(df.sparkSession, "rest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [(b[key].to_numpy(), b[value].to_numpy()) for b in batches if b.num_rows]
        if table:
            part = np.empty(sum(len(k) for k, _ in table), _REST)
            part["key"], part["value"] = (np.concatenate(column) for column in zip(*table))
            part.sort(order="key")
            # every attempt of a task has a file of its own; the one that ends names it
            name = f"{folder}/{uuid.uuid4().hex}"
            system, path = file_system(name)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([int(part["key"][0])]), pa.array([name])], names=["first", "path"])

    dealt = df.select(key, value).repartitionByRange(-(-rows // REST_ROWS), key)
    return Rest(sorted((r["first"], r["path"]) for r in dealt.mapInArrow(write, "first long, path string").collect()))


def train(texts: DataFrame, limit: int = MODEL_GRAMS) -> Model | None:
    """Model of ``texts (text)``; None where they hold no character. Up to ``limit`` n-grams of each order are in one table, all others sorted in files."""
    counts = {ORDER: base.stage(gram_counts(texts), "grams")}
    if not counts[ORDER].head(1):
        return None
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("gram")
        counts[n] = base.stage(counts[n + 1].groupBy(suffix).agg(F.count(F.lit(1)).alias("c")), "grams")
    model = Model(uuid.uuid4().hex, [], [])
    lower = None
    for n in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[n])
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = counts[n].withColumn("d", discount).withColumn("context", F.shiftright("gram", BITS))
        sums = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        rows = rows.join(sums, "context")
        own, weight = (F.col("c") - F.col("d")) / F.col("total"), F.col("left") / F.col("total")
        if lower is None:
            rows = rows.select("gram", "c", (own + weight / (1 << BITS)).alias("p"))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1)))
            rows = rows.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
            rows = rows.select("gram", "c", (own + weight * F.col("q")).alias("p"))
        lower = base.stage(rows, "probabilities")
        model.grams.append(_tables(lower.withColumn("l", F.log("p")), "gram", "l", "c", limit, np.nan))
        weights = sums.withColumn("total", F.col("total").cast("long")).withColumn("l", F.log(F.col("left") / F.col("total")))
        model.contexts.append(_tables(weights, "context", "l", "total", limit, 0.0))
    base.drop_staged(*counts.values())
    return model


class Lookup:
    """Values of keys by a table; those it does not hold are searched for in ``rest``."""

    def __init__(self, table: Table, missing: float, rest: Rest | None):
        self.table, self.missing, self.rest = table, missing, rest

    def get(self, keys: np.ndarray) -> np.ndarray:
        first, held, values = self.table.columns()
        out = np.full(len(keys), self.missing, np.float32)
        bucket = self.table.bucket(keys)
        at, end = first[bucket].astype(np.int64), first[bucket + np.uint64(1)]
        open_, absent = np.arange(len(keys)), []
        while len(open_):
            here = at[open_] < end[open_]
            absent.append(open_[~here])
            open_ = open_[here]
            row = at[open_]
            hit = held[row] == keys[open_]
            out[open_[hit]] = values[row[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        if self.rest and absent:
            self.rest.fill(out, keys, np.concatenate(absent))
        return out


class Scorer:
    def __init__(self, model: Model):
        self.grams = [Lookup(*table) for table in model.grams]
        self.contexts = [Lookup(*table) for table in model.contexts]

    def log_probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """Of every character after its context."""
        return self.of(grams(symbols))

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Of the last character of each n-gram of the highest order; those that were not seen back off."""
        out = self.grams[ORDER - 1].get(codes).astype(np.float64)
        open_, backed = np.flatnonzero(np.isnan(out)), None
        for n in range(ORDER - 1, 0, -1):
            if not len(open_):
                return out
            full = codes[open_] & ((1 << BITS * (n + 1)) - 1)
            backed = (0.0 if backed is None else backed) + self.contexts[n].get(full >> BITS)
            p = self.grams[n - 1].get(full & ((1 << BITS * n) - 1)).astype(np.float64)
            done = ~np.isnan(p)
            out[open_[done]] = p[done] + backed[done]
            open_, backed = open_[~done], backed[~done]
        # a character never seen: the share of the lowest order that goes to all alike
        out[open_] = (0.0 if backed is None else backed) + self.contexts[0].get(np.zeros(len(open_), np.int64)) - np.log(1 << BITS)
        return out


def measures(texts: list[str | None], trusted: Scorer, rejected: Scorer | None) -> list[tuple[float | None, ...]]:
    """Of each text: mean and standard deviation of the nats of all characters, largest likelihood ratio of a passage, share of words that repeat the one before, words.

    A character's nats depend on its n-gram alone, so each distinct n-gram of the texts is looked up once.
    """
    symbols = characters(("\n" * (ORDER - 1)).join(text or "" for text in texts))
    coded = pa.array(grams(symbols)).dictionary_encode()
    place, codes = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    of_code = -trusted.of(codes)
    ratio_of_code = of_code + rejected.of(codes) if rejected else None
    out, begin = [], 0
    for text in texts:
        if not text:
            out.append((None,) * 5)
        else:
            own = place[begin : begin + len(text)]
            nats, worst = of_code[own], None
            if rejected:
                sums = np.concatenate([[0.0], np.cumsum(ratio_of_code[own])])
                worst = float((sums[PASSAGE:] - sums[:-PASSAGE]).max() if len(sums) > PASSAGE else sums[-1])
            words = text.split()
            repeats = sum(map(str.__eq__, words, words[1:])) / max(1, len(words) - 1)
            out.append((float(nats.mean()), float(nats.std()), worst, repeats, float(len(words))))
        begin += len(text or "") + ORDER - 1
    return out


def _scorer(model: Model) -> Scorer:
    scorers = base.kept("quality")
    if model.name not in scorers:
        if len(scorers) > 1:
            scorers.clear()
        scorers[model.name] = Scorer(model)
    return scorers[model.name]


def scored(docs: DataFrame, model: Model | None, rejected: Model | None = None, column: str = "_entropy") -> DataFrame:
    """``docs`` with ``column``, the nats per character of ``text``, and ``MEASURES``; null for null and empty texts."""
    names = (column, *MEASURES)
    if model is None:
        return docs.select("*", *(F.lit(None).cast("double").alias(name) for name in names))
    shared = docs.sparkSession.sparkContext.broadcast((model, rejected))
    schema = T.StructType([*docs.schema, *(T.StructField(name, T.DoubleType()) for name in names)])

    @base.lean("quality")
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = None
        for batch in base.short_pieces(batches, size=SCORED_BYTES):
            scorers = scorers or [m and _scorer(m) for m in shared.value]
            found = measures(batch["text"].to_pylist(), *scorers)
            for i, name in enumerate(names):
                batch = batch.append_column(name, pa.array([x[i] for x in found], pa.float64()))
            yield batch

    return docs.mapInArrow(score, schema)


def thresholds(trusted: DataFrame) -> DataFrame:
    """t_lang, everyone, t_entropy, t_worst, t_repeats, t_spread of ``trusted (lang)`` as scored; the row of all languages has ``everyone``.

    The 0.99 quantile plus its distance from the median: trusted text is scored by a model that has
    seen it, and clean text that it has not seen stays within that. The spread is the usual standard
    deviation of single characters.
    """
    names = ("entropy", "worst", "repeats")
    found = [F.count("_entropy").alias("n"), F.avg("_spread").alias("t_spread")]
    found += [F.percentile_approx(f"_{name}", [0.5, 0.99], 10_000).alias(name) for name in names]
    own = trusted.groupBy(F.col("lang").alias("t_lang")).agg(*found).filter((F.col("n") >= OWN_QUANTILES) & F.col("t_lang").isNotNull())
    both = own.withColumn("everyone", F.lit(False)).unionByName(trusted.agg(*found).withColumn("t_lang", F.lit(None).cast("string")).withColumn("everyone", F.lit(True)))
    return both.select("t_lang", "everyone", *((2 * F.col(name)[1] - F.col(name)[0]).alias(f"t_{name}") for name in names), "t_spread")


def trusted_documents(docs: DataFrame, labels: DataFrame, rejected: bool = False) -> DataFrame:
    """Rows of ``docs`` whose id is labelled as of quality and not as toxic; or, with ``rejected``, as of no quality or toxic."""
    good = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    good = base.stage(good.filter("q = 0 or t = 1" if rejected else "q = 1 and t = 0").filter("l_id is not null").select("l_id"), "labelled")
    few = good.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(good) if few else good, F.col("doc_id") == F.col("l_id"), "left_semi")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs (doc_id, text, lang, ...)`` with ``_entropy``, ``_threshold`` and ``_keep``.

    Trained on all rows of ``docs`` that ``labels (doc_id, quality, toxic)`` trusts; of several labels of an
    id the worst counts. A document goes if its entropy is above its language's threshold by more than ``ERRORS``
    standard errors of a mean over its characters, if its worst passage is more like rejected text than those of
    trusted documents, or if more of its words repeat the word before than in those (and ``ERRORS`` standard errors
    at their largest); languages with few trusted documents, and a null one, have the thresholds of all. Null and empty texts have no entropy
    and stay, as do all documents where nothing is trusted. Ids may be null or repeat. All columns of
    ``docs`` are passed on.
    """
    trusted = trusted_documents(docs, labels).select("lang", "text")
    model = train(trusted.filter("text is not null and text <> ''"))
    rejected = train(trusted_documents(docs, labels, rejected=True).select("text").filter("text is not null and text <> ''")) if model else None
    # written, as thresholds read it once by language and once for all
    known = base.stage(scored(trusted, model, rejected).drop("text"), "trusted")
    limits = base.stage(thresholds(known), "thresholds")
    base.drop_staged(known)
    own, everyone = limits.filter("not everyone").drop("everyone"), limits.filter("everyone").first()
    out = scored(docs, model, rejected).join(F.broadcast(own) if own.count() <= 10_000 else own, F.col("lang") == F.col("t_lang"), "left")
    limit = lambda name: F.coalesce(name, F.lit(everyone[name]).cast("double"))
    bound = limit("t_entropy") + ERRORS * limit("t_spread") / F.sqrt(F.greatest(F.length("text"), F.lit(1)))
    repeats = limit("t_repeats") + ERRORS * 0.5 / F.sqrt(F.greatest("_words", F.lit(1.0)))
    stays = [F.col("_entropy") <= F.col("_threshold"), F.col("_worst") <= limit("t_worst"), F.col("_repeats") <= repeats]
    keep = F.coalesce(stays[0], F.lit(True)) & F.coalesce(stays[1], F.lit(True)) & F.coalesce(stays[2], F.lit(True))
    return out.withColumn("_threshold", bound).withColumn("_keep", keep).drop(*MEASURES, *own.columns)
