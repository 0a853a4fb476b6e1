"""What the operators of this subpackage share: words, hashes, the shared folder, sizes of tasks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.session import ensure_checkpoint_dir, tune, unsize

#: Words of all contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: a batch of documents of usual length then holds a few MB.
ARROW_ROWS = 1000
#: Bytes of text that a task holds arrays of at a time, unless one text is longer.
PIECE_BYTES = 1 << 19


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on."""
    unsize(tune(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets one of its own and a cluster fails.
    """
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, lost executors do no harm."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    # shuffle files are dropped once the driver's garbage collector has found the plans that made them
    df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files of staged frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns, dealt over the cores where the table comes in fewer pieces than that."""
    picked = df.select(*columns)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return picked.repartition(cores) if picked.rdd.getNumPartitions() < cores else picked


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit hashes."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class WordHashes(dict):
    """64-bit hashes of words; remembers up to ``limit`` of them."""

    def __init__(self, limit: int = 600_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: What tasks keep in their Python worker for the next ones, by operator.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What earlier tasks of the operator left in this Python worker; what other operators left there is let go."""
    others = _KEPT.keys() - {operator}
    for other in others:
        del _KEPT[other]
    if others:
        give_back()
    return _KEPT.setdefault(operator, {})


def give_back() -> None:
    """Memory that this process has freed goes back to the system; allocators hold on to it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(operator: str) -> Callable:
    """For functions over the batches of a task: what other operators left in the worker goes before it, what it has freed after it."""

    def wrap(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
        @functools.wraps(work)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept(operator)
            yield from work(batches)
            give_back()

        return run

    return wrap


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd random factors, the same in every process."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hashes of all runs of ``n`` words, by start."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i, factor in enumerate(multipliers(n, seed)):
        total += mix(words[i : i + count] ^ factor) * factor
    return mix(total)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint64, copy=False).view(np.int64))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def short_pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches whose texts begin within ``size`` bytes of each other, so that arrays of a value per byte stay small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(), dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        cuts = [*np.flatnonzero(np.diff(begins // size, prepend=-1)).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            yield batch.slice(at, end - at)


def large_pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about ``size`` bytes."""
    held: list[pa.RecordBatch] = []

    def together() -> list[pa.RecordBatch]:
        return pa.Table.from_batches(held).combine_chunks().to_batches()

    for batch in pieces(batches):
        if held and sum(b.nbytes for b in held) + batch.nbytes > size:
            yield from together()
            held = []
        held.append(batch)
    if held:
        yield from together()


def two_to_the(n: float) -> int:
    """Smallest power of two that is not below ``n``, 1 at least."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))

