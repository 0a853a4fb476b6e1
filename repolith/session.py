"""Session helpers: builder defaults, reliable checkpoint directory, bounded side tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rule tables held by the driver may be broadcast up to this many rows; larger ones shuffle.
MAX_BROADCAST_ROWS = 10_000


#: Runtime settings the operators rely on. Skewed joins are split even where that costs an
#: extra exchange: one repository may hold a third of all rows.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a ranking is cut to its k before and after the exchange, however large the caller's k
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}

#: Sizes for the tables of the core: names and paths that repeat pack to a twentieth of their rows or less.
SIZE_CONF = {
    # a table is broadcast by what its rows take in memory, not by its packed file
    "spark.sql.sources.fileCompressionFactor": "20",
    # packed bytes that one task takes from an exchange
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}
#: Bytes of input files for which an exchange has one more partition; adaptive execution joins small ones.
BYTES_A_PARTITION = 4 << 20
_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: What the settings of ``SIZE_CONF`` were before ``size``.
_BEFORE: dict[str, str | None] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def size(spark: SparkSession, input_bytes: int) -> SparkSession:
    """Settings by which no task takes more of an exchange or a broadcast as the input grows."""
    for key in (*SIZE_CONF, _PARTITIONS):
        _BEFORE.setdefault(key, spark.conf.get(key, None))
    for key, value in SIZE_CONF.items():
        spark.conf.set(key, value)
    at_least = int(_BEFORE[_PARTITIONS] or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_PARTITIONS, str(max(at_least, -(-input_bytes // BYTES_A_PARTITION))))
    return spark


def unsize(spark: SparkSession) -> SparkSession:
    """Take back what ``size`` has set."""
    for key, value in _BEFORE.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    _BEFORE.clear()
    return spark


def build_session(app: str = "repolith", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume; cluster sizing stays with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``; make one only where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="repolith-ckpt-")
    context.setCheckpointDir(configured)
    return configured


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that comes in fewer pieces than there are cores; leave a larger one alone.

    A small file is one row group and so one task, however costly the work on each row. Tables
    with at least a piece per core, as any large table has, get no extra exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several branches of a job read to the shared folder, and read it back.

    Unlike a cache it survives lost executors, and unlike a checkpoint it keeps column pruning.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    # shuffle files are dropped once the driver's garbage collector has found the plans that made them
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.parquet(path)


def rule_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """DataFrame over driver-held rule rows; hinted for broadcast only while its size is small.

    The rows travel as an Arrow table and so become part of the plan, without a Python job.
    """
    rows = [tuple(r) for r in rows]
    fields = T.StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(fields)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow_schema)]
    df = spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow_schema), fields)
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_ROWS else df
