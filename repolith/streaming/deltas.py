"""Counts that grow by micro-batches: a folded base and a bounded tail of deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.sources.versions import Folder, Versions

#: Deltas after which they are folded into the base.
COMPACT_EVERY = 20


class DeltaTable:
    """Deltas ``tail/batch_id=N`` below ``path``, each written by one micro-batch, and a base that holds all up to some batch.

    ``fold`` reduces any rows of the table to one per key, and may be applied to its own results. A replayed batch replaces its
    delta. Only batches before the one at work are folded: those are committed and never come again, so the base needs
    no undoing. The new base shows with its manifest, which also says up to which batch it holds; deltas that
    the base before already held are deleted then, so a reader that began with that base still finds its tail.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, fold: Callable[[DataFrame], DataFrame], every: int = COMPACT_EVERY):
        self.spark, self.path, self.schema, self.fold, self.every = spark, path.rstrip("/"), schema, fold, every
        self.base, self.folder = Versions(spark, f"{path}/base"), Folder(spark, path)

    def write(self, delta: DataFrame, batch_id: int) -> None:
        delta.write.mode("overwrite").parquet(f"{self.path}/tail/batch_id={batch_id}")
        manifest = self.base.latest()
        through = manifest["through"] if manifest else -1
        if len([b for b in self.batches() if through < b < batch_id]) >= self.every:
            self.compact(batch_id - 1)

    def batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names("tail") if n.startswith("batch_id="))

    def compact(self, through: int) -> None:
        """Fold base and deltas up to batch ``through`` into a new base."""
        before = self.base.latest()
        self.base.commit({"base": self.fold(self._rows(through))}, through=through)
        if before:
            for b in self.batches():
                if b <= before["through"]:
                    self.folder.delete(f"tail/batch_id={b}")
            self.base.vacuum(keep=2)

    def _rows(self, upto: int | None = None) -> DataFrame:
        manifest = self.base.latest()
        self.folder.make("tail")
        tail = self.spark.read.schema(f"{self.schema}, batch_id BIGINT").parquet(f"{self.path}/tail")
        if manifest:
            tail = tail.filter(F.col("batch_id") > manifest["through"])
        if upto is not None:
            tail = tail.filter(F.col("batch_id") <= upto)
        rows = tail.drop("batch_id")
        return self.base.open(manifest, "base").unionByName(rows) if manifest else rows

    def read(self) -> DataFrame:
        """All rows so far, folded."""
        return self.fold(self._rows())
