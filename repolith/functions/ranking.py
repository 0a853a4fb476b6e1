"""Bounded ranking per key.

``row_number() <= k`` is planned with a group limit on both sides of the exchange, so a task
sends at most ``k`` rows per key: one repository holding a third of the rows does not become
one task holding a third of the rows. This holds for ``k`` below Spark's
``spark.sql.optimizer.windowGroupLimitThreshold``, which ``session.RUNTIME_CONF`` raises to a
million. Rank aggregates, not raw facts, wherever possible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every ``by`` group in ``order``; adds the 1-based ``rank`` (WIN-02).

    ``order`` must end in a unique key: the engine breaks every tie explicitly.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= k)


def newest_first() -> list[Column]:
    """Log order: newest commit first, ties by commit id."""
    return [F.col("committed_at").desc(), F.col("commit_id").desc()]


def recency() -> Column:
    """Comparable value that grows with log recency; for ``max_by``/``min_by``."""
    return F.struct("committed_at", "commit_id")


def collect_ranked(rank: str, value: str) -> Column:
    """Array of ``value`` by ``rank``; only for groups already cut to a small k."""
    pairs = F.array_sort(F.collect_list(F.struct(rank, value)))
    return F.transform(pairs, lambda p: p[value])
