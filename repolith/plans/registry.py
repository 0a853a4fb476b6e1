"""Registry of the driver's queries: a Spark plan and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.plans import testviews as tv
from repolith.session import size, stage, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Views and tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.written: dict[str, DataFrame] = {}

    def write(self, name: str, *columns: str) -> DataFrame:
        """Write a view, or those columns of it that are read, once for all that reads it or a view over it."""
        df = getattr(self, name)
        self.written[name] = stage(df.select(*columns) if columns else df, name)
        return self.written[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in tv.VIEWS:
            return tv.view(self.spark, self.sf_dir, name, self.written)
        if name in tv.TABLES:
            return tv.table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register ``fn(inputs)``; ``sql`` follows the WITH clause of ``views`` and may add CTEs before SELECT."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            size(tune(spark), tv.input_bytes(spark, sf_dir))
            return fn(Inputs(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if views:
                head = tv.with_views(*views)
                body = f"{head}\n{body}" if body.upper().startswith("SELECT") else f"{head},\n{body}"
            ORACLES[name] = body
        return fn

    return register


def stamp(c: Column | str) -> Column:
    """Timestamp as text, the same in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def text(c: Column | str, glue: str = "|") -> Column:
    return F.array_join(c, glue)


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
