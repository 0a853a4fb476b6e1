"""Throttle of trigger events as a stream, in the order of their times."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from repolith.functions import fixed_values as fv

#: State store that keeps lists and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Throttle(StatefulProcessor):
    """One key: events wait in a list until the watermark has passed their second, then they are judged in order.

    Of the events of a second the earliest counts, as in the batch form. A timer stands at the end of the earliest
    waiting second. ``ready`` is the second from which the next event may be accepted; it is forgotten with
    the first timer after it.
    """

    def __init__(self, id_type: str, wait: int):
        self.id_type, self.wait = id_type, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"micros BIGINT, id {self.id_type}")
        self.ready = handle.getValueState("ready", "second BIGINT")

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["id", "second", "late"])
        out.insert(0, "key", pd.Series([key] * len(rows), dtype=object))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        came = pd.concat(list(rows))
        second = came["micros"] // 1_000_000
        late = came[second < passed]
        new = [(int(m), i) for m, i in zip(came["micros"][second >= passed], came["id"][second >= passed])]
        if new:
            old = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
            first: dict[int, tuple] = {}
            for event in sorted([*old, *new]):
                first.setdefault(event[0] // 1_000_000, event)
            self.waiting.put(list(first.values()))
            self._wait_for(min(first))
        yield self._frame(key[0], [(i, int(m) // 1_000_000, True) for m, i in zip(late["micros"], late["id"])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        ready = self.ready.get()[0] if self.ready.exists() else None
        events = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        taken, left = [], []
        for micros, i in events:
            second = micros // 1_000_000
            if second >= passed:
                left.append((micros, i))
            elif ready is None or second >= ready:
                taken.append((i, second, False))
                ready = second + self.wait
        if left:
            self.waiting.put(left)
            self._wait_for(left[0][0] // 1_000_000)
        else:
            self.waiting.clear()
        if ready is not None and ready >= passed:
            self.ready.update((ready,))
            self.handle.registerTimer((ready + 1) * 1000)
        else:
            self.ready.clear()
        yield self._frame(key[0], taken)

    def _wait_for(self, second: int) -> None:
        self.handle.registerTimer((second + 1) * 1000)

    def close(self) -> None:
        pass


def throttle_events(
    stream: DataFrame, key: str, ts: str, order: str, seconds: int = fv.THROTTLE_SECONDS, delay: str = "10 minutes"
) -> DataFrame:
    """key, order, second, late: accepted events, and those that come after the watermark (STR-03).

    An event is accepted when it is at least ``seconds`` after the last accepted one of its key, by the times of the
    events, in whatever order they arrive: up to ``delay`` of them wait in the state and are judged as the
    watermark passes. So the accepted events are those of the batch form over all events in time. An event that comes
    later than that is not judged; it leaves with ``late`` set, once per event.

    Events without a time or an id are not counted. The time column does not reach the stateful step as such, or Spark would drop late rows in front of it.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    types = {c: stream.schema[c].dataType for c in (key, order)}
    id_type = "BIGINT" if isinstance(types[order], T.IntegralType) else "STRING"
    stream = stream.filter(F.col(ts).isNotNull() & F.col(order).isNotNull())
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).select(
        F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("micros"), F.col(order).cast(id_type).alias("id")
    )
    judged = rows.groupBy("key").transformWithStateInPandas(
        _Throttle(id_type, int(seconds)), f"key STRING, id {id_type}, second BIGINT, late BOOLEAN", "Append", "EventTime"
    )
    return judged.select(F.col("key").cast(types[key]).alias(key), F.col("id").cast(types[order]).alias(order), "second", "late")


def stream_throttle(
    stream: DataFrame, key: str, ts: str, order: str, path: str, checkpoint: str,
    seconds: int = fv.THROTTLE_SECONDS, delay: str = "10 minutes",
) -> DataStreamWriter:
    """Writes accepted events to ``path/accepted`` and late ones to ``path/late``, a folder per micro-batch that a replay replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, some in (("accepted", batch.filter("NOT late")), ("late", batch.filter("late"))):
            some.drop("late").write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        batch.unpersist()

    judged = throttle_events(stream, key, ts, order, seconds, delay)
    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_throttle(spark: SparkSession, path: str, name: str = "accepted") -> DataFrame:
    """Accepted (or ``late``) events of all micro-batches so far."""
    return spark.read.parquet(f"{path}/{name}").drop("batch_id")
