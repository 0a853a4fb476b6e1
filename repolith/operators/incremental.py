"""Deltas between runs: merging counts, ranges of the log, alerts, cache and document upserts, throttling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import fixed_values as fv

AUTO_START = "<!-- auto:start -->"
AUTO_END = "<!-- auto:end -->"
_DAY = 86_400


def merge_frequency(snapshot: DataFrame, delta: DataFrame) -> DataFrame:
    """Full counts of the last run plus counts of the new commits (JOIN-12)."""
    columns = ["repo_id", "path", "change_count", "last_changed"]
    return (
        snapshot.select(*columns)
        .unionByName(delta.select(*columns))
        .groupBy("repo_id", "path")
        .agg(F.sum("change_count").alias("change_count"), F.max("last_changed").alias("last_changed"))
    )


def merge_pairs(snapshot: DataFrame, delta: DataFrame) -> DataFrame:
    """Full pair counts of both parts; filter by count only after merging (STR-02)."""
    return (
        snapshot.unionByName(delta).groupBy("repo_id", "file_a", "file_b").agg(F.sum("n").alias("n"))
    )


def diff_numstat(changes: DataFrame, after: Column, until: Column) -> DataFrame:
    """Lines added and removed per path between two points of the log (SRC-07)."""
    at = F.col("committed_at")
    return (
        changes.filter((at > after) & (at <= until))
        .groupBy("repo_id", "path")
        .agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    )


def changed_since(changes: DataFrame, marks: DataFrame) -> DataFrame:
    """Paths changed after the last run of their repository (SRC-08).

    A path changed since then exactly when its newest change is newer, so changes are reduced to
    one row per path before they meet the marks.
    """
    newest = changes.groupBy("repo_id", "path").agg(F.max("committed_at").alias("last_changed"))
    return (
        newest.join(marks.select("repo_id", "last_updated"), "repo_id")
        .filter(F.col("last_changed") > F.col("last_updated"))
        .select("repo_id", "path")
    )


def churn_alert(changes: DataFrame, marks: DataFrame, min_files: int = fv.ALERT_FILES) -> DataFrame:
    """Repositories with many distinct files changed since the last run (AGG-37)."""
    return (
        changed_since(changes, marks)
        .groupBy("repo_id")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .filter(F.col("n_files") >= min_files)
    )


def ttl_upsert(cache: DataFrame, new: DataFrame, now: Column, ttl_hours: int = fv.CACHE_TTL_HOURS) -> DataFrame:
    """Cache rows (key, payload, expires_at) with the new ones added, newest per key, expired ones gone (SNK-05)."""
    fresh = new.select("key", "payload", (now + F.make_interval(hours=F.lit(ttl_hours))).alias("expires_at"))
    return ttl_read(
        cache.select("key", "payload", "expires_at")
        .unionByName(fresh)
        .groupBy("key")
        .agg(F.max_by("payload", F.struct("expires_at", "payload")).alias("payload"), F.max("expires_at").alias("expires_at")),
        now,
    )


def ttl_read(cache: DataFrame, now: Column) -> DataFrame:
    """Rows that have not expired."""
    return cache.filter(F.col("expires_at") > now)


def upsert_documents(
    existing: DataFrame, generated: DataFrame, force: bool = False, start: str = AUTO_START, end: str = AUTO_END
) -> DataFrame:
    """Merge generated documents into existing ones (SNK-03).

    Text outside the markers of an existing document is kept and the text between them replaced;
    a document without markers is left alone; equal content is skipped; ``force`` overwrites.
    """
    old = existing.select("repo_id", "path", F.col("content").alias("old"))
    new = generated.select("repo_id", "path", F.col("content").alias("new"))
    marked = lambda c: F.contains(c, F.lit(start)) & F.contains(c, F.lit(end))
    before = F.substring_index(F.col("old"), start, 1)
    after = F.substring(F.col("old"), F.instr("old", end) + len(end), F.length("old"))
    begin = F.instr("new", start)
    section = F.when(
        marked(F.col("new")), F.substring(F.col("new"), begin, F.instr("new", end) + F.lit(len(end)) - begin)
    ).otherwise(F.col("new"))
    merged = F.concat(before, section, after)
    joined = new.join(old, ["repo_id", "path"], "left").withColumn("merged", merged)
    fresh, manual = F.col("old").isNull(), ~marked(F.col("old"))
    same = F.col("merged") == F.col("old")
    write = F.lit(force)
    return joined.select(
        "repo_id",
        "path",
        F.when(fresh | write, F.col("new")).when(manual, F.col("old")).otherwise(F.col("merged")).alias("content"),
        F.when(fresh, "created").when(write, "updated").when(manual | same, "skipped").otherwise("updated").alias("action"),
        F.when(fresh | write, F.lit(None).cast("string"))
        .when(manual, "Manual content preserved")
        .when(same, "Content unchanged")
        .alias("reason"),
    )


# --- throttling -----------------------------------------------------------------------------


def _accept(seconds: np.ndarray, ready: int, wait: int) -> list[int]:
    """Accepted seconds of a sorted array when the first may come at ``ready``."""
    taken, i = [], int(np.searchsorted(seconds, ready))
    while i < len(seconds):
        taken.append(int(seconds[i]))
        i = int(np.searchsorted(seconds, seconds[i] + wait))
    return taken


def _block_steps(seconds: np.ndarray, block: int, size: int, wait: int) -> list[tuple[int, int]]:
    """Step function of one block: largest ready time and the ready time it leaves behind.

    Only ready times before ``block start + wait`` can occur; equal results are merged.
    """
    start = block * size
    steps: list[tuple[int, int]] = []
    entries = seconds[seconds < start + wait]
    bounds = [int(s) for s in entries] + [start + wait]
    for bound in bounds:
        taken = _accept(seconds, bound, wait)
        left = taken[-1] + wait if taken else bound
        if taken and steps and steps[-1][1] == left:
            steps[-1] = (bound, left)
        else:
            # without a later second the ready time passes through unchanged
            steps.append((bound, left if taken else -1))
    return steps


def _throttle_sparse(marks: DataFrame, key: str, wait: int) -> DataFrame:
    """Accepted seconds of keys that have few of them: one fold over a short sorted array per key."""
    start = F.struct(
        F.lit(-(2**62)).cast("bigint").alias("ready"), F.array().cast("array<bigint>").alias("taken")
    )

    def step(state: Column, second: Column) -> Column:
        accepted = F.struct(
            (second + wait).alias("ready"), F.concat(state["taken"], F.array(second)).alias("taken")
        )
        return F.when(second >= state["ready"], accepted).otherwise(state)

    seconds = marks.groupBy(key).agg(F.array_sort(F.collect_list("_s")).alias("_all"))
    return seconds.select(key, F.explode(F.aggregate("_all", start, step)["taken"]).alias("_s"))


def _throttle_dense(marks: DataFrame, key: str, key_type: str, wait: int) -> DataFrame:
    """Accepted seconds of busy keys, a day at a time.

    Days are worked on independently, each giving its outcome for every time the key might be
    ready again; those short step functions are chained per key; each day is then replayed with
    its real start. No task holds more than one day of seconds.
    """
    size = max(_DAY, wait)
    days = marks.withColumn("_block", F.floor(F.col("_s") / F.lit(size)).cast("bigint"))

    def summarise(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        steps = _block_steps(np.sort(pdf["_s"].to_numpy()), group[1], size, wait)
        upto, left = [s[0] for s in steps], [s[1] for s in steps]
        return pd.DataFrame({key: [group[0]], "_block": [group[1]], "upto": [upto], "left": [left]})

    def chain(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ready, starts = -(2**62), []
        pdf = pdf.sort_values("_block")
        for upto, left in zip(pdf["upto"], pdf["left"]):
            starts.append(ready)
            at = int(np.searchsorted(np.asarray(upto), ready))
            if at < len(left) and left[at] >= 0:
                ready = int(left[at])
        return pd.DataFrame({key: group[0], "_block": pdf["_block"], "ready": starts})

    def replay(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        taken = _accept(np.sort(left["_s"].to_numpy()), int(right["ready"].iloc[0]), wait)
        return pd.DataFrame({key: [group[0]] * len(taken), "_s": taken})

    steps = days.groupBy(key, "_block").applyInPandas(
        summarise, f"`{key}` {key_type}, _block BIGINT, upto ARRAY<BIGINT>, left ARRAY<BIGINT>"
    )
    starts = steps.groupBy(key).applyInPandas(chain, f"`{key}` {key_type}, _block BIGINT, ready BIGINT")
    return (
        days.groupBy(key, "_block")
        .cogroup(starts.groupBy(key, "_block"))
        .applyInPandas(replay, f"`{key}` {key_type}, _s BIGINT")
    )


def throttle(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    seconds: int = fv.THROTTLE_SECONDS,
    sparse: int = 4_096,
) -> DataFrame:
    """Events accepted at least ``seconds`` after the last accepted one of their key (STR-03).

    The clock has whole seconds, so events are first reduced to one per (key, second), map-side.
    Keys with up to ``sparse`` such seconds are folded in the JVM; only busier keys go through
    Python, in blocks of one day. Both give the same answer.
    """
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    first = (
        events.withColumn("_s", second)
        .groupBy(key, "_s")
        .agg(F.min_by(F.struct(*events.columns), F.struct(ts, order)).alias("_e"))
    )
    marks = events.select(key, second.alias("_s")).distinct()
    busy = marks.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > sparse).select(key)
    accepted = _throttle_sparse(marks.join(busy, key, "left_anti"), key, int(seconds)).unionByName(
        _throttle_dense(
            marks.join(busy, key, "left_semi"), key, events.schema[key].dataType.simpleString(), int(seconds)
        )
    )
    return first.join(accepted, [key, "_s"]).select("_e.*")
