"""Nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised on their own, with ``K`` centroids each, so the pairs of
centroids make K * K cells. A query sorts the centroids of each half by distance and walks the pairs in
order of the summed distance with a heap, until the cells hold the wanted share of all points; these points are
then ranked by their exact inner product.

Distances order points as inner products do only where all vectors are equally long. So each point gets one
component more, the square root of what its squared length lacks to the largest one: then all are. A query's is 0.

Equal vectors are one point, which keeps the smallest ids that any answer can need, so a vector that
a third of all rows hold costs as much as any other. Cells are packed into shards of bounded size and large
cells are cut, so no task holds more than a shard and a block of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.ranking import top_k
from repolith.llm import base

#: Centroids of each half at most; fewer for small tables.
CENTROIDS = 64
#: The centroids are fitted to at most this many points, those with the smallest hashes.
FIT_POINTS = 10_000
#: Share of all points whose cells a query visits.
VISIT = 0.5
SHARD_POINTS = 8192
QUERY_BLOCK = 4096


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def fit(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of one half."""
    centroids = np.unique(sample, axis=0)
    centroids = centroids[np.random.default_rng(3).permutation(len(centroids))[:k]].copy()
    for _ in range(rounds):
        nearest = assign(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def assign(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (2 * points @ centroids.T - (centroids**2).sum(1)).argmax(1)


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of ``left[i] + right[j]`` until they hold ``wanted`` points; ``sizes`` is by (i, j)."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    la, lb, order = left[a].tolist(), right[b].tolist(), (a.tolist(), b.tolist())
    heap, seen, out = [(la[0] + lb[0], 0, 0)], {(0, 0)}, []
    while heap and wanted > 0:
        _, i, j = heapq.heappop(heap)
        cell = order[0][i] * len(lb) + order[1][j]
        if sizes[cell]:
            out.append(cell)
            wanted -= int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(la) and y < len(lb) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (la[x] + lb[y], x, y))
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    return np.array(flat.flatten(), np.float64).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def lifted(points: np.ndarray, longest: float) -> np.ndarray:
    """Points with the component that makes their squared length ``longest``."""
    return np.concatenate([points, np.sqrt(np.maximum(0.0, longest - (points**2).sum(1)))[:, None]], axis=1)


def shards(sizes: np.ndarray, points: int) -> list[tuple[int, int]]:
    """First shard of every cell and the shards it is cut into. Small cells share a shard."""
    out, shard, room = [], 0, points
    for size in sizes.tolist():
        if size > points:
            if room < points:
                shard, room = shard + 1, points
            parts = -(-size // points)
            out.append((shard, parts))
            shard += parts
            continue
        if size > room:
            shard, room = shard + 1, points
        out.append((shard, 1))
        room -= size
    return out


def search(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, visit: float = VISIT, fit_points: int = FIT_POINTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query, by inner product in double precision.

    Every row is a candidate for all queries but that of its own id. Nearest first, ties to the smaller
    id; all candidates where there are fewer than ``k``. Rows whose vector is null, zero or holds null or
    non-finite components take no part, nor rows without an id. Vectors of different lengths are not compared: each length
    is searched on its own. Repeated rows count once. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).distinct()
    rows = base.stage(rows, "vectors")
    # lengths are those of a few models
    lengths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()] or [2]
    found = None
    for dims in lengths:
        part = _search(rows.filter(F.size("v") == dims), dims, k, centroids, visit, fit_points)
        found = part if found is None else found.unionByName(part)
    return found


def _search(rows: DataFrame, dims: int, k: int, centroids: int, visit: float, fit_points: int) -> DataFrame:
    """The search among vectors of ``dims`` components."""
    spark = rows.sparkSession
    # one point per vector, with the ids that any answer may need
    kept = top_k(rows.select("v", "vec_id").distinct(), k + 1, ["v"], [F.col("vec_id")])
    points = kept.groupBy("v").agg(F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = base.stage(points, "points")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = points.agg(F.count(F.lit(1)), F.coalesce(F.max(length), F.lit(0.0))).first()
    half = max(1, dims // 2)
    sample = points.select("point", "v").orderBy(F.xxhash64("point"), "point").limit(fit_points).toArrow()
    flat = lifted(matrix(sample["v"]) if n else np.zeros((1, dims)), longest)
    count = max(1, min(centroids, len(flat) // 4))
    books = [fit(flat[:, :half], count), fit(flat[:, half:], count)]
    width = len(books[1])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = lifted(matrix(batch["v"]), longest)
                cell = assign(v[:, :half], books[0]) * width + assign(v[:, half:], books[1])
                yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    filed = base.stage(points.select("point", "v").mapInArrow(cells, "point long, v array<double>, cell int"), "index")
    # one count per cell, at most the square of ``centroids``
    sizes = np.zeros(len(books[0]) * width, np.int64)
    for r in filed.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    places = shards(sizes, SHARD_POINTS)
    wanted = max(k + 1, int(np.ceil(visit * n)))

    asking = rows.filter("asks").select("v").distinct().join(points.select("v", F.col("point").alias("query")), "v")
    asking = base.stage(asking, "queries")
    blocks = max(1, -(-asking.count() // QUERY_BLOCK))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = [(b**2).sum(1) for b in books]
        for batch in batches:
            v = np.pad(matrix(batch["v"]), ((0, 0), (0, 1))) if batch.num_rows else np.empty((0, dims + 1))
            out: list[tuple] = []
            for i, (query, q) in enumerate(zip(batch["query"].to_pylist(), v, strict=True)):
                by_shard: dict[int, list[int]] = {}
                for cell in walk(norms[0] - 2 * books[0] @ q[:half], norms[1] - 2 * books[1] @ q[half:], sizes, wanted):
                    first, parts = places[cell]
                    for shard in range(first, first + parts):
                        by_shard.setdefault(shard, []).append(cell)
                out.extend((i, query, shard, some) for shard, some in by_shard.items())
            if out:
                at, query, shard, some = zip(*out, strict=True)
                columns = [pa.array(query, pa.int64()), batch["v"].take(pa.array(at)), pa.array(shard, pa.int32()), pa.array(some, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "v", "shard", "cells"])

    asked = asking.select("query", "v").mapInArrow(visits, "query long, v array<double>, shard int, cells array<int>")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    table = spark.createDataFrame([(c, s, p) for c, (s, p) in enumerate(places) if sizes[c]], "cell int, first int, parts int")
    held = filed.join(F.broadcast(table), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("point"), F.col("parts"))).cast("int"))
    held = held.select("shard", "cell", "point", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def rank(queries: pa.Table, points: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        if queries.num_rows and points.num_rows:
            ids, cell, p, q = points["point"].to_numpy(), points["cell"].to_numpy(), matrix(points["v"]), matrix(queries["v"])
            names, lists = queries["query"].to_numpy(), queries["cells"].to_pylist()
            for at in range(0, len(q), 256):
                scores = q[at : at + 256] @ p.T
                for row, name, some in zip(scores, names[at : at + 256], lists[at : at + 256], strict=True):
                    row[~np.isin(cell, some)] = -np.inf
                    best = np.lexsort((ids, -row))[: k + 1] if len(row) <= 4 * k else _best(row, ids, k + 1)
                    best = best[np.isfinite(row[best])]
                    out.append((np.full(len(best), name), best))
        if not out:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query", "point", "score"])
        query, best = (np.concatenate(x) for x in zip(*out, strict=True))
        where = {name: i for i, name in enumerate(names.tolist())}
        rows = np.array([where[name] for name in query.tolist()], np.int64)
        score = (q[rows] * p[best]).sum(1) if len(rows) else np.empty(0)
        return pa.table([pa.array(query), pa.array(ids[best]), pa.array(score)], names=["query", "point", "score"])

    near = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(rank, "query long, point long, score double")
    near = base.stage(top_k(near, k + 1, ["query"], [F.desc("score"), F.col("point")]).drop("rank"), "near")
    near = near.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("near_id"))
    near = top_k(near, k + 1, ["query"], [F.desc("score"), F.col("near_id")]).drop("rank")
    lists = near.groupBy("query").agg(F.collect_list(F.struct("score", "near_id")).alias("list"))
    asks = rows.filter("asks").select("vec_id", "v").distinct().join(asking, "v").select(F.col("vec_id").alias("query_id"), "query")
    found = asks.join(lists, "query").select("query_id", F.explode("list").alias("x")).filter("x.near_id <> query_id")
    found = found.groupBy("query_id", F.col("x.near_id").alias("near_id")).agg(F.max("x.score").alias("score"))
    found = top_k(found, k, ["query_id"], [F.desc("score"), F.col("near_id")])
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("near_id").alias("vec_id"), "score")


def _best(row: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest, ties to the smaller id."""
    limit = np.partition(row, len(row) - n)[len(row) - n]
    some = np.flatnonzero(row >= limit)
    return some[np.lexsort((ids[some], -row[some]))[:n]]
