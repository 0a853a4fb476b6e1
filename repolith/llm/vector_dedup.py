"""Near copies among vectors by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and cut into blocks of a few dimensions. Where the whole squared
distance of two vectors is within the budget ``2 - 2 * cosine``, the distance in one block at least is within that
block's share of it, in proportion to its dimensions. So a range join in each block finds every pair.

The join files the points of a block under the nearest of some pivots. A point also visits the cells before its own
that the range can reach: the plane between two pivots is no farther from it than any point beyond. Large
cells are cut into tiles of two parts, so no task holds more than a tile. A tile verifies its candidates on the
original vectors at once, and a pair counts only in the first block that admits it: no pair leaves a task, just the
number of links of each point and a forest that joins its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.llm import base
from repolith.llm.ann import usable
from repolith.llm.components import components

#: Dimensions of a block, about.
BLOCK_DIMS = 16
#: Points of a cell aimed at, members of a part of a tile.
CELL_POINTS = 1 << 16
#: Pivots at most; beyond that cells grow, and with them the number of their tiles.
MAX_PIVOTS = 1024
#: Candidates verified at a time, and pairs looked at.
PAIRS, LOOKED_AT = 1 << 16, 1 << 20


class Subspaces:
    """Rotation, blocks and budgets for vectors of one length."""

    def __init__(self, dims: int, cosine: float):
        turn, _ = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
        self.turn = turn
        count = max(1, round(dims / BLOCK_DIMS))
        self.edges = np.linspace(0, dims, count + 1).astype(np.int64)
        # a hair of room for rounding: candidates are verified, so more of them do no harm
        self.budget = (2 - 2 * cosine) * np.diff(self.edges) / dims * (1 + 1e-9) + 1e-9

    def place(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / np.abs(vectors).max(1, keepdims=True)
        return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)) @ self.turn

    def block(self, placed: np.ndarray, b: int) -> np.ndarray:
        return placed[:, self.edges[b] : self.edges[b + 1]]

    def first_block(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """First block that admits each pair of rows; the same in every task."""
        within = np.add.reduceat((x - y) ** 2, self.edges[:-1], axis=1) <= self.budget
        return np.where(within.any(1), within.argmax(1), -1)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * (x @ y.T), 0)


def cells(points: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point, cell and whether it is the point's own: all cells up to its own that each point must visit."""
    if len(pivots) < 2:
        return np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    far = squares(points, pivots)
    own = far.argmin(1)
    between = np.sqrt(squares(pivots, pivots))[own]
    gap = far - far[np.arange(len(points)), own][:, None]
    visits = (gap <= 2 * (reach + 1e-6) * between + 1e-9) & (np.arange(len(pivots)) < own[:, None])
    visits[np.arange(len(points)), own] = True
    point, cell = np.nonzero(visits)
    return point, cell, cell == own[point]


class Tile:
    """Members of one or two parts of a cell. Points are filed here (``own``) or visit."""

    def __init__(self, space: Subspaces, block: int, cosine: float, vectors: np.ndarray, weight: np.ndarray):
        self.space, self.b, self.cosine, self.vectors, self.weight = space, block, cosine, vectors, weight
        self.norm = np.sqrt((vectors**2).sum(1))
        self.placed = space.place(vectors)
        # the product of a row of ``one`` and a row of ``two`` is minus their squared distance in the block
        near = space.block(self.placed, block)
        length = (near**2).sum(1, keepdims=True)
        each = np.ones_like(length)
        self.one = np.concatenate([2 * near, -length, -each], axis=1).astype(np.float32)
        self.two = np.concatenate([near, each, length], axis=1).astype(np.float32)
        self.links = np.zeros(len(vectors), np.int64)
        self.root = np.arange(len(vectors))

    def compare(self, left: np.ndarray, right: np.ndarray, same: bool = False) -> None:
        """Verify the pairs of two lists of members, or within one list.

        Single precision is enough to look: the room left for its rounding only adds candidates.
        """
        rows, least = max(1, LOOKED_AT // max(1, len(right))), np.float32(-self.space.budget[self.b] - 1e-5)
        one, two = self.one[left], np.ascontiguousarray(self.two[right].T)
        for at in range(0, len(left), rows):
            from_ = at if same else 0
            near = np.flatnonzero(one[at : at + rows] @ two[:, from_:] >= least)
            i, j = np.divmod(near, two.shape[1] - from_)
            i, j = i + at, j + from_
            if same:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), PAIRS):
                self.verify(left[i[part : part + PAIRS]], right[j[part : part + PAIRS]])

    def verify(self, i: np.ndarray, j: np.ndarray) -> None:
        linked = (self.vectors[i] * self.vectors[j]).sum(1) / (self.norm[i] * self.norm[j]) >= self.cosine
        i, j = i[linked], j[linked]
        counted = self.space.first_block(self.placed[i], self.placed[j]) == self.b
        i, j = i[counted], j[counted]
        np.add.at(self.links, i, self.weight[j])
        np.add.at(self.links, j, self.weight[i])
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def vector_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten(), np.float64).reshape(len(flat), -1)


def by_length(table: pa.Table | pa.RecordBatch) -> Iterator[pa.Table | pa.RecordBatch]:
    sizes = table["dims"].to_numpy()
    for dims in np.unique(sizes):
        yield table.filter(pa.array(sizes == dims))


def found_links(points: DataFrame, cosine: float, cell_points: int) -> DataFrame:
    """node, n, other: links of each point within a tile, and the forest of the tile, for ``points (node, v, dims, weight)``."""
    spark = points.sparkSession
    kind = points.schema["v"].dataType.simpleString()
    n = points.count()
    pivots_wanted = min(MAX_PIVOTS, n // cell_points + 1)
    sample = points.orderBy(F.xxhash64("node"), "node").limit(pivots_wanted).select("v", "dims").toArrow()
    pivots = {int(t["dims"][0].as_py()): vector_matrix(t["v"]) for t in by_length(sample)} if sample.num_rows else {}

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in by_length(batch) if batch.num_rows else ():
                dims = int(rows["dims"][0].as_py())
                space = Subspaces(dims, cosine)
                placed = space.place(vector_matrix(rows["v"]))
                about = space.place(pivots[dims]) if dims in pivots else np.empty((0, dims))
                for b, budget in enumerate(space.budget):
                    point, cell, own = cells(space.block(placed, b), space.block(about, b), float(np.sqrt(budget)))
                    arrays = [c.take(pa.array(point)) for c in rows.columns]
                    arrays += [pa.array(np.full(len(point), b, np.int32)), pa.array(cell.astype(np.int32)), pa.array(own)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, "block", "cell", "own"])

    filed = points.select("node", "v", "dims", "weight").mapInArrow(file, f"node long, v {kind}, dims int, weight long, block int, cell int, own boolean")
    sizes = base.stage(filed.groupBy("dims", "block", "cell").count(), "cells")
    parts = sizes.select("dims", "block", "cell", F.ceil(F.col("count") / cell_points).cast("int").alias("parts"))
    filed = filed.join(parts, ["dims", "block", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # every two parts of a cell meet once, and every part with itself
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, "part").alias("low"), F.greatest(p, "part").alias("high")))
    tiles = filed.withColumn("t", F.explode(pairs)).select("dims", "block", "cell", "t.low", "t.high", "part", "own", "node", "weight", "v")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        first = {c: table[c][0].as_py() for c in ("dims", "block", "low", "high")}
        node, own = table["node"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
        part = table["part"].to_numpy()
        tile = Tile(Subspaces(first["dims"], cosine), first["block"], cosine, vector_matrix(table["v"]), table["weight"].to_numpy())
        at = lambda mask: np.flatnonzero(mask)
        if first["low"] == first["high"]:
            tile.compare(at(own), at(own), same=True)
            tile.compare(at(own), at(~own))
        else:
            low = part == first["low"]
            tile.compare(at(low & own), at(~low))
            tile.compare(at(low & ~own), at(~low & own))
        has, joined = at(tile.links > 0), at(tile.root != np.arange(len(node)))
        nodes = pa.array(np.concatenate([node[has], node[joined]]), pa.int64())
        n = pa.array(np.concatenate([tile.links[has], np.zeros(len(joined), np.int64)]), pa.int64())
        other = np.concatenate([np.zeros(len(has), np.int64), node[tile.root[joined]]])
        return pa.table([nodes, n, pa.array(other, pa.int64(), mask=np.arange(len(other)) < len(has))], names=["node", "n", "other"])

    return tiles.groupBy("dims", "block", "cell", "low", "high").applyInArrow(compare, "node long, n long, other long")


def near_copies(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", cell_points: int = CELL_POINTS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector.

    Vectors of one length are linked when their cosine, in double precision, is at least ``cosine``. ``n_links`` counts
    the others linked directly, ``component_id`` is the smallest vec_id that links reach, the own included; ``kept``
    says that it is the own. Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing.

    Rows alike in id and vector are one. Rows of an id that repeats with another vector are each a vector of their own. Vectors without an id
    take no part: no links, no component, kept. Other columns are ignored; an empty table gives no rows.
    """
    element = vectors.schema[vector].dataType.elementType
    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).distinct()
    rows = rows.withColumn("good", F.coalesce(F.col("vec_id").isNotNull() & usable(F.col("v")), F.lit(False)))
    rows = base.stage(rows, "vectors")
    good = rows.filter("good").select("vec_id", "v")
    # equal vectors are one point
    points = good.groupBy("v").agg(F.count(F.lit(1)).alias("weight")).withColumn("node", F.monotonically_increasing_id())
    points = base.stage(points.withColumn("dims", F.size("v")), "points")
    found = base.stage(found_links(points, cosine, cell_points), "links")

    joined = components(found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    links = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    named = points.select("node", "v", "weight").join(links, "node", "left").join(joined, "node", "left")
    named = named.select("v", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    each = base.stage(good.join(named, "v").select("vec_id", "n_links", "component"), "members")
    smallest = each.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = each.join(smallest, "component").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
