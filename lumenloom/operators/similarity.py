"""Exact joins of vectors by cosine similarity, without a side that any worker holds whole.

Vectors of unit length lie on a sphere, where angles obey the triangle inequality. A few of them, taken at random, are pivots; every vector of the right side
belongs to the cell of its nearest pivot, and a cell knows the least and the largest angle of its members to it. A vector of the left side whose matches
may lie `reach` away (the angle of the threshold) meets a cell only if its angle a to the cell's pivot leaves room:

    least - reach <= a <= largest + reach,   and   a <= (its angle to its own nearest pivot) + 2 * reach

The second holds since a member is no further from its own pivot than from any other. No pair over the threshold is lost. Vectors meet where cells are tight,
as those of copies and clusters are; random directions in many dimensions are all about as far from each other, and then nearly all pairs are compared
(`compared` says how many).

Cells of more than `block` members are split, and so are those that meet a cell: a task compares one part with one part, as a product of two matrices.
It gives one row for each left vector and part, so that a group of thousands of copies yields thousands of rows and not their square; only pairs() gives all pairs.

Similarities are compared to nine decimals: equal vectors tie wherever they meet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .folders import written

#: Vectors of a side that are multiplied at once.
STEP = 512

#: Angles that single precision can make wrong.
SLACK = 2e-3


@dataclass(frozen=True)
class Cells:
    pivots: int = 64
    rows: int = 64  # a pivot, at least; how many there are only matters for speed
    block: int = 4096  # vectors of a side in one task


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.arccos(np.clip(vectors @ pivots.T / np.where(norms > 0, norms, 1), -1, 1))


def _pick(mode: str, threshold: float, left: pa.Table, right: pa.Table) -> pa.Table:
    """What each left vector has in this part: all matches, the best one, the best or the first of those before it by `n`."""
    kind = pa.schema([("id", left.schema.field("id").type), ("match", right.schema.field("id").type), ("m", pa.int64()), ("similarity", pa.float64())])
    if not len(left) or not len(right):
        return kind.empty_table()
    order = right.column("n").to_numpy()
    right = right.take(np.argsort(order, kind="stable"))
    order = np.sort(order, kind="stable")
    before = np.searchsorted(order, left.column("n").to_numpy()) if mode in ("first before", "best before") else np.full(len(left), len(order))
    # By squares of a side of STEP, so that a task holds one of them and not its whole part.
    a, b = matrix(left.column("embedding")), matrix(right.column("embedding"))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(a), STEP):
        rows, best, at = np.arange(i, min(i + STEP, len(a))), np.full(min(STEP, len(a) - i), -np.inf), np.zeros(min(STEP, len(a) - i), int)
        open_ = np.arange(len(rows))
        for j in range(0, len(b), STEP):
            open_ = open_[before[rows[open_]] > j]
            if not len(open_):
                break
            scores = a[rows[open_]] @ b[j : j + STEP].T
            scores[np.arange(j, j + scores.shape[1])[None, :] >= before[rows[open_], None]] = -np.inf
            over = scores > threshold - 1e-8
            r = np.flatnonzero(over.any(axis=1))
            scores = np.where(over[r], np.round(scores[r], 9), -np.inf)
            if mode == "all":
                p, c = np.nonzero(scores > threshold)
                found.append((rows[open_[r[p]]], c + j, scores[p, c]))
                continue
            c = (scores > threshold if mode == "first before" else scores).argmax(axis=1)
            value = scores[np.arange(len(r)), c]
            better = (value > threshold) & (value > best[open_[r]])
            hit = open_[r[better]]
            best[hit], at[hit] = value[better], c[better] + j
            if mode == "first before":  # what has one needs no later ones
                open_ = open_[best[open_] == -np.inf]
        if mode != "all":
            hit = np.flatnonzero(best > threshold)
            found.append((rows[hit], at[hit], best[hit]))
    r, c, value = (np.concatenate([f[k] for f in found]) for k in range(3))
    return pa.Table.from_arrays([left.column("id").take(pa.array(r)), right.column("id").take(pa.array(c)), pa.array(order[c]), pa.array(value)], schema=kind)


def _numbered(rows: DataFrame) -> DataFrame:
    """id, n, embedding of rows with a vector; without a number of its own the order is that of a hash of the id."""
    n = F.col("n").cast("long") if "n" in rows.columns else F.xxhash64("id")
    return rows.filter("embedding is not null").select("id", n.alias("n"), "embedding")


def _placed(right: DataFrame, pivots: np.ndarray) -> DataFrame:
    kind = right.schema["id"].dataType.simpleString()
    vector = right.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(matrix(batch.column(2)), pivots)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(cell)), cell])], names=["id", "n", "embedding", "cell", "angle"])

    return right.mapInArrow(run, f"id {kind}, n long, embedding {vector}, cell int, angle double")


def _sent(left: DataFrame, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> DataFrame:
    """Each left vector once for every cell that it meets."""
    kind = left.schema["id"].dataType.simpleString()
    vector = left.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a = _angles(matrix(batch.column(2)), pivots)
                meets = (a >= low - reach - SLACK) & (a <= high + reach + SLACK) & (a <= a.min(axis=1, keepdims=True) + 2 * reach + SLACK)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.flatnonzero(m).tolist() for m in meets], pa.list_(pa.int32()))], names=["id", "n", "embedding", "cells"])

    return left.mapInArrow(run, f"id {kind}, n long, embedding {vector}, cells array<int>")


class SimilarityJoin:
    """left and right: id, embedding and, for modes with an order, n (long). Made once for both; each mode is a plan of its own."""

    def __init__(self, left: DataFrame, right: DataFrame, threshold: float, how: Cells = Cells()):
        ship(left.sparkSession)
        self.threshold, self.how = threshold, how
        self.left, right = _numbered(left), _numbered(right)
        self.reach = float(np.arccos(np.clip(threshold, -1, 1)))
        # At most `pivots` vectors.
        pivots = min(how.pivots, 1 + right.count() // how.rows)
        found = [r[0] for r in right.select("embedding", F.xxhash64("id", F.lit(3)).alias("h")).orderBy("h").limit(pivots).select("embedding").collect()]
        self.empty = not found
        if self.empty:
            return
        vectors = np.array(found, float)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        pivots = np.unique(vectors / np.where(norms > 0, norms, 1), axis=0)
        self.right = written(_placed(right, pivots), "cells")
        self.members, low, high = np.zeros(len(pivots), int), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for r in self.right.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row a pivot
            self.members[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
        self.sent = _sent(self.left, pivots, low, high, self.reach).select("id", "n", "embedding", F.explode("cells").alias("cell"))
        self.visits = np.zeros(len(pivots), int)
        for r in self.sent.groupBy("cell").count().collect():
            self.visits[r["cell"]] = r["count"]

    def compared(self) -> tuple[int, int]:
        """How many pairs are compared, and how many there are."""
        return (0, 0) if self.empty else (int((self.members * self.visits).sum()), int(self.members.sum()) * self.left.count())

    def _found(self, mode: str) -> DataFrame:
        kinds = [df.schema["id"].dataType.simpleString() for df in (self.left, self.right)]
        parts = lambda counts: F.array(*[F.lit(int(max(1, -(-c // self.how.block)))) for c in counts])[F.col("cell")]
        own = lambda counts: F.pmod(F.xxhash64("id"), parts(counts)).cast("int")
        every = lambda counts: F.explode(F.sequence(F.lit(0), parts(counts) - 1))
        key = ["cell", "left_part", "right_part"]
        a = self.sent.withColumn("left_part", own(self.visits)).withColumn("right_part", every(self.members)).select(*key, "id", "n", "embedding")
        b = self.right.withColumn("right_part", own(self.members)).withColumn("left_part", every(self.visits)).select(*key, "id", "n", "embedding")
        return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(partial(_pick, mode, self.threshold), f"id {kinds[0]}, match {kinds[1]}, m long, similarity double")

    def _one(self, mode: str, order: Column) -> DataFrame:
        if self.empty:
            kind = self.left.schema["id"].dataType
            return self.left.select("id", F.lit(None).cast(kind).alias("match"), F.lit(None).cast("long").alias("m"), F.lit(0.0).alias("similarity")).limit(0)
        top = self._found(mode).groupBy("id").agg(F.min_by(F.struct("match", "m", "similarity"), order).alias("t"))
        return top.select("id", "t.*")

    def pairs(self) -> DataFrame:
        """(id, match, similarity) of all pairs over the threshold: as many rows as there are."""
        return self._one("best", F.col("m")).select("id", "match", "similarity") if self.empty else self._found("all").select("id", "match", "similarity")

    def best(self) -> DataFrame:
        """(id, match, similarity): of each left row its most similar right one; of equals the smallest id."""
        return self._one("best", F.struct((-F.col("similarity")).alias("s"), "match")).select("id", "match", "similarity")

    def first_before(self) -> DataFrame:
        """(id, match, m): of the right rows over the threshold with a smaller n that of the smallest."""
        return self._one("first before", F.struct("m", "match")).select("id", "match", "m")

    def best_before(self) -> DataFrame:
        """(id, match, similarity): the most similar right row with a smaller n; of equals the first."""
        return self._one("best before", F.struct((-F.col("similarity")).alias("s"), "m")).select("id", "match", "similarity")


def greedy_filter(rows: DataFrame, threshold: float, how: Cells = Cells()) -> DataFrame:
    """rows: id, n (their order, each number once), embedding. id, kept, duplicate_of: in order, a row is kept unless a kept one before is more similar than the threshold;
    then it repeats the most similar of these.

    Each round finds of every open row the first similar one before it that isn't dropped. Where there is none the row is kept; where that one is kept it is dropped; the
    others stay open. In a group of near-copies the first round keeps one and drops those that are like it."""
    rows = written(rows.select("id", F.col("n").cast("long").alias("n"), "embedding").filter("embedding is not null"), "greedy")
    open_, kept, dropped = rows, None, None
    while not open_.isEmpty():
        among = open_ if kept is None else open_.unionByName(kept)
        known = written(SimilarityJoin(open_, among, threshold, how).first_before().select(F.col("id").alias("k"), "match"), "known")
        state = open_.join(known, F.col("id") == F.col("k"), "left").drop("k")
        firm = state.filter("match is null").select(F.col("id").alias("f"))
        firm = firm if kept is None else firm.unionByName(kept.select(F.col("id").alias("f")))
        state = state.join(firm, F.col("match") == F.col("f"), "left")
        status = F.when(F.col("match").isNull(), "kept").when(F.col("f").isNotNull(), "dropped").otherwise("open")
        state = written(state.select("id", "n", "embedding", status.alias("status")), "settled")
        part = lambda name: state.filter(F.col("status") == name).drop("status")  # noqa: B023, E731
        kept = part("kept") if kept is None else kept.unionByName(part("kept"))
        dropped = part("dropped") if dropped is None else dropped.unionByName(part("dropped"))
        open_ = part("open")
    if kept is None:
        return rows.select("id", F.lit(True).alias("kept"), F.col("id").alias("duplicate_of")).limit(0)
    best = SimilarityJoin(dropped, kept, threshold, how).best_before()
    nothing = F.lit(None).cast(rows.schema["id"].dataType).alias("duplicate_of")
    return kept.select("id", F.lit(True).alias("kept"), nothing).unionByName(best.select("id", F.lit(False).alias("kept"), F.col("match").alias("duplicate_of")))
