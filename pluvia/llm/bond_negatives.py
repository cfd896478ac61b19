"""Hard negatives of anchors by a vertical scan with shrinking candidate bitmaps (BOND).

Vectors are stored in tiles of a few thousand rows, dimension by dimension, with each
dimension's least and greatest value. An anchor reads a tile's dimensions in descending
order of its own components' magnitude. After every few dimensions the partial scores
plus the greatest (and least) that the remaining dimensions can still add, from their
minima and maxima and from the lengths that remain of both vectors, decide which rows
stay in the bitmap. The next dimensions are read for those rows only; rows that stay to
the end have their exact scores.

Two scans: the first finds an anchor's best rows of its own label (positives). Each
positive opens a window of scores, a share of its own; the second scan finds the best
rows of other labels in each window. A scan keeps rows that reach the anchor's current
last place, so its bars rise as it goes on.

Anchors are worked off in blocks: the block (at most ``block`` anchors, ``VALUES``
numbers) is broadcast, every task scans its tiles for it and returns a bounded number of
rows an anchor, which a window merges. Tiles are cut from rows ranged by label and id, so
a label with most of the rows is many tiles. Results between the scans are written tables.

Components become ``floor(scale * x)``, x as double; scores are exact integers (float64
sums only where they stay under 2^53, else Python integers; beyond 64 bits a score is
held at the end of the range).

Nulls and other cases: a row without id, label or vector takes no part, nor does one
with a null or non-finite component (before or after scaling); vectors of unequal width
are padded with zeros; ties go to the smaller id; a repeated anchor id is answered once,
for the least of its (label, vector) pairs; other repeated rows count as often as they
appear; rows with the anchor's id are neither its positives nor its negatives; a positive
with an empty window (also any negative score) has no rows; an empty table gives no rows.
Labels are integers. Other columns are never read and never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.session import materialise, scratch_path

TILE = 4096
VALUES = 1 << 19
STEPS = 8
EXACT = 2.0**53
LIMIT = 2**63 - 1
TILES = "n int, width int, ids binary, labels binary, cells binary"
FOUND = "anchor_id long, place int, vec_id long, score long"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, parts) of the rows that take part; parts are integers held as doubles."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(float(scale))).alias("parts"))
    broken = F.exists("parts", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # rint(x - 0.5) and the like would not do: floor to a double, not to a long that could overflow
    floored = F.transform("parts", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("parts").isNotNull()
                      & ~broken).withColumn("parts", floored)


def matrix(parts: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of lists as a matrix, padded with zeros."""
    lengths = parts.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    values = parts.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of the task's rows, in their order."""
    held: list[pa.RecordBatch] = []

    def tile(rows: pa.Table) -> pa.RecordBatch:
        parts = matrix(rows.column("parts").combine_chunks())
        return pa.RecordBatch.from_pydict({
            "n": pa.array([len(parts)], pa.int32()), "width": pa.array([parts.shape[1]], pa.int32()),
            "ids": [rows.column("vec_id").to_numpy().astype("<i8").tobytes()],
            "labels": [rows.column("label").to_numpy().astype("<i8").tobytes()],
            "cells": [np.ascontiguousarray(parts.T).astype("<f8").tobytes()]})

    def rows_of(width: int) -> int:
        return max(1, min(TILE, VALUES // max(1, width)))

    for batch in batches:
        held.append(batch)
        while held:
            table = pa.Table.from_batches(held)
            widths = pc.list_value_length(table.column("parts"))
            size = rows_of(pc.max(widths).as_py() or 0)
            if table.num_rows < size or not table.num_rows:
                break
            yield tile(table.slice(0, size))
            held = table.slice(size).to_batches()
    if held and sum(b.num_rows for b in held):
        yield tile(pa.Table.from_batches(held))


def tiles(rows: DataFrame) -> DataFrame:
    """Written tiles of (vec_id, label, parts)."""
    ranged = rows.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id")
    return materialise(ranged.mapInArrow(_cut, TILES), "tiles")


class Tile:
    """Rows of a tile by dimension, with the bounds of each dimension."""

    def __init__(self, n: int, width: int, ids: bytes, labels: bytes, cells: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.cells = np.frombuffer(cells, "<f8").reshape(width, n)
        self.low, self.high = (self.cells.min(1), self.cells.max(1)) if width else (np.zeros(0),) * 2
        self.most = np.abs(self.cells).max(initial=0.0)
        self.squares = np.einsum("ij,ij->j", self.cells, self.cells)
        self.every = np.arange(n)

    def rows(self, label: int, same: bool) -> np.ndarray:
        if self.labels[0] == label and self.labels[-1] == label:  # sorted by label
            return self.every if same else self.every[:0]
        return np.flatnonzero((self.labels == label) == same)


class Anchor:
    """An anchor's components in the order in which it reads dimensions."""

    def __init__(self, own_id: int, label: int, parts: np.ndarray) -> None:
        self.id, self.label = own_id, label
        self.order = np.argsort(-np.abs(parts), kind="stable")
        self.parts = parts[self.order]
        self.most = np.abs(parts).max(initial=0.0)
        self.left = np.sqrt(np.concatenate([np.cumsum((self.parts**2)[::-1])[::-1], [0.0]]))


def scan(anchor: Anchor, tile: Tile, rows: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, exact scores) of those of ``rows`` with a score from low to high, and the
    number of cells that were read for it."""
    order, own = anchor.order, anchor.parts
    if len(order) > len(tile.cells):
        inside = order < len(tile.cells)
        order, own = order[inside], own[inside]
    width, read = len(order), 0
    ends = own * tile.low[order], own * tile.high[order]
    above = np.concatenate([np.cumsum(np.maximum(*ends)[::-1])[::-1], [0.0]])
    below = np.concatenate([np.cumsum(np.minimum(*ends)[::-1])[::-1], [0.0]])
    exact = anchor.most * tile.most * max(1, width) < EXACT
    slack = 1e-9 * (anchor.left[0] * np.sqrt(tile.squares.max(initial=0.0))) + (1e-3 if exact else 1.0)
    if above[0] + slack < low or below[0] - slack > high or not len(rows):
        return rows[:0], np.zeros(0, np.int64), 0
    bitmap = rows
    sums, squares = np.zeros(len(rows)), tile.squares[rows]
    step = max(1, -(-width // STEPS))
    for at in range(0, width, step):
        dims, end = order[at:at + step], min(width, at + step)
        cells = tile.cells[dims] if len(bitmap) == len(tile.ids) else tile.cells[dims[:, None], bitmap]
        read += cells.size
        sums += own[at:end] @ cells
        if end == width:
            break
        squares -= np.einsum("ij,ij->j", cells, cells)
        reach = anchor.left[end] * np.sqrt(np.maximum(squares, 0.0)) + slack
        stays = (sums + np.minimum(above[end] + slack, reach) >= low) & (sums + np.maximum(below[end] - slack, -reach) <= high)
        if not stays.all():
            bitmap, sums, squares = bitmap[stays], sums[stays], squares[stays]
            if not len(bitmap):
                break
    if exact:
        scores = sums.astype(np.int64)
    else:
        whole = [int(x) for x in own]
        scores = np.array([max(-LIMIT - 1, min(LIMIT, sum(a * int(b) for a, b in zip(whole, column, strict=True))))
                           for column in tile.cells[order][:, bitmap].T], np.int64)
    inside = (scores >= low) & (scores <= high)
    return bitmap[inside], scores[inside], read


class Best:
    """The best k (score, id) of those offered, ties to the smaller id."""

    def __init__(self, k: int, low: float, high: float) -> None:
        self.k, self.low, self.high = k, low, high
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        if inside.any():
            ids, scores = np.concatenate([self.ids, ids[inside]]), np.concatenate([self.scores, scores[inside]])
            order = np.lexsort((ids, -scores))[:self.k]
            self.ids, self.scores = ids[order], scores[order]
            if len(order) == self.k:
                self.low = max(self.low, int(self.scores[-1]))


def _search(shared, same: bool):
    """Function for mapInArrow: a task's best rows of every window of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = shared.value
        held = [[(place, Best(k, low, high)) for place, k, low, high in own] for own in windows]
        for batch in batches:
            for row in batch.to_pylist():
                tile = Tile(**row)
                for anchor, own in zip(anchors, held, strict=True):
                    rows = tile.rows(anchor.label, same) if own else ()
                    if not len(rows):
                        continue
                    got, scores, _ = scan(anchor, tile, rows, min(b.low for _, b in own), max(b.high for _, b in own))
                    other = tile.ids[got] != anchor.id
                    for _, best in own:
                        best.offer(tile.ids[got[other]], scores[other])
        found = [(anchor.id, place, i, s) for anchor, own in zip(anchors, held, strict=True)
                 for place, best in own for i, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("anchor_id", "place", "vec_id", "score"), x, strict=True)) for x in found],
            pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    return run


def starts(anchors: list[Anchor], matrix_: np.ndarray, k: int) -> list[float]:
    """A score that an anchor's k-th positive reaches, from the anchors of its label in the block."""
    out = [-np.inf] * len(anchors)
    ids, labels = np.array([a.id for a in anchors]), np.array([a.label for a in anchors])
    if np.abs(matrix_).max(initial=0.0)**2 * max(1, matrix_.shape[1]) >= EXACT:
        return out
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        for part in np.array_split(own, max(1, len(own) // 512)):
            scores = matrix_[part] @ matrix_[own].T
            scores[ids[part][:, None] == ids[own][None, :]] = -np.inf
            if len(own) > k:
                for i, s in zip(part, np.partition(scores, -k, axis=1)[:, -k], strict=True):
                    out[i] = float(s)
    return out


def _merged(spark, path: str, k: int) -> DataFrame:
    """The best k rows of each anchor and place, with their rank; at most k a task are there."""
    own = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, chosen: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
    scale: int = 256, block: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``chosen``, a condition on ``vec_id``, holds. ``window``
    is the range of a negative's score in percent of the positive's. ``block`` bounds the
    anchors that the driver and each task hold at a time.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, scale)
    cut = tiles(rows)
    asked = rows.where(chosen).groupBy("vec_id").agg(F.min(F.struct("label", "parts")).alias("least")).select(
        "vec_id", "least.*")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("parts")).alias("width")).first()
    most = max(1, min(block, VALUES // max(1, size["width"] or 1)))
    parts = 1 if size["n"] <= most else -(-2 * size["n"] // most)
    asked = materialise(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))), "anchors")
    near, far = scratch_path(spark, "positives"), scratch_path(spark, "negatives")
    for path in (near, far):
        spark.createDataFrame([], FOUND).write.parquet(path)

    def blocks() -> Iterator[tuple[pa.Table, list[Anchor], np.ndarray]]:
        for part in range(parts if size["n"] else 0):
            table = asked.where(F.col("part") == part).drop("part").orderBy("vec_id").toArrow()
            for lo in range(0, table.num_rows, most):
                some = table.slice(lo, most).combine_chunks()
                cells = matrix(pa.array(some.column("parts").to_pylist(), pa.list_(pa.float64())))
                yield some, [Anchor(i, lab, c) for i, lab, c in zip(
                    some.column("vec_id").to_pylist(), some.column("label").to_pylist(), cells, strict=True)], cells

    for _, anchors, cells in blocks():
        windows = [[(0, positives, low, LIMIT)] for low in starts(anchors, cells, positives)]
        shared = spark.sparkContext.broadcast((anchors, windows))
        cut.mapInArrow(_search(shared, True), FOUND).write.mode("append").parquet(near)
    found = materialise(_merged(spark, near, positives).select(
        "anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least, most_share = window
    for some, anchors, _ in blocks():
        ids = spark.createDataFrame([(a.id,) for a in anchors], "anchor_id long")
        own: dict[int, list] = {a.id: [] for a in anchors}
        for r in found.join(ids, "anchor_id", "left_semi").toLocalIterator():
            s = r["positive_score"]
            own[r["anchor_id"]].append((r["place"], negatives, -(-least * s // 100), most_share * s // 100))
        windows = [[w for w in own[a.id] if w[2] <= w[3]] for a in anchors]
        shared = spark.sparkContext.broadcast((anchors, windows))
        cut.mapInArrow(_search(shared, False), FOUND).write.mode("append").parquet(far)
    mined = _merged(spark, far, negatives).select(
        "anchor_id", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return mined.join(found, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
