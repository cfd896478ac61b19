"""Exact top-k inner products with bounds from segment means and deviations.

A vector of d components is cut into segments. For a segment of m components with means
p, q and standard deviations s, t the squared distance of two vectors is at least
``m * ((p - q)^2 + (s - t)^2)``; as ``q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2``, their inner
product is at most ``m * (p * q + s * t)`` summed over the segments. The bounds are taken
with few wide segments first and many narrow ones for the rest; only pairs whose bound
reaches the query's current k-th best get their exact score. Bounds are raised by
their rounding error, so no answer is lost.

The queries are worked off in blocks of at most ``block`` vectors. A block is broadcast
(its size is bounded by ``block`` times the width), every partition of the candidates
returns its own best k of each query, and a window of at most k rows per partition and
query merges them. Starting bars come from the block itself: its members are
candidates of each other.

Components become ``floor(scale * x)`` as long integers; scores are exact (float64
products only where every partial sum stays under 2^53, else integers; a score beyond
64 bits is held at the end of the range).

Nulls and other cases: a vector that is null, or holds null or a non-finite component,
takes no part, nor does a row without id; vectors of unequal width are padded with
zeros; an empty vector scores 0; ties go to the smaller id; repeated candidate rows
count as often as they appear, a repeated query id is answered once, for the smallest of
its vectors; rows with the query's id are never its candidates; an empty table gives no
rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.session import scratch_path

LEVELS = (4, 16)
CHUNK = 2048
EXACT_FLOAT = 2.0**53
LIMIT = 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, parts): integer components of the vectors that take part; parts as doubles."""
    part = F.col("embedding").cast("array<double>")
    broken = F.exists(part, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & part.isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), part.alias("parts"), broken.alias("broken")
    ).where(~F.col("broken")).drop("broken")


def integers(rows: list, scale: int, width: int) -> np.ndarray:
    """floor(scale * x), padded with zeros to ``width``, as integers held exactly in float64
    or, beyond 2^53, as Python integers."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    out = np.floor(out * scale)
    if not np.isfinite(out).all() or np.abs(out).max(initial=0) >= EXACT_FLOAT:
        return np.array([[int(np.floor(x)) * scale if abs(x) >= EXACT_FLOAT else int(np.floor(x * scale))
                          for x in [*row, *[0.0] * (width - len(row))]] for row in rows], object).reshape(len(rows), width)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``."""
    if a.dtype == object or b.dtype == object:
        exact = a.astype(object) @ b.astype(object).T
        return np.array([[max(-LIMIT - 1, min(LIMIT, int(x))) for x in r] for r in exact], np.int64).reshape(exact.shape)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT_FLOAT:
        return (a @ b.T).astype(np.int64)
    if most < LIMIT:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return scores(np.vectorize(int, otypes=[object])(a) if a.size else a.astype(object), b)


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(m) * (mean, deviation) of each segment: dot products of these bound scores."""
    x = x.astype(float)
    cuts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    parts = [(np.sqrt(len(c)) * x[:, c].mean(1), np.sqrt(len(c)) * x[:, c].std(1)) for c in cuts if len(c)]
    return np.stack([y for pair in parts for y in pair], 1) if parts else np.zeros((len(x), 1))


def best(ids: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -found))[:k] if len(ids) else np.zeros(0, int)


class Search:
    """Best k of each query over the candidates that are fed to it."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.floats = queries.astype(float)
        self.levels = [summaries(queries, s) for s in LEVELS]
        self.norms = np.sqrt((self.floats**2).sum(1))
        self.bars = np.full(len(ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2 for _ in ids]
        self.counted = 0

    def start(self) -> None:
        """Bars from the queries' scores among themselves; nothing is kept of them."""
        for lo in range(0, len(self.ids), CHUNK):
            part = scores(self.queries[lo:lo + CHUNK], self.queries).astype(float)
            part[self.ids[lo:lo + CHUNK, None] == self.ids[None, :]] = -np.inf
            if part.shape[1] > self.k:
                self.bars[lo:lo + CHUNK] = np.partition(part, -self.k, axis=1)[:, -self.k]

    def feed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        size = np.sqrt((vectors.astype(float)**2).sum(1))
        slack = 1e-9 * (self.norms[:, None] * size[None, :]) + 1e-6
        coarse = self.levels[0] @ summaries(vectors, LEVELS[0]).T
        q, c = np.nonzero((coarse + slack >= self.bars[:, None]) & (self.ids[:, None] != ids[None, :]))
        for level, segments in list(zip(self.levels, LEVELS, strict=True))[1:]:
            own, keep = summaries(vectors, segments), []
            for lo in range(0, len(q), 1 << 18):
                a, b = q[lo:lo + (1 << 18)], c[lo:lo + (1 << 18)]
                keep.append(np.einsum("ij,ij->i", level[a], own[b]) + slack[a, b] >= self.bars[a])
            mask = np.concatenate(keep) if keep else np.zeros(0, bool)
            q, c = q[mask], c[mask]
        self.counted += len(q)
        ends = np.searchsorted(q, np.arange(len(self.ids) + 1))
        for i in np.flatnonzero(np.diff(ends)):
            some = c[ends[i]:ends[i + 1]]
            got = scores(self.queries[i:i + 1], vectors[some])[0]
            all_ids = np.concatenate([self.found[i][0], ids[some]])
            all_scores = np.concatenate([self.found[i][1], got])
            top = best(all_ids, all_scores, self.k)
            self.found[i] = all_ids[top], all_scores[top]
            if len(top) == self.k:
                self.bars[i] = max(self.bars[i], float(all_scores[top[-1]]))


def _own_best(block, k: int, scale: int):
    """Function for mapInArrow: a partition's best k of each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = block.value
        search = None
        for batch in batches:
            table = batch.to_pydict()
            for lo in range(0, len(table["vec_id"]), CHUNK):
                own, parts = np.array(table["vec_id"][lo:lo + CHUNK], np.int64), table["parts"][lo:lo + CHUNK]
                width = max([len(r) for r in rows] + [len(r) for r in parts])
                if search is None or search.queries.shape[1] < width:
                    old, search = search, Search(ids, integers(rows, scale, width), k)
                    if old is None:
                        search.start()
                    else:
                        search.found, search.bars = old.found, old.bars
                search.feed(own, integers(parts, scale, search.queries.shape[1]))
        if search is not None:
            sizes = [len(f[0]) for f in search.found]
            yield pa.RecordBatch.from_pydict({
                "query_id": np.repeat(ids, sizes),
                "vec_id": np.concatenate([f[0] for f in search.found]),
                "score": np.concatenate([f[1] for f in search.found])})

    return run


def top_k(vectors: DataFrame, chosen: Column, k: int = 10, scale: int = 1024, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row for which ``chosen`` holds.

    ``chosen`` is a condition on ``vec_id``. ``block`` bounds the queries that are held at
    a time by the driver and each task.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    queries = rows.where(chosen).groupBy("vec_id").agg(F.min("parts").alias("parts"))
    asked = queries.count()
    blocks = max(1, -(-2 * asked // block) if asked > block else 1)
    path = scratch_path(spark, "topk")
    empty = spark.createDataFrame([], "query_id long, vec_id long, score long")
    empty.write.parquet(path)
    numbered = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    for at in range(blocks if asked else 0):
        got: pd.DataFrame = numbered.where(F.col("part") == at).select("vec_id", "parts").toPandas()
        for lo in range(0, len(got), block):
            some = got.iloc[lo:lo + block]
            shared = spark.sparkContext.broadcast((some["vec_id"].to_numpy(np.int64), [list(p) for p in some["parts"]]))
            rows.mapInArrow(_own_best(shared, k, scale), "query_id long, vec_id long, score long").write.mode("append").parquet(path)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = spark.read.schema(empty.schema).parquet(path)
    return merged.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
