"""Quality rules: base counts, and robust multivariate outliers by language and source.

Base counts come from every whole text. A document fails the base rules if it has under
``min_words`` words, or if more than ``max_repeat`` percent of its words stand in
five-word windows that occur twice or more in it.

The others are vectors of five transformed statistics (log words, log mean word length,
log symbol share, log repeated lines, repeated share). For each language and source the
minimum-covariance-determinant estimate is found by concentration steps: start from
medians and quartile ranges, then again and again take the mean and covariance of the
three quarters of the rows that are nearest by Mahalanobis distance. A document whose
distance, under that estimate scaled to its median and widened by a least deviation of
each statistic, is over ``limit`` is rejected.

A step is one aggregation that combines on the map side: counts, sums and products by
group and distance bin, as exact integers, so that reruns agree and a group with a third
of all rows costs no more than its bins. Sources with under ``min_rows`` rows share one
estimate a language, and languages with under ``min_rows`` such rows one for all.

Nulls and other cases: a null text has no words and fails; null language or source is a
group of its own; groups of equal vectors have only the least deviations; a pool of
under ``p + 2`` rows rejects nothing; repeated rows count as rows; an empty table gives
no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.batches import small_batches
from pluvia.llm.words import runs, word_hashes
from pluvia.session import materialise

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
STATS = ("log_words", "log_length", "log_symbols", "log_lines", "repeats")
LEAST = (0.5, 0.1, 0.25, 0.5, 0.1)  # least standard deviations of the statistics
P = len(STATS)
UNIT = 1024
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MEDIAN_CHI2 = 4.351460191  # fixed value: median of chi-squared with five degrees of freedom
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: np.ndarray, width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    if len(words) <= width:
        return 0
    windows = runs(words, width)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    hit = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(hit):
        return 0
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + width, -1)
    return int((np.cumsum(steps) > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows = []
        for text, words in zip(texts, word_hashes(t.encode("utf-8", "surrogatepass") for t in texts), strict=True):
            rows.append((len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
                         repeated_lines(text), repeated_words(words)))
        columns = list(zip(*rows, strict=True)) or [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(c, pa.int64()) for c in columns],
            ["doc_id", "lang", "source", *COUNTS])


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    return small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text"))
    ).mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _statistics() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = (F.log1p(F.col("n_words")), F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars),
              F.log1p(F.col("n_dup_lines")), F.col("n_repeat_words") / words)
    return [F.round(v * UNIT).cast("long").alias(s) for v, s in zip(values, STATS, strict=True)]


def _pooled(rows: DataFrame, min_rows: int) -> DataFrame:
    """Adds ``pool``: the group whose estimate a row counts to and is judged by."""
    own = materialise(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "quality-groups")
    small = own.where(F.col("n") < min_rows).groupBy("lang").agg(F.sum("n").alias("rest")).withColumnRenamed("lang", "rest_lang")
    named = own.join(small, F.col("lang").eqNullSafe(F.col("rest_lang")), "left").select(
        F.col("lang").alias("own_lang"), F.col("source").alias("own_source"),
        F.when(F.col("n") >= min_rows, F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}))
        .when(F.col("rest") >= min_rows, F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}))
        .otherwise("{}").alias("pool"))
    named = materialise(named, "quality-pools")
    return rows.join(named, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source"))).drop(
        "own_lang", "own_source")


def _start(rows: DataFrame) -> DataFrame:
    """(pool, center, inverse) from medians and quartile ranges of each statistic."""
    long = rows.select("pool", F.explode(F.array(*(
        F.struct(F.lit(i).alias("at"), F.shiftright(F.col(s), 4).alias("bin")) for i, s in enumerate(STATS)))).alias("x"))
    counts = long.groupBy("pool", "x.at", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("pool", "at")
    run = counts.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * 16.0 + 8.0

    quartiles = run.groupBy("pool", "at").agg(*(quantile(q).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))
    least = F.element_at(F.array(*(F.lit(x * UNIT) for x in LEAST)), F.col("at") + 1)
    spread = F.greatest((F.col("q3") - F.col("q1")) / 1.349, least)
    packed = quartiles.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("at", "q2", spread.alias("spread")))).alias("s"))

    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({
                "pool": f["pool"], "center": [[x["q2"] for x in s] for s in f["s"]],
                "inverse": [np.diag([x["spread"] ** -2.0 for x in s]).ravel().tolist() for s in f["s"]]})

    return packed.mapInPandas(invert, "pool string, center array<double>, inverse array<double>")


def distance(center: str = "center", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of the row's statistics."""
    off = [F.col(s) - F.col(center)[i] for i, s in enumerate(STATS)]
    terms = [F.col(inverse)[i * P + j] * off[i] * off[j] * (1.0 if i == j else 2.0) for i, j in PAIRS]
    return reduce(lambda a, b: a + b, terms)


def _binned(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Rows with ``bin``, a sixteenth of a doubling of 1 + distance."""
    known = estimate.withColumnRenamed("pool", "own_pool")
    return rows.join(known, F.col("pool") == F.col("own_pool")).drop("own_pool").withColumn(
        "bin", F.least(F.floor(16 * F.log2(1 + F.greatest(distance(), F.lit(0.0)))), F.lit(500)).cast("int"))


def _covariance(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    n = float(row["n"])
    center = np.array([float(row[f"s{i}"]) for i in range(P)]) / n
    out = np.zeros((P, P))
    for i, j in PAIRS:
        out[i, j] = out[j, i] = float(row[f"p{i}{j}"]) / n - center[i] * center[j]
    return center, out


def _step(rows: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """One concentration step: the estimate from the nearest ``share`` of each pool."""
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(s).alias(f"s{i}") for i, s in enumerate(STATS)),
            *(F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}{j}") for i, j in PAIRS)]
    bins = _binned(rows, estimate).groupBy("pool", "bin").agg(*sums)
    own = Window.partitionBy("pool")
    near = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own)).where(
        F.col("upto") - F.col("n") < share * F.col("all"))
    names = [c for c in bins.columns if c not in ("pool", "bin")]
    total = near.groupBy("pool").agg(*(F.sum(c).alias(c) for c in names))

    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [_covariance(r) for _, r in f.iterrows()]
            floor = np.diag([(0.1 * x * UNIT) ** 2 for x in LEAST])  # keeps equal vectors invertible
            yield pd.DataFrame({"pool": f["pool"], "center": [c.tolist() for c, _ in found],
                                "inverse": [np.linalg.inv(v + floor).ravel().tolist() for _, v in found]})

    return total.mapInPandas(invert, "pool string, center array<double>, inverse array<double>")


def _final(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """(pool, members, center, inverse), scaled to the median distance and widened."""
    bins = _binned(rows, estimate).groupBy("pool", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("pool")
    run = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    middle = run.groupBy("pool").agg(
        F.max("all").alias("members"), F.min(F.when(F.col("upto") >= 0.5 * F.col("all"), F.col("bin"))).alias("bin"))

    def widen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for inverse, bin_ in zip(f["inverse"], f["bin"], strict=True):
                scale = max(1.0, (2 ** ((bin_ + 0.5) / 16) - 1) / MEDIAN_CHI2)
                wide = np.linalg.inv(np.array(inverse).reshape(P, P)) * scale + np.diag([(x * UNIT) ** 2 for x in LEAST])
                out.append(np.linalg.inv(wide).ravel().tolist())
            yield pd.DataFrame({"pool": f["pool"], "members": f["members"], "center": f["center"], "inverse": out})

    return middle.join(estimate, "pool").mapInPandas(
        widen, "pool string, members long, center array<double>, inverse array<double>")


def judge(docs: DataFrame, min_words: int = 10, max_repeat: int = 20, limit: float = 64.0,
          share: float = 0.75, steps: int = 5, min_rows: int = 100) -> DataFrame:
    """(doc_id, counts, base_failed, distance, kept) of every document.

    ``distance`` is the squared Mahalanobis distance, null where the base rules fail.
    """
    counted = materialise(base_counts(docs), "quality-counts")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    rows = counted.withColumn("base_failed", failed)
    vectors = materialise(_pooled(rows.where("not base_failed").select("doc_id", "lang", "source", *COUNTS, *_statistics()), min_rows),
                          "quality-vectors")
    estimate = materialise(_start(vectors), "quality-start")
    for _ in range(steps):
        estimate = materialise(_step(vectors, estimate, share), "quality-step")
    estimate = materialise(_final(vectors, estimate), "quality-estimate").withColumnRenamed("pool", "own_pool")
    judged = vectors.join(estimate, F.col("pool") == F.col("own_pool"), "left").select(
        "doc_id", *COUNTS, F.lit(False).alias("base_failed"), F.round(distance(), 3).alias("distance"),
        (~F.coalesce((F.col("members") >= P + 2) & (distance() > limit), F.lit(False))).alias("kept"))
    out = rows.where("base_failed").select(
        "doc_id", *COUNTS, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.unionByName(out)
