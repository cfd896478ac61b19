"""Toxicity classifier, regularised by swapping identity terms.

A logistic model over the words of a whole text and their first four to six letters
(which carry over to unseen forms). Features are chosen by a chi-squared test of presence
against label. Besides the usual loss and a ridge penalty, training adds the squared
change of the score's logit when each identity term in a labelled sentence is swapped
for another of its group, so that naming a group cannot move the score much however
often it stands in toxic examples.

The fit is one task over at most ``fit_rows`` labelled documents, those with the least
hash of their id; the bound is the documented size of the sample and does not grow. The
model is a table of at most ``max_features`` weights, so broadcasting it is bounded too.
Every document is scored, in one pass without a shuffle.

Nulls and other cases: a null or empty text has the score of no features at all; labels
that are null or not 0 or 1, and rows without id, teach nothing; an id labelled more
than once counts with its largest label; repeated rows get equal scores; without
labels of both kinds the score is the share of toxic labels (0 without any); an empty
table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.batches import small_batches
from pluvia.session import materialise

# Terms that name groups of people, each list exchangeable.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "natives", "refugees", "foreigners"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def features_of(word: str) -> tuple[str, ...]:
    """The word and its first letters."""
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n))


def features_of_all(words: Iterable[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swapped(words: set[str], partner: dict[str, str]) -> set[str]:
    """The words with each identity term replaced by another of its group."""
    return {partner.get(w, w) for w in words}


def partners(groups: Sequence[Sequence[str]]) -> dict[str, str]:
    """Each term leads to the next one of its group."""
    return {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g) if len(g) > 1}


def chosen_features(rows: Iterable[set[str]], labels: np.ndarray, least_chi2: float, max_features: int) -> list[str]:
    """Features whose presence goes with the label, the strongest first."""
    all_, toxic = Counter(), Counter()
    for features, label in zip(rows, labels, strict=True):
        all_.update(features)
        if label:
            toxic.update(features)
    n, n1 = len(labels), int(labels.sum())
    scored = []
    for f, c in all_.items():
        if c < 2:
            continue
        expected = c * n1 / n
        gap = abs(toxic[f] - expected) - 0.5
        variance = expected * (1 - n1 / n) * (n - c) / max(1, n - 1)
        if gap > 0 and variance > 0 and gap * gap / variance >= least_chi2:
            scored.append((-gap * gap / variance, f))
    return [f for _, f in sorted(scored)[:max_features]]


class Sparse:
    """Rows of feature numbers as one flat list."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.width = width
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.array([x for r in rows for x in r], np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.flat], len(self.sizes))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, g[self.owner], self.width)


def fit(texts: Sequence[str | None], labels: np.ndarray, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS,
        swap_penalty: float = 5.0, ridge: float = 1e-4, rounds: int = 300,
        least_chi2: float = 12.0, max_features: int = 4096) -> tuple[list[str], np.ndarray, float]:
    """(features, weights, bias) of labelled texts; only chosen features are held for all of them."""
    n1, n = int(labels.sum()), len(labels)
    if n1 == 0 or n1 == n:
        share = min(max(n1 / n if n else 0.0, 1e-9), 1 - 1e-9)
        return [], np.zeros(0), float(np.log(share / (1 - share)))
    partner = partners(groups)
    names = chosen_features((features_of_all(words_of(t)) for t in texts), labels, least_chi2, max_features)
    number = {f: i for i, f in enumerate(names)}

    def numbers(features: set[str]) -> list[int]:
        return sorted(number[f] for f in features if f in number)

    rows, twins = [], []
    for text in texts:
        words = words_of(text)
        rows.append(numbers(features_of_all(words)))
        if not words.isdisjoint(partner):
            twins.append((rows[-1], numbers(features_of_all(swapped(words, partner)))))
    x = Sparse(rows, len(names))
    left, right = Sparse([a for a, _ in twins], len(names)), Sparse([b for _, b in twins], len(names))
    w, bias = np.zeros(len(names)), float(np.log(n1 / (n - n1)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):  # Adam on the whole sample
        error = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -40, 40))) - labels
        gradient = x.back(error) / n + ridge * w
        if twins:
            change = left.dot(w) - right.dot(w)
            gradient += swap_penalty * (left.back(change) - right.back(change)) / n
        full = np.append(gradient, error.sum() / n)
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return names, w, bias


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


MODEL = "features array<string>, weights array<double>, bias double"


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 8192, **options) -> DataFrame:
    """One row (features, weights, bias), fitted to at most ``fit_rows`` labelled documents.

    ``labels`` has doc_id and toxic (0 or 1).
    """
    known = (labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sample = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "toxic-sample")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("doc_id", "text", "toxic")

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")  # the sum's order, and so the model, is fixed
        names, weights, bias = fit(frame["text"].tolist(), frame["toxic"].to_numpy(float), **options)
        return pd.DataFrame({"features": [names], "weights": [weights.tolist()], "bias": [bias]})

    return materialise(rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fitted, MODEL), "toxic-model")


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        whole = frozenset(f for f in weights if f[-1] != "*")
        four, five, six = (frozenset(f[:-1] for f in weights if f[-1] == "*" and len(f) == n + 1) for n in PREFIXES)
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                # few words have a feature with a weight, and only those are looked at closely
                near = [w for w in words_of(text) if w in whole or w[:4] in four or w[:5] in five or w[:6] in six]
                hit = {f for w in near for f in features_of(w) if f in weights}
                scores.append(1 / (1 + np.exp(-np.clip(bias + sum(weights[f] for f in sorted(hit)), -40, 40))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: DataFrame, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    spark = small_batches(docs).sparkSession
    row = model.first()
    weights = dict(zip(row["features"], row["weights"], strict=True)) if row else {}
    shared = spark.sparkContext.broadcast((weights, row["bias"] if row else -40.0))  # at most max_features numbers
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _score(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under ``cut``, with their columns as they are.

    The score travels with the row, so nothing is joined or shuffled.
    """
    row = model.first()
    weights = dict(zip(row["features"], row["weights"], strict=True)) if row else {}
    shared = small_batches(docs).sparkSession.sparkContext.broadcast((weights, row["bias"] if row else -40.0))
    inner = _score(shared)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.nulls(len(batch), pa.int64())
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            scores = next(inner(iter([pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])]))).column("score")
            yield batch.filter(pa.array(scores.to_numpy() < cut))

    return docs.mapInArrow(keep, docs.schema)
