"""Toxicity: a logistic classifier of words and word beginnings, regularised by swapped identity terms.

Labelled texts that mention a group get a counterfactual: each identity term is replaced by the next of its kind. The
squared change of the score between a text and its counterfactual is added to the loss, so that a mention of a group
cannot carry the verdict and neutral mentions are not rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherescore.llm.common import whole_text
from wherescore.sources.scratch import settle

#: Terms of one kind are swapped for each other. Any such table can be passed in.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("african", "european", "american", "arab", "mexican", "chinese"),
    ("young", "old", "disabled", "deaf", "blind"),
    ("immigrants", "refugees", "citizens", "foreigners"),
)
#: Labelled rows that the classifier is fitted on, at most (in expectation): ids with the lowest hashes.
MAX_TRAINING_ROWS = 20_000
#: Features that the classifier keeps: those whose counts differ most between the labels.
VOCABULARY = 4_096
PREFIXES = (4, 5)
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")


def held_out() -> Column:
    """Rows that labels are never learnt from: crc32 of the id's digits divides by 5. A null id is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def swaps(groups: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """Each term with the one that replaces it."""
    return {a: b for terms in groups for a, b in zip(terms, terms[1:] + terms[:1], strict=True)}


def features(words: set[str]) -> set[str]:
    """Words, and beginnings of longer ones (marked by a star)."""
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + "*" for w in words if len(w) > n)
    return found


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    """Weights by feature; small, as the vocabulary is bounded."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        words = words_of(text)
        known = self.weights
        total = self.bias + sum(known[w] for w in known.keys() & words)
        for n in PREFIXES:
            total += sum(known[w] for w in known.keys() & {w[:n] + "*" for w in words if len(w) > n})
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Distinct texts with their label (text, toxic), of a sample of labelled ids outside the held-out fold.

    A repeated label counts as toxic if any of its rows does; null labels and null ids are left out. The sample takes the
    share ``max_rows`` / number of labels of all hash values, so it is bounded and the same for the same ids.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_rows / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", whole_text().alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id")  # the sample's size is bounded by max_rows
    return joined.select("text", "toxic", F.xxhash64("text").alias("_h")).dropDuplicates(["_h", "toxic"]).drop("_h")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic > 0].update(features(words_of(text)))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict(
            {
                "feature": pa.array(names, pa.string()),
                "clean": pa.array([counts[0][n] for n in names], pa.int64()),
                "toxic": pa.array([counts[1][n] for n in names], pa.int64()),
            }
        )


def vocabulary(rows: DataFrame, size: int = VOCABULARY, least: int = 5) -> list[str]:
    """The ``size`` features, found in at least ``least`` texts, whose share of toxic texts is furthest from the whole."""
    totals = rows.agg(F.count_if(F.col("toxic") > 0), F.count("*")).first()
    rate = (totals[0] + 0.5) / (totals[1] + 1)
    counts = rows.mapInArrow(_count, "feature string, clean long, toxic long").groupBy("feature")
    n = F.col("n")
    gain = F.abs(F.col("toxic") - n * rate) / F.sqrt(n * rate * (1 - rate))
    top = (
        counts.agg(F.sum("toxic").alias("toxic"), F.sum(F.col("toxic") + F.col("clean")).alias("n"))
        .where(n >= least)
        .orderBy(gain.desc(), "feature")
        .limit(size)
    )
    return [r[0] for r in top.select("feature").collect()]


def _indexed(vocabulary: list[str], replace: dict[str, str]):
    """Turns texts into the positions of their features, and of those that swapping identity terms adds and removes."""
    index = {f: i for i, f in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[list[int]]] = [[], [], []]
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                own = features(words)
                other = features({replace.get(w, w) for w in words}) if replace.keys() & words else own
                for column, names in zip(columns, (own, other - own, own - other), strict=True):
                    column.append(sorted(index[f] for f in index.keys() & names))
            arrays = [pa.array(c, pa.list_(pa.int32())) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *arrays], ["toxic", "own", "added", "removed"])

    return run


def _entries(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each entry of a sparse matrix of ones."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.concatenate([*lists, np.empty(0, np.int32)]).astype(np.int64)


def descend(
    own: list[np.ndarray],
    added: list[np.ndarray],
    removed: list[np.ndarray],
    toxic: np.ndarray,
    size: int,
    fairness: float,
    ridge: float,
    steps: int = 400,
) -> tuple[float, np.ndarray]:
    """Bias and weights of least mean log loss + fairness x mean squared score change + ridge x squared weights."""
    n, w, rate = len(toxic), np.zeros(size), (toxic.sum() + 0.5) / (len(toxic) + 2)
    bias = float(np.log(rate / (1 - rate)))
    parts = [_entries(x) for x in (own, added, removed)]
    first, second, fb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        scores, plus, minus = (np.bincount(r, w[c], n) for r, c in parts)
        error = (1 / (1 + np.exp(-np.clip(bias + scores, -500, 500))) - toxic) / n
        change = 2 * fairness * (plus - minus) / n
        gradient = 2 * ridge * w
        for (r, c), x in zip(parts, (error, change, -change), strict=True):
            gradient = gradient + np.bincount(c, x[r], size)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        g = error.sum()
        fb, sb = 0.9 * fb + 0.1 * g, 0.999 * sb + 0.001 * g * g
        rate_t = 0.05 * min(1.0, 2 * (1 - t / (steps + 1)))
        w -= rate_t * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        bias -= rate_t * (fb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-9)
    return bias, w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_TRAINING_ROWS,
    size: int = VOCABULARY,
    fairness: float = 1.0,
    ridge: float = 1e-5,
    identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
) -> Model:
    """The classifier. Spark samples, counts and indexes; at most ``max_rows`` lists of positions reach the driver.

    Without toxic or without clean rows the score is the smoothed share of toxic rows, 0.25 if there are no rows.
    """
    rows = settle(training_rows(docs, labels, max_rows))
    replace = swaps(identity)
    names = vocabulary(rows, size)
    names += sorted(replace.keys() - set(names))
    found = rows.mapInArrow(
        _indexed(names, replace), "toxic int, own array<int>, added array<int>, removed array<int>"
    ).toPandas()
    toxic = (found["toxic"].to_numpy() > 0).astype(float)
    if not len(toxic) or toxic.min() == toxic.max():
        rate = (toxic.sum() + 0.5) / (len(toxic) + 2)
        return Model(float(np.log(rate / (1 - rate))))
    order = sorted(range(len(toxic)), key=lambda i: (toxic[i], *found["own"][i]))  # tasks end in any order
    own, added, removed = ([np.asarray(x, np.int32) for x in found[c].to_numpy()[order]] for c in ("own", "added", "removed"))
    bias, weights = descend(own, added, removed, toxic[order], len(names), fairness, ridge)
    return Model(bias, {n: float(x) for n, x in zip(names, weights, strict=True) if abs(x) > 1e-6})


def score(model: Model, text: str = "text") -> Column:
    """Score of a text column, 0 to 1; null texts score as empty ones."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")

    return scored(whole_text(text))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Only the text reaches the score."""
    return docs.select("doc_id", held_out().alias("held_out"), score(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, all columns as they are. An empty table gives no rows."""
    return docs.where(score(model) < threshold)
