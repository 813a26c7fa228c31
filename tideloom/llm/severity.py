"""Toxic severity by cumulative-link ordinal regression on sparse word features.

The grades' cumulative probabilities share one weight for each feature and differ only in
ordered thresholds: P(grade <= j) = sigmoid(t_j - w.x). Features are the words of a text and
the beginnings of its longer words. A first fit on a bounded sample of labelled documents
selects the features that matter, a second one weighs them; every document is then scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

#: Labelled documents that the model is fitted on, drawn by a hash of the id; features it may use, by documents that have them.
TRAINING_ROWS, VOCABULARY, LEAST_DOCUMENTS = 20_000, 65_536, 5
#: Both fits: steps and penalty; of the first, features of this share of the largest weight are kept.
STEPS, PENALTIES, KEPT_SHARE, RATE = (150, 400), (1e-3, 2e-4), 0.12, 0.05
BEGINNING = 5
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """The lower-cased words, and the beginnings (marked) of those longer than one."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING}


@dataclass(frozen=True)
class Ordinal:
    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, found: set[str]) -> float:
        return sum(self.weights[w] for w in sorted(self.weights.keys() & found))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """One column for each grade."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))
        upto = np.concatenate([np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1))], axis=1)
        return np.diff(upto, axis=1)


def _descend(owner: np.ndarray, columns: np.ndarray, width: int, grades: np.ndarray, levels: int, steps: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised loss, by Adam on the whole sample."""
    rows = len(grades)
    n = max(1, rows)
    shares = np.clip([(grades <= j).mean() if rows else 0.5 for j in range(levels - 1)], 1e-3, 1 - 1e-3)
    first = np.log(shares / (1 - shares))
    # w, the first threshold, and the logarithms of the gaps between thresholds, which keep them in order.
    state = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    mean, square = np.zeros_like(state), np.zeros_like(state)

    def ordered(values: np.ndarray) -> np.ndarray:
        return values[0] + np.concatenate([[0.0], np.cumsum(np.exp(values[1:]))])

    at = np.arange(rows)
    for step in range(1, steps + 1):
        w, cuts = state[:width], ordered(state[width:])
        scores = np.bincount(owner, w[columns], n)[:rows]
        upto = 1 / (1 + np.exp(-np.clip(cuts[None, :] - scores[:, None], -60, 60)))
        padded = np.concatenate([np.zeros((rows, 1)), upto, np.ones((rows, 1))], axis=1)
        high, low = padded[at, grades + 1], padded[at, grades]
        slope = upto * (1 - upto) / np.maximum(high - low, 1e-12)[:, None]
        by_cut = np.array([slope[grades == j + 1, j].sum() - slope[grades == j, j].sum() for j in range(levels - 1)])
        by_w = np.bincount(columns, (1 - high - low)[owner], width)[:width] / n + penalty * w
        tails = np.cumsum(by_cut[::-1])[::-1] / n
        gradient = np.concatenate([by_w, tails[:1], tails[1:] * np.exp(state[width + 1 :])])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        state = state - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return state[:width], ordered(state[width:])


def fit(found: pa.ListArray, grades: np.ndarray, levels: int) -> Ordinal:
    """The model of documents' features (lists without repeats) and grades; deterministic."""
    owner = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = found.flatten().dictionary_encode()
    columns, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()

    def narrowed(kept: list[int]) -> None:
        nonlocal owner, columns, names
        place = np.full(len(names), -1)
        place[kept] = np.arange(len(kept))
        inside = place[columns] >= 0 if len(names) else np.zeros(0, bool)
        owner, columns, names = owner[inside], place[columns[inside]] if len(names) else columns, [names[i] for i in kept]

    counts = np.bincount(columns, minlength=len(names))
    often = np.flatnonzero(counts >= LEAST_DOCUMENTS)
    narrowed(sorted(sorted(often.tolist(), key=lambda i: (-counts[i], names[i]))[:VOCABULARY], key=lambda i: names[i]))
    weights, _ = _descend(owner, columns, len(names), grades, levels, STEPS[0], PENALTIES[0])
    size = np.abs(weights)
    narrowed(np.flatnonzero(size >= KEPT_SHARE * size.max()).tolist() if len(size) else [])
    weights, cuts = _descend(owner, columns, len(names), grades, levels, STEPS[1], PENALTIES[1])
    return Ordinal(dict(zip(names, weights.tolist(), strict=True)), cuts)


def learn(docs: DataFrame, graded: DataFrame, levels: int, rows: int = TRAINING_ROWS) -> Ordinal:
    """Fit on at most ``rows`` documents with a grade (0 to ``levels`` - 1); null ids, texts and grades teach nothing."""
    labelled = graded.select("doc_id", F.col("grade").cast("int").alias("grade")).dropna().where(F.col("grade").between(0, levels - 1))
    drawn = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(rows)
    # At most `rows` narrow rows.
    joined = docs.select("doc_id", "text").dropna().join(F.broadcast(drawn), "doc_id")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), batch.column(2)], ["doc_id", "found", "grade"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    reduced = map_batches(joined, reduce, f"doc_id {kind}, found array<string>, grade int")
    taken = reduced.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(rows).select("found", "grade").toArrow().combine_chunks()
    lists = [c.cast(pa.list_(pa.string())) for c in taken.column(0).chunks]
    found = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.string()))
    return fit(found, np.array(taken.column(1).to_pylist(), dtype=np.int64), levels)


def score(docs: DataFrame, model: Ordinal, text: str = "text", into: tuple[str, str, str] = ("severity", "grade", "p_toxic")) -> DataFrame:
    """Add the expected grade, the likeliest grade (the lower of equals) and the chance of any grade but 0.

    A null or empty text has no features and gets what the thresholds alone give. Columns named
    as the new ones are replaced.
    """
    docs = docs.drop(*into)
    place = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(features(t.as_py())) for t in batch.column(place)], float)
            chances = model.probabilities(scores)
            added = [pa.array(chances @ np.arange(chances.shape[1])), pa.array(chances.argmax(axis=1), pa.int32()), pa.array(1 - chances[:, 0])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.DoubleType()), T.StructField(into[1], T.IntegerType()), T.StructField(into[2], T.DoubleType())])
    return map_batches(docs, add, schema)
