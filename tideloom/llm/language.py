"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector; the vector of a trigram binds (multiplies) those of
its letters, each permuted (rotated) by its place. Texts and languages are bundles (sums) of
their trigrams' vectors, and a text gets the language whose prototype has the largest cosine
with it. Bundling is linear, so a language's prototype is put together from trigram counts,
and a text's dot products are summed trigram by trigram; its own length is the same for all
languages and drops out of the comparison.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

DIMENSIONS = 2048
SEED = 20240531
#: Trigrams whose vectors are in memory at once, trigrams of texts that are counted at once, and letters of a text taken at once.
CHUNK_GRAMS, COUNT_GRAMS, PIECE = 512, 1_000_000, 1 << 18
#: Dot products that a worker keeps.
CACHE_DOTS = 1 << 20
UNDETERMINED = "und"
_POINT_BITS = 21  # of a Unicode code point
_tables: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "letter" not in _tables:
        points = range(0x110000)
        _tables["letter"] = np.fromiter((unicodedata.category(chr(p))[0] == "L" for p in points), bool, len(points))
    return _tables["letter"]


def _letter_vectors(points: np.ndarray) -> np.ndarray:
    """A bipolar vector for each code point, every script alike: the bits of a mixing hash of point and place."""
    words = DIMENSIONS // 64
    with np.errstate(over="ignore"):
        x = (points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(np.ascontiguousarray(x.astype("<u8")).view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def trigram_pieces(text: str) -> Iterator[np.ndarray]:
    """Numbers of the trigrams of the lower-cased text, piece by piece; runs of other characters count as one space; none without a letter."""
    lowered = text.lower()
    held, after_letter = np.zeros(1, np.int64), False
    for at in range(0, len(lowered), PIECE):
        points = np.frombuffer(lowered[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _is_letter()[points]
        keep = letter.copy()
        keep[0] |= after_letter
        keep[1:] |= letter[:-1]
        after_letter = bool(letter[-1])
        held = np.concatenate([held, np.where(letter, points, 0)[keep].astype(np.int64)])
        if len(held) > 2:
            yield _numbers(held)
            held = held[-2:]
    if len(held) > 1:
        yield _numbers(np.append(held, 0))


def _numbers(points: np.ndarray) -> np.ndarray:
    return (points[:-2] << 2 * _POINT_BITS) | (points[1:-1] << _POINT_BITS) | points[2:]


def trigrams(text: str) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *trigram_pieces(text)])


def vectors(grams: np.ndarray) -> np.ndarray:
    mask = (1 << _POINT_BITS) - 1
    points, at = np.unique(np.stack([grams >> 2 * _POINT_BITS, grams >> _POINT_BITS & mask, grams & mask]), return_inverse=True)
    letters = _letter_vectors(points)
    first, second, third = at.reshape(3, len(grams))
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept from learning: by its id's CRC; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def prototypes(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototype of each language, from all labelled texts.

    Rows with a null text or language, and texts without letters, teach nothing. Spark sums
    the counts of trigrams; every partition of them bundles its own, and the bundles are
    summed place by place, so that a task holds one vector a language, however many
    trigrams a script has. The sums are of whole numbers, the same in any order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for name in sorted(waiting):
                seen, n = np.unique(np.concatenate(waiting[name]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(n)], ["lang", "gram", "n"])
            waiting.clear()

        for batch in batches:
            for value, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for grams in trigram_pieces(value.as_py()):
                    waiting.setdefault(name, []).append(grams)
                    size += len(grams)
                    if size > COUNT_GRAMS:
                        yield from counted()
                        size = 0
        yield from counted()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            named = batch.column(0).dictionary_encode()
            which, grams, n = named.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
            for i, name in enumerate(named.dictionary.to_pylist()):
                own, times = grams[which == i], n[which == i]
                sums = total.setdefault(name, np.zeros(DIMENSIONS))
                for at in range(0, len(own), CHUNK_GRAMS):
                    sums += times[at : at + CHUNK_GRAMS] @ vectors(own[at : at + CHUNK_GRAMS])
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(sums)], ["lang", "place", "value"])

    source = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    counts = map_batches(source, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    places = map_batches(counts, bundle, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    learned: dict[str, np.ndarray] = {}
    for r in sorted(places.collect()):  # DIMENSIONS rows a language
        learned.setdefault(r.lang, np.zeros(DIMENSIONS))[r.place] = r.value
    return {name: v / (float(np.linalg.norm(v)) or 1.0) for name, v in learned.items()}


def identify(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the language and a score from 0 to 1: the best cosine's share of all positive cosines.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing
    was learned. Equal cosines go to the language first in order.
    Columns of ``docs`` stay; those named as the new ones are replaced.
    """
    docs = docs.drop(*into)
    names = list(learned)
    matrix = np.array([learned[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)
    place = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(CHUNK_GRAMS, CACHE_DOTS // max(1, len(names)))
        cache = {"grams": np.empty(0, np.int64), "dots": np.empty((0, len(names)))}

        def dots(grams: np.ndarray) -> np.ndarray:
            """Dot products of sorted, distinct trigrams, ``limit`` at most, with all languages."""
            fresh = np.setdiff1d(grams, cache["grams"], assume_unique=True)
            if len(fresh):
                if len(cache["grams"]) + len(fresh) > limit:
                    fresh, cache["grams"], cache["dots"] = grams, cache["grams"][:0], cache["dots"][:0]
                made = [vectors(fresh[at : at + CHUNK_GRAMS]) @ matrix.T for at in range(0, len(fresh), CHUNK_GRAMS)]
                held = np.concatenate([cache["grams"], fresh])
                order = np.argsort(held)
                cache["grams"], cache["dots"] = held[order], np.concatenate([cache["dots"], *made])[order]
            return cache["dots"][np.searchsorted(cache["grams"], grams)]

        def summed(text: str) -> np.ndarray | None:
            total = None
            for piece in trigram_pieces(text):
                grams, n = np.unique(piece, return_counts=True)
                total = np.zeros(len(names)) if total is None else total
                for at in range(0, len(grams), limit):
                    total += n[at : at + limit] @ dots(grams[at : at + limit])
            return total

        for batch in batches:
            langs, scores = [], []
            for value in batch.column(place):
                cosines = summed(value.as_py() or "") if names else None
                if cosines is None:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                best = int(np.argmax(cosines))
                positive = float(np.maximum(cosines, 0).sum())
                langs.append(names[best])
                scores.append(float(max(cosines[best], 0.0)) / positive if positive else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *into]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])
    return map_batches(docs, predict, schema)
