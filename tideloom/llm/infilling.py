"""Fill-in-the-middle examples: texts cut at units, found through a wavelet matrix over character classes.

The bytes of a batch of texts are mapped to eight classes and held in one wavelet matrix,
which tells how many bytes of a class stand before any position. A unit (a line, a sentence,
a word) ends with a byte of some classes, so that the ranks of these classes add up to the
number of ends before a position; from that follow the units of each text and, by bisection
on the ranks, for all texts of the batch at once, the two positions to cut at. Ranks of the
continuation bytes turn byte positions into code points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .packing import slices

OTHER, NEWLINE, BLANK, STOP, DIGIT, LETTER, LEAD, CONTINUATION = range(8)
CLASS_BITS = 3
#: Classes whose bytes end a unit; what stands after the last end is a unit too.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (NEWLINE, BLANK)}
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text that one matrix holds, or one text; the matrix and its building take about five times as much.
SLICE_BYTES = 4_000_000


def _class_of() -> np.ndarray:
    classes = np.full(256, OTHER, np.uint8)
    for members, kind in ((b"\n", NEWLINE), (b" \t\v\f\r", BLANK), (b".!?", STOP)):
        classes[list(members)] = kind
    for low, high, kind in (("0", "9", DIGIT), ("A", "Z", LETTER), ("a", "z", LETTER)):
        classes[ord(low) : ord(high) + 1] = kind
    classes[0x80:0xC0], classes[0xC0:] = CONTINUATION, LEAD
    return classes


_CLASS_OF = _class_of()


class WaveletMatrix:
    """How often each symbol stands before a position, from one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int = CLASS_BITS):
        self.levels = []
        for shift in reversed(range(bits)):
            ones = (symbols >> np.uint8(shift) & np.uint8(1)).astype(bool)
            packed = np.zeros(len(symbols) // 64 * 8 + 8, np.uint8)
            packed[: -(-len(symbols) // 8)] = np.packbits(ones, bitorder="little")
            words = packed.view("<u8")
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((shift, words, before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _walk(self, symbol: int, at: np.ndarray) -> np.ndarray:
        for shift, words, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = zeros + ones if symbol >> shift & 1 else at - ones
        return at

    def rank(self, symbols: Sequence[int], at: np.ndarray) -> np.ndarray:
        """How many of the symbols stand before the positions ``at``."""
        at = np.asarray(at, np.int64)
        first = np.zeros(1, np.int64)
        return sum((self._walk(s, at) - self._walk(s, first) for s in symbols), np.zeros_like(at))


def unit_counts(matrix: WaveletMatrix, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, closing: Sequence[int]) -> np.ndarray:
    """The number of units of each text ``data[start:end]``."""
    closed = matrix.rank(closing, ends) - matrix.rank(closing, starts)
    filled = np.flatnonzero(ends > starts)
    closed[filled] += ~np.isin(data[ends[filled] - 1], closing)
    return closed


def cuts(matrix: WaveletMatrix, starts: np.ndarray, ends: np.ndarray, closing: Sequence[int], units: np.ndarray) -> np.ndarray:
    """The position after the first ``units`` units of each text: the least one with so many ends before it, else the text's end."""
    low, high = starts.copy(), ends.copy()
    wanted = matrix.rank(closing, starts) + units
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        enough = matrix.rank(closing, middle) >= wanted[open_]
        high[open_[enough]] = middle[enough]
        low[open_[~enough]] = middle[~enough] + 1
    return low


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and where each begins, the last one's end included."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def infilled(
    docs: DataFrame,
    unit: str = "line",
    rate: int = 100,
    spm_rate: int = 50,
    seed: int = 7,
    sentinels: tuple[str, str, str] = SENTINELS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row.

    The text's ``n`` units are cut into prefix, middle and suffix at two of the ``n + 1`` places
    before, between and after them, drawn by the hash of ``seed`` and the id. The form is
    ``psm`` (prefix, suffix, middle), for ``spm_rate`` of a hundred ``spm`` (suffix, prefix,
    middle), each part behind its sentinel; or ``plain``: the text as it is, for an empty text,
    one that contains a sentinel, and all but ``rate`` of a hundred.

    A null text counts as empty. Null ids hash alike, as no id. Repeated rows get equal results.
    Texts of any length are cut as a whole; other columns are not read, whatever their names; an
    empty table gives an empty result.
    """
    closing = np.array(UNITS[unit])
    kind = docs.schema[doc_id].dataType
    marks = [s.encode() for s in sentinels]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(1), SLICE_BYTES):
                yield one_slice(batch.slice(first, last - first))

    def one_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column(1), "")
        h1, h2, h3, h4 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
        data, offsets = _bytes_of(texts)
        classes = _CLASS_OF[data]
        matrix = WaveletMatrix(classes)
        starts, ends = offsets[:-1], offsets[1:]
        n = unit_counts(matrix, classes, starts, ends, closing)
        before, after = h1 % (n + 1), h2 % (n + 1)
        one = cuts(matrix, starts, ends, closing, np.minimum(before, after))
        two = cuts(matrix, starts, ends, closing, np.maximum(before, after))
        inner = matrix.rank((CONTINUATION,), np.stack([starts, one, two]))
        chars = np.stack([starts, one, two]) - inner
        marked = pc.match_substring(texts, sentinels[0])
        for other in sentinels[1:]:
            marked = pc.or_(marked, pc.match_substring(texts, other))
        plain = (ends == starts) | marked.to_numpy(zero_copy_only=False) | (h3 % 100 >= rate)
        spm = h4 % 100 < spm_rate
        held = data.tobytes()
        out = []
        for row, (start, a, b, end) in enumerate(zip(starts.tolist(), one.tolist(), two.tolist(), ends.tolist(), strict=True)):
            if plain[row]:
                out.append(held[start:end])
            elif spm[row]:
                out.append(b"".join((marks[1], held[b:end], marks[0], held[start:a], marks[2], held[a:b])))
            else:
                out.append(b"".join((marks[0], held[start:a], marks[1], held[b:end], marks[2], held[a:b])))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(chars[1] - chars[0], pa.int64(), mask=plain),
                pa.array(chars[2] - chars[1], pa.int64(), mask=plain),
                pa.array(out, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    schema = f"doc_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *draws), cut, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text an output was made of, from the output and its form alone."""
    head, tail, middle = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, middle, 1)
        return one, two, F.substr(rest, F.length(two) + len(middle) + 1)

    prefix, suffix, between = parts(head, tail)
    last, first, inner = parts(tail, head)
    return F.when(form == "psm", F.concat(prefix, between, suffix)).when(form == "spm", F.concat(first, inner, last)).otherwise(output)
