"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Tokens are counted in Arrow batches: a batch's distinct words are encoded once, through a
cache of word pieces, and every text is put together from them. Pieces are then packed in
groups of bounded size, drawn at random, so that no task sees more than one group: items of
over a third of the capacity are paired greedily (three never fit), smaller ones go into the
fullest sequence that still has room.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_groups, staged

CAPACITY = 4096
END_ID = 1
#: Pieces that are packed together; groups of this size lose a few hundredths of a percent against one group.
GROUP_ROWS = 16384
#: Bytes of text that are encoded at once, and cached pieces for each Python worker; neither changes a result.
SLICE_BYTES = 2_000_000
CACHE_ENTRIES = 100_000

# Code points of which the tokenizer's classes are settled; texts with others go through its whole chain.
_PLAIN = [c for c in range(0x250) if c in (9, 10, 13) or (c >= 32 and c not in (0x7F, 0xA0, 0xAD, 0x130) and not 0x80 <= c < 0xA0)]


def _members(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in _PLAIN if unicodedata.category(chr(c))[0] == kind)


_LETTER, _NUMBER = _members("L"), _members("N")
_PIECE = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^ \t\n\r{_LETTER}{_NUMBER}]+")
_OTHER = r"[^\t\n\r -~\x{A1}-\x{AC}\x{AE}-\x{12F}\x{131}-\x{24F}]|<\|"


class Encoder:
    """Token ids of texts, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            as_letters = piece.encode().decode("latin-1").translate(self.byte_letters)
            found = array("I", [t.id for t in self.model.tokenize(as_letters)]).tobytes()
            if len(self.pieces) < CACHE_ENTRIES:
                self.pieces[piece] = found
        return found

    def word(self, word: str) -> bytes:
        return b"".join(map(self.piece, _PIECE.findall(word.lower())))

    def text(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a small batch, in order."""
        odd = pc.match_substring_regex(texts, _OTHER)
        plain = pc.if_else(odd, "", texts)
        words = pc.ascii_split_whitespace(plain)
        flat = words.flatten().dictionary_encode()
        coded = [self.word(w) for w in flat.dictionary.to_pylist()]
        lengths = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
        ids = np.frombuffer(b"".join(coded), "<u4")
        starts = np.cumsum(lengths) - lengths
        index = flat.indices.to_numpy(zero_copy_only=False)
        ends = words.offsets.to_numpy()
        for row, is_odd in enumerate(odd.to_pylist()):
            if is_odd:
                yield np.frombuffer(self.text(texts[row].as_py()), "<u4")
                continue
            own = index[ends[row] - ends[0] : ends[row + 1] - ends[0]]
            count = lengths[own]
            place = np.cumsum(count)
            total = int(place[-1]) if len(place) else 0
            yield ids[np.arange(total) + np.repeat(starts[own] - place + count, count)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield start, end
        start = end


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, payload: str = "crc32", doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length`` and the tokens, for every document.

    A document is its ids and then ``end_id``; a null text counts as empty and gives the end
    id alone. Only documents longer than ``capacity`` are cut; their last piece may be short.
    ``payload`` names what is kept of the tokens: ``ids`` (an array), or ``crc32`` of the ids
    as little-endian 32-bit numbers (``ids_crc32``). Other columns of ``docs`` are not read;
    repeated rows are packed as often as they occur.
    """
    kind = docs.schema[doc_id].dataType
    column = "ids array<long>" if payload == "ids" else "ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for first, last in slices(texts):
                rows, piece, start, length, kept = [], [], [], [], []
                for row, ids in enumerate(encode.batch(texts.slice(first, last - first)), first):
                    whole = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                    for k, at in enumerate(range(0, len(whole), capacity)):
                        part = whole[at : at + capacity]
                        rows.append(row)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        kept.append(part.astype(np.int64) if payload == "ids" else zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(kept, pa.list_(pa.int64()) if payload == "ids" else pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", column.split()[0]],
                )

    return map_batches(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), cut, f"doc_id {kind.simpleString()}, piece int, start long, length long, {column}"
    )


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; lengths are from 1 to the capacity."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    third = capacity // 3
    stacks: dict[int, list[int]] = {}
    for item, size in enumerate(lengths.tolist()):
        stacks.setdefault(size, []).append(item)
    gaps: dict[int, list[int]] = {}
    gap_mask, made = 0, 0

    def put(item: int, size: int, where: int, gap: int) -> None:
        nonlocal gap_mask
        bins[item], offsets[item] = where, capacity - gap
        if gap > size:
            gaps.setdefault(gap - size, []).append(where)
            gap_mask |= 1 << (gap - size)

    def take(size: int) -> int:
        nonlocal large_mask
        item = stacks[size].pop()
        if not stacks[size]:
            large_mask &= ~(1 << size)
        return item

    large_mask = 0
    for size in stacks:
        if size > third:
            large_mask |= 1 << size
    while large_mask:
        size = large_mask.bit_length() - 1
        item = take(size)
        partner = (large_mask & ((1 << (capacity - size + 1)) - 1)).bit_length() - 1
        if partner > third:
            bins[item] = made
            put(take(partner), partner, made, capacity - size)
        else:
            put(item, size, made, capacity)
        made += 1
    for size in sorted((s for s in stacks if s <= third), reverse=True):
        for item in stacks[size]:
            room = gap_mask >> size
            if room:
                gap = size + (room & -room).bit_length() - 1
                where = gaps[gap].pop()
                if not gaps[gap]:
                    gap_mask &= ~(1 << gap)
            else:
                gap, where, made = capacity, made, made + 1
            put(item, size, where, gap)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Sequences hold at most ``capacity`` and are filled from 0 without gaps. Which sequence a
    row gets among rows of equal length is arbitrary, but rows are staged first: a lost
    executor does not change it. An empty table gives an empty one.
    """
    kept = staged(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-kept.count() // group_rows))
    lengths = kept.select("__row", "length", F.pmod(F.xxhash64("__row"), F.lit(groups)).alias("group"))

    def place(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__row")
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity)
        return pd.DataFrame({"__row": rows["__row"].to_numpy(), "sequence_id": (int(key[0]) << 32) + bins, "offset": offsets})

    placed = map_groups(lengths, ["group"], place, "__row long, sequence_id long, offset long")
    return kept.join(placed, "__row").drop("__row")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, payload: str = "crc32", **columns: str) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(docs, tokenizer, capacity, payload, **columns), capacity)
