"""Conversation structure repair: a shortest-path repair of role sequences, computed on a shared grammar.

Every turn becomes a symbol of its role and fault. A conversation is repaired by the cheapest
edits after which its roles spell a legal conversation, that is, by a shortest path through
the states of a small automaton: each symbol has a min-plus matrix of costs between states,
and a sequence has the product of its symbols' matrices. Re-Pair replaces pairs of symbols
that are frequent in all conversations by new symbols, round by round; each such rule gets
one matrix, from those of its two parts, and an audit rope: which state is between its parts,
from which the edits of any of its paths can be read. Equal sequences are evaluated once.

Edits are written ``K`` keep, ``R`` rerole, ``D`` delete, ``I`` insert. Of equally cheap
paths the one with the least audit is taken. That is a sum over paths too: audits of one
sequence hold one letter for each turn besides their inserts, so that of two with equal cost
neither begins with the other, and a lesser part makes a lesser whole.

Long conversations are cut into segments where the sorted table is cut into partitions, and
at ``SEGMENT_ROWS``; matrices of segments are multiplied in groups of bounded size until one
is left. No task holds a conversation, only its edits, one byte a turn, come together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, map_groups, staged

ROLES = ("system", "user", "assistant")
FAULTS = ("none", "blank", "duplicate", "truncated")
#: Characters that make no text by themselves.
_SPACES = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# States: nothing yet, after a system turn, after a user turn, after an assistant turn. A conversation ends in the first or the last.
STATES = 4
_AFTER = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3})  # by role: state before -> state after
_ENDS = (0, 3)
OTHER_ROLE = 3
TERMINALS = 4 * len(FAULTS)  # symbol = 4 * role + fault
_FAR = 1 << 40
#: Whether a role may stand before another.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True

#: Turns of a segment, segments multiplied together, rules added in a round of Re-Pair, rounds, and how often a pair must occur.
SEGMENT_ROWS, FAN, ROUND_RULES, ROUNDS, LEAST_PAIRS = 16384, 32, 64, 6, 4

Entry = tuple[int, str]
Matrix = list[list[Entry]]


def _product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product, audits joined, ties to the least audit."""
    out = []
    for row in a:
        ways = [(m, cost, audit) for m, (cost, audit) in enumerate(row) if cost < _FAR]
        line = []
        for j in range(STATES):
            least = min((cost + b[m][j][0] for m, cost, _ in ways), default=_FAR)
            line.append((least, min(audit + b[m][j][1] for m, cost, audit in ways if cost + b[m][j][0] == least)) if least < _FAR else (_FAR, ""))
        out.append(line)
    return out


def _identity() -> Matrix:
    return [[(0, "") if i == j else (_FAR, "") for j in range(STATES)] for i in range(STATES)]


def _inserts() -> Matrix:
    """Any number of inserted user and assistant turns."""
    one = _identity()
    for role in (1, 2):
        for before, after in _AFTER[role].items():
            one[before][after] = (INSERT, "I")
    return _product(one, one)


def _row(symbol: int) -> Matrix:
    """Inserts, then what may become of one turn."""
    role, fault = divmod(symbol, len(FAULTS))
    made = [[(DELETE, "D") if i == j else (_FAR, "") for j in range(STATES)] for i in range(STATES)]
    if FAULTS[fault] not in ("blank", "duplicate"):
        more = TRUNCATED if FAULTS[fault] == "truncated" else 0
        for target, letter, cost in ((role, "K", KEEP), (1, "R", REROLE), (2, "R", REROLE)):
            for before, after in _AFTER[target].items() if target != OTHER_ROLE else ():
                made[before][after] = min(made[before][after], (cost + more, letter))
    return _product(_inserts(), made)


class Grammar:
    """Rules of Re-Pair, and for each symbol a matrix of costs with the states that its audits go through."""

    def __init__(self) -> None:
        self.rules: list[tuple[int, int]] = []
        self.costs: list[list[list[int]]] = []
        self.between: list[list[list[int]]] = []
        self._texts: dict[tuple[int, int, int], str] = {}
        for symbol in range(TERMINALS):
            row = _row(symbol)
            self.costs.append([[e[0] for e in line] for line in row])
            self.between.append([])
            self._texts |= {(symbol, i, j): row[i][j][1] for i in range(STATES) for j in range(STATES)}

    def add(self, left: int, right: int) -> int:
        """A rule for the pair; its matrix follows from those of its parts."""
        symbol = TERMINALS + len(self.rules)
        self.rules.append((left, right))
        costs, between = [[_FAR] * STATES for _ in range(STATES)], [[0] * STATES for _ in range(STATES)]
        for i in range(STATES):
            for j in range(STATES):
                ways = [(self.costs[left][i][m] + self.costs[right][m][j], m) for m in range(STATES)]
                least = min(w[0] for w in ways)
                if least < _FAR:
                    alike = [m for cost, m in ways if cost == least]
                    if len(alike) > 1:  # only then the audits themselves are compared
                        alike.sort(key=lambda m: self.audit(left, i, m) + self.audit(right, m, j))
                    costs[i][j], between[i][j] = least, alike[0]
        self.costs.append(costs)
        self.between.append(between)
        return symbol

    def audit(self, symbol: int, i: int, j: int) -> str:
        """The rope of a path, written out."""
        found = self._texts.get((symbol, i, j))
        if found is None:
            left, right = self.rules[symbol - TERMINALS]
            m = self.between[symbol][i][j]
            found = "" if self.costs[symbol][i][j] >= _FAR else self.audit(left, i, m) + self.audit(right, m, j)
            self._texts[symbol, i, j] = found
        return found

    def matrix(self, symbol: int) -> Matrix:
        return [[(self.costs[symbol][i][j], self.audit(symbol, i, j)) for j in range(STATES)] for i in range(STATES)]

    def of(self, symbols: list[int]) -> Matrix:
        """The matrix of a sequence."""
        known = {s: self.matrix(s) for s in set(symbols)}
        return _folded([known[s] for s in symbols])


def _folded(made: list[Matrix]) -> Matrix:
    """The product of matrices; neighbours are multiplied until one is left, so that no audit is copied often."""
    if not made:
        return _identity()
    while len(made) > 1:
        made = [_product(made[i], made[i + 1]) if i + 1 < len(made) else made[i] for i in range(0, len(made), 2)]
    return made[0]


def best_path(matrix: Matrix) -> Entry:
    """Cost and audit of a whole conversation with that matrix."""
    return min(_product(matrix, _inserts())[0][j] for j in _ENDS)


# Re-Pair over sequences of all conversations, held one after another with -1 between them.


def _joined(sequences: list[bytes]) -> np.ndarray:
    parts = []
    for sequence in sequences:
        parts += [np.frombuffer(sequence, "<u2").astype(np.int32), np.array([-1], np.int32)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _replaced(symbols: np.ndarray, pairs: dict[tuple[int, int], int]) -> np.ndarray:
    """Every pair replaced, left to right; no symbol is the left of one pair and the right of another."""
    for (left, right), rule in pairs.items():
        hit = np.flatnonzero((symbols[:-1] == left) & (symbols[1:] == right))
        if left == right and len(hit):  # of a run of equal symbols, every other one
            starts = np.concatenate([[True], np.diff(hit) > 1])
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(starts, np.arange(len(hit)), 0))
            hit = hit[since % 2 == 0]
        if len(hit):
            symbols = symbols.copy()
            symbols[hit] = rule
            symbols = np.delete(symbols, hit + 1)
    return symbols


def _chosen(counts: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The most frequent pairs of which none overlaps another."""
    lefts: set[int] = set()
    rights: set[int] = set()
    out = []
    for left, right, n in sorted(counts, key=lambda c: (-c[2], c[0], c[1])):
        if n < LEAST_PAIRS or len(out) == ROUND_RULES:
            break
        twice = left == right and (left in lefts or left in rights)
        if twice or left in rights or right in lefts or (left, left) in out or (right, right) in out:
            continue
        out.append((left, right))
        lefts.add(left)
        rights.add(right)
    return out


def compressed(sequences: DataFrame) -> tuple[Grammar, DataFrame]:
    """A grammar of all rows of ``sequence, weight`` (16-bit symbols), and these with ``code``, the sequence under it.

    What reaches the driver is counts of pairs of symbols, at most the square of their number.
    """
    grammar = Grammar()
    current = staged(sequences.withColumn("code", F.col("sequence")), "sequences")
    for _ in range(ROUNDS):

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = batch.column(0).to_pylist()
                symbols = _joined(codes)
                weights = np.repeat(batch.column(1).to_numpy(), [len(c) // 2 + 1 for c in codes])
                inner = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
                pairs, place = np.unique(symbols[inner].astype(np.int64) << 16 | symbols[inner + 1], return_inverse=True)
                sums = np.zeros(len(pairs), np.int64)
                np.add.at(sums, place, weights[inner])
                yield pa.RecordBatch.from_arrays([pa.array(pairs >> 16), pa.array(pairs & 0xFFFF), pa.array(sums)], ["l", "r", "n"])

        counted = map_batches(current.select("code", "weight"), count, "l long, r long, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))
        pairs = {pair: grammar.add(*pair) for pair in _chosen([(r.l, r.r, r.n) for r in counted.where(F.col("n") >= LEAST_PAIRS).collect()])}
        if not pairs:
            break

        def replace(batches: Iterator[pa.RecordBatch], pairs=pairs) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = _replaced(_joined(batch.column(2).to_pylist()), pairs)
                ends = np.flatnonzero(whole < 0)
                codes = [whole[a:b].astype("<u2").tobytes() for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)] if len(ends) else []
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["sequence", "weight", "code"])

        current = staged(map_batches(current.select("sequence", "weight", "code"), replace, "sequence binary, weight long, code binary"), "sequences")
    return grammar, current


def _evaluated(grammar: Grammar, coded: DataFrame) -> DataFrame:
    """For each ``sequence``: ``cost, audit`` if it is a whole conversation, and its matrix as ``costs, audits`` (by state before and after)."""

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [grammar.of(np.frombuffer(code, "<u2").tolist()) for code in batch.column(1).to_pylist()]
            whole = [best_path(m) for m in made]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([w[0] for w in whole], pa.int64()), pa.array([w[1] for w in whole], pa.string()),
                    pa.array([[e[0] for row in m for e in row] for m in made], pa.list_(pa.int64())), pa.array([[e[1] for row in m for e in row] for m in made], pa.list_(pa.string())),
                ],
                ["sequence", "cost", "audit", "costs", "audits"],
            )

    return map_batches(coded.select("sequence", "code"), evaluate, "sequence binary, cost long, audit string, costs array<long>, audits array<string>")


# From rows to segments.

ORDER = ("turn", "tie", "row", "copy")


def ordered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` and the columns that put the rows of a conversation in order, staged.

    Rows follow by turn, nulls first, then by a hash of role and text; ``row`` tells repeated rows apart.
    """
    source = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    blank = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    keyed = source.select("conv_id", "turn", *blank, F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    return staged(keyed.withColumn("copy", F.lit(0)).withColumn("gone", F.lit(False)), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``, the first of blank, duplicate (role and text seen earlier in the conversation) and truncated.

    Only texts that a conversation has twice are joined, and of each the first row.
    """
    alike = F.xxhash64("role", "text")
    marked = rows.withColumn("__same", F.struct(alike.alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b")))
    place = F.struct(*ORDER)
    first = marked.where("NOT gone").groupBy("conv_id", "__same").agg(F.min(place).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    first = first.withColumnsRenamed({"conv_id": "__conv", "__same": "__alike"})
    joined = marked.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__same") == F.col("__alike")), "left")
    bare = F.rtrim("text", F.lit(_SPACES))
    fault = (
        F.when(bare == "", 1).when(F.col("__first").isNotNull() & (place != F.col("__first")), 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    )
    return joined.withColumn("fault", fault.cast("int")).drop("__same", "__first", "__conv", "__alike")


def _initial(role: Column) -> Column:
    return F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(OTHER_ROLE)


def segments(rows: DataFrame) -> DataFrame:
    """``conv_id, part, sequence, first, last, illegal``: stretches of each conversation, in order of ``part``.

    Rows are sorted in ranges of all order columns, so that a conversation of any length is dealt
    to many tasks. ``first`` and ``last`` are the roles at the ends, ``illegal`` counts the
    neighbours inside that no conversation has.
    """
    narrow = rows.where("NOT gone").select("conv_id", *ORDER, (_initial(F.col("role")) * len(FAULTS) + F.col("fault")).cast("int").alias("symbol"))
    dealt = narrow.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    numbered = dealt.select("conv_id", "symbol", F.spark_partition_id().alias("task"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The stretch that is open at the end of a batch goes on in the next.
        conv, held, number, kind, task = None, None, 0, None, 0

        def written(out: list[tuple]) -> pa.RecordBatch:
            roles = [x[2] // len(FAULTS) for x in out]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], kind), pa.array([(task << 32) + x[1] for x in out], pa.int64()),
                    pa.array([x[2].astype("<u2").tobytes() for x in out], pa.binary()), pa.array([int(r[0]) for r in roles], pa.int32()),
                    pa.array([int(r[-1]) for r in roles], pa.int32()), pa.array([int((~_LEGAL[r[:-1], r[1:]]).sum()) for r in roles], pa.int64()),
                ],
                ["conv_id", "part", "sequence", "first", "last", "illegal"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            convs, symbols, task = batch.column(0), batch.column(1).to_numpy(), batch.column(2)[0].as_py()
            kind = convs.type
            alike = convs.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(alike)) + 1).tolist()]
            out = []
            for start, end in zip(starts, [*starts[1:], len(symbols)], strict=True):
                own = convs[start].as_py()
                if held is not None and own == conv:
                    held = np.concatenate([held, symbols[start:end]])
                else:
                    if held is not None:
                        out.append((conv, number, held))
                    conv, held, number = own, symbols[start:end], 0
                while len(held) > SEGMENT_ROWS:
                    out.append((conv, number, held[:SEGMENT_ROWS]))
                    held, number = held[SEGMENT_ROWS:], number + 1
            if out:
                yield written(out)
        if held is not None:
            yield written([(conv, number, held)])

    return map_batches(numbered, cut, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part long, sequence binary, first int, last int, illegal long")


def _multiplied(parts: DataFrame) -> DataFrame:
    """``conv_id, cost, audit, illegal`` of conversations of several parts, ``FAN`` of which are multiplied in a task."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    square = lambda flat: [list(flat[i * STATES : (i + 1) * STATES]) for i in range(STATES)]

    def multiply(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        made = [square(list(zip(c.tolist(), a.tolist(), strict=True))) for c, a in zip(rows["costs"], rows["audits"], strict=True)]
        whole = _folded(made)
        ends = zip(rows["last"].tolist()[:-1], rows["first"].tolist()[1:], strict=True)
        cost, audit = best_path(whole)
        return pd.DataFrame(
            {
                "conv_id": rows["conv_id"].iloc[:1], "part": [int(key[1])], "costs": [[e[0] for r in whole for e in r]], "audits": [[e[1] for r in whole for e in r]],
                "first": [rows["first"].iloc[0]], "last": [rows["last"].iloc[-1]], "illegal": [int(rows["illegal"].sum()) + sum(not _LEGAL[a, b] for a, b in ends)], "cost": [cost], "audit": [audit],
            }
        )

    schema = f"conv_id {kind}, part long, costs array<long>, audits array<string>, first int, last int, illegal long, cost long, audit string"
    while True:
        numbers = Window.partitionBy("conv_id").orderBy("part")
        placed = parts.withColumn("block", F.floor((F.row_number().over(numbers) - 1) / FAN).cast("long"))
        parts = staged(map_groups(placed, ["conv_id", "block"], multiply, schema), "segments")
        if parts.agg(F.max("part").alias("most")).first().most in (None, 0):
            return parts.select("conv_id", "cost", "audit", "illegal")
        parts = parts.drop("cost", "audit")


def paths(rows: DataFrame) -> DataFrame:
    """``conv_id, cost, audit, illegal`` of every conversation that has rows (with their ``fault``)."""
    cut = staged(segments(rows), "segments")
    distinct = cut.groupBy("sequence").agg(F.count("*").alias("weight"))
    evaluated = staged(_evaluated(*compressed(distinct)), "matrices")
    per = cut.groupBy("conv_id").agg(F.count("*").alias("parts"), F.min("sequence").alias("sequence"), F.sum("illegal").alias("illegal"))
    alone = per.where("parts = 1").join(evaluated.select("sequence", "cost", "audit"), "sequence").select("conv_id", "cost", "audit", "illegal")
    several = staged(per.where("parts > 1").select(F.col("conv_id").alias("several")), "several")
    if several.isEmpty():
        return alone
    pieces = cut.join(several, F.col("conv_id").eqNullSafe(F.col("several")), "left_semi").join(evaluated.select("sequence", "costs", "audits"), "sequence")
    return alone.unionByName(_multiplied(pieces.select("conv_id", "part", "costs", "audits", "first", "last", "illegal")))


# The edits, applied to the texts.


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The audit of each conversation and then its rows, conversation after conversation."""
    audits = found.select("conv_id", F.lit(0).alias("kind"), "audit")
    turns = rows.where("NOT gone").select("conv_id", F.lit(1).alias("kind"), *ORDER, "role", "text")
    both = audits.unionByName(turns, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER).select("conv_id", "kind", "audit", "turn", "role", "text")


class _Editor:
    """Reads one conversation's audit while its turns come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _to(self, role: int) -> str:
        self.state = _AFTER[role][self.state]
        return ROLES[role]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._to(2 if self.state == 2 else 1), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._to("sua".index(role[0]))
            yield letter, role, text
        elif letter == "R":
            yield letter, self._to(2 if self.state == 2 else 1), text


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text`` of every turn after the repair; ``place`` counts from 0 within a conversation."""

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, conv, place, kind = None, None, 0, None

        def written(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "place", "edit", "role", "text"])

        for batch in batches:
            out: list[tuple] = []
            kind = batch.column(0).type
            for own, what, audit, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if what == 0:
                    done = editor.inserted() if editor else ()
                    out += [(conv, place + i, *x) for i, x in enumerate(done)]
                    editor, conv, place = _Editor(audit), own, 0
                else:
                    for x in editor.turn(role, text):
                        out.append((conv, place, *x))
                        place += 1
            yield written(out)
        if editor:
            yield written([(conv, place + i, *x) for i, x in enumerate(editor.inserted())])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_batches(_streamed(rows, found), edit, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the hash of the repaired ``role:text``, newline-joined.

    A hash is taken in order, so that one task reads a conversation from its first to its last
    turn; it holds a batch of rows and the audit.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, conv, kind = None, None, None
        hashed, begun = hashlib.sha256(), False

        def add(turns) -> None:
            nonlocal begun
            for _, role, text in turns:
                hashed.update((f"\n{role}:{text}" if begun else f"{role}:{text}").encode())
                begun = True

        for batch in batches:
            kind, out = batch.column(0).type, []
            for own, what, audit, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if what == 0:
                    if editor:
                        add(editor.inserted())
                        out.append((conv, hashed.hexdigest()))
                    editor, conv, hashed, begun = _Editor(audit), own, hashlib.sha256(), False
                else:
                    add(editor.turn(role, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], ["conv_id", "repaired_sha256"])
        if editor:
            add(editor.inserted())
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([hashed.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_batches(_streamed(rows, found), digest, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their faults, and ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation.

    ``rows`` come from ``ordered``; those that are ``gone`` only name their conversation. Pass
    both results to ``repaired_rows`` for the repaired turns.

    Null roles and texts count as one blank. Null ids make a conversation of their own. Null turns
    come first and make no gap; turns that occur twice follow each other by a hash of role and
    text, and repeated rows are duplicates. An empty conversation has zeros and an empty audit;
    an empty table gives an empty result.
    """
    marked = staged(faults(rows), "faults")
    there = ~F.col("gone")
    counted = marked.groupBy("conv_id").agg(
        (F.max(F.when(there, F.col("turn"))) - F.min(F.when(there, F.col("turn"))) + 1 - F.count_distinct(F.when(there, F.col("turn")))).alias("gaps"),
        *[F.count_if(there & (F.col("fault") == i)).alias(name) for i, name in enumerate(FAULTS) if i],
    )
    found = staged(paths(marked), "paths").withColumnRenamed("conv_id", "__conv")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = counted.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    return marked, staged(joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit")), "repairs")
