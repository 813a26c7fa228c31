"""Secret scans, by DataFrame functions alone: known forms, and a battery of randomness tests for the rest.

One scan of the texts finds known forms and long runs of key-like characters; from there on
every match is a row. Runs, split at ``=`` inside them, that are no known form get an encoding
from the characters they use; what is not taken for random as a whole is split at ``/``, ``-``
and ``_`` and its long parts are judged likewise. Under it, three tests ask whether the symbols
could be drawn at random: chi-squared for a uniform alphabet, the number of runs above and
below the alphabet's middle, and the serial correlation of neighbours. The least of their
p-values (times their number) is a run's p. Random runs have p spread evenly, words have p near
zero: from the counts of p over the whole corpus, for each encoding and band of lengths,
follows the share of words among the runs above any p, and the least p is taken that holds this
share to the rate asked for.

Positions come from sums over the matches before, overlaps from the neighbours in order of
position, so that the work grows with the matches of a text, not with their square.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, staged

KINDS = ("assign", "access", "hex", "random")
# The known forms.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Every known form but ``assign`` lies within such a run.
RUN = r"[A-Za-z0-9+/_=-]{20,}"

LEAST_RUN = 20
# A run without an inner ``=``; the pieces of others, and the parts of pieces, between separators.
WHOLE = r"^[A-Za-z0-9+/_-]+=*$"
PIECE = r"[A-Za-z0-9+/_-]{20,}(?:=+$)?|[A-Za-z0-9+/_-]+=+$"
PARTS = tuple(f"[A-Za-z0-9+{kept}]{{20,}}(?:=+$)?|[A-Za-z0-9+{kept}]+=+$" for kept in ("_-", "/", ""))

ALPHABETS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": ("^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": ("^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}
BANDS = (20, 28, 40, 64, 128)
BINS = 40
#: Share of words admitted among reported runs.
RATE = 0.05


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _cut(text: str, pattern: str) -> str:
    """SQL for the matches of a pattern, each with the length of the gap before it; null if there is none."""
    found = f"regexp_extract_all({text}, {_text(pattern)}, 0)"
    gaps = f"transform(split({text}, {_text(pattern)}, -1), g -> length(g))"
    return f"IF({text} RLIKE {_text(pattern)}, transform(arrays_zip({found}, {gaps}), z -> named_struct('m', z['0'], 'gap', z['1'])), NULL)"


def _placed(cut: DataFrame, keys: Sequence[str], matches: str, at: str = "0") -> DataFrame:
    """A row for each match: ``keys, start, end, m``, from a column of ``_cut`` and where its text begins."""
    rows = cut.select(*keys, F.expr(f"cast({at} AS long)").alias("__at"), F.posexplode(matches).alias("__k", "__z")).where("__z.m IS NOT NULL")
    before = Window.partitionBy(*keys).orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("__at") + F.sum(F.length("__z.m") + F.col("__z.gap")).over(before)
    return rows.select(*keys, end.alias("end"), F.col("__z.m").alias("m")).select(*keys, (F.col("end") - F.length("m")).alias("start"), "end", "m")


def _inside(rows: DataFrame, pattern: str) -> DataFrame:
    """The pattern's matches within each row's ``m``: ``row, of`` (the start of that row), ``start, end, m``."""
    cut = rows.where(F.expr(f"m RLIKE {_text(pattern)}")).select("row", F.col("start").alias("of"), F.expr(_cut("m", pattern)).alias("__cut"))
    return _placed(cut, ["row", "of"], "__cut", "of")


def _tail(z: str) -> str:
    """Upper tail of the standard normal distribution, to seven digits (Abramowitz and Stegun 7.1.26)."""
    poly = "(((((1.061405429 * kk - 1.453152027) * kk) + 1.421413741) * kk - 0.284496736) * kk + 0.254829592) * kk"
    upper = _let("az", f"abs(zz) / {math.sqrt(2)!r}D", _let("kk", "1D / (1D + 0.3275911D * az)", f"0.5D * {poly} * exp(-az * az)"))
    return _let("zz", z, f"IF(zz >= 0, {upper}, 1D - {upper})")


def _battery(alphabet: str) -> str:
    """SQL for the p-value of the symbols ``s`` (a string over the alphabet)."""
    size = len(alphabet)
    letters = f"filter(split('{alphabet}', ''), c -> c <> '')"
    squares = f"aggregate(transform({letters}, c -> cast(length(s) - length(replace(s, c, '')) AS double)), 0D, (a, x) -> a + x * x)"
    df = size - 1
    chi = f"({size}D / n * {squares} - n)"
    chi_z = f"(pow({chi} / {df}D, 1D / 3) - {1 - 2 / (9 * df)!r}D) / {math.sqrt(2 / (9 * df))!r}D"
    values = f"transform(filter(split(s, ''), c -> c <> ''), c -> cast(instr('{alphabet}', c) - 1 AS double))"
    above = f"size(filter(v, x -> x >= {size // 2}))"
    changes = f"size(filter(sequence(1, size(v) - 1), i -> (v[i] >= {size // 2}) <> (v[i - 1] >= {size // 2})))"
    # Mean and variance of the runs of a fair coin's n tosses.
    runs_z = f"(1D + {changes} - (n + 1D) / 2) / sqrt((n - 1D) / 4)"
    mean = f"{(size - 1) / 2!r}D"
    cover = f"aggregate(sequence(1, size(v) - 1), 0D, (a, i) -> a + (v[i] - {mean}) * (v[i - 1] - {mean}))"
    serial_z = f"{cover} / ({(size * size - 1) / 12!r}D * sqrt(n - 1D))"
    balance_z = f"(2D * {above} - n) / sqrt(n)"
    tests = f"array({_tail(chi_z)}, 2D * {_tail(f'abs({runs_z})')}, 2D * {_tail(f'abs({serial_z})')}, 2D * {_tail(f'abs({balance_z})')})"
    return _let("n", "cast(length(s) AS double)", _let("v", values, f"least(1D, 4D * array_min({tests}))"))


def _judged(run: str) -> str:
    """SQL for ``encoding, band, p`` of a run; a null encoding if it has none of the alphabets or only digits."""
    cases = " ".join(f"WHEN rn RLIKE '{form}' THEN '{name}'" for name, (form, _) in ALPHABETS.items())
    kind = f"CASE WHEN rn RLIKE '^[0-9=]+$' THEN NULL {cases} END"
    bare = "regexp_replace(rn, '=+$', '')"
    ps = " ".join(
        f"WHEN en = '{name}' THEN {_let('s', f'lower({bare})' if name == 'hex' else bare, _battery(alphabet))}" for name, (_, alphabet) in ALPHABETS.items()
    )
    band = " + ".join(f"IF(length(rn) >= {b}, 1, 0)" for b in BANDS)
    return _let("rn", run, _let("en", kind, f"named_struct('encoding', en, 'band', {band}, 'p', CASE {ps} END)"))


def _passing(least: dict[tuple[str, int], float]) -> Column:
    """Whether a judged row has a p to report."""
    cases = " ".join(f"WHEN encoding = '{e}' AND band = {b} THEN p >= {p!r}D" for (e, b), p in sorted(least.items()))
    return F.expr(f"CASE {cases} ELSE false END" if cases else "false")


def _free(rows: DataFrame, base: DataFrame) -> DataFrame:
    """``rows`` that touch no row of ``base`` of the same text: the furthest end before them, and the next start."""
    both = rows.withColumn("__base", F.lit(False)).unionByName(base.select("row", "start", "end").withColumn("__base", F.lit(True)), allowMissingColumns=True)
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("row").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    reach, following = F.max(F.when(F.col("__base"), F.col("end"))).over(upto), F.min(F.when(F.col("__base"), F.col("start"))).over(since)
    seen = both.withColumn("__reach", reach).withColumn("__next", following).where("NOT __base")
    return seen.where("coalesce(__reach, -1) <= start AND coalesce(__next, end) >= end").drop("__base", "__reach", "__next")


def _judged_rows(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``encoding, band, p``, staged; those without an encoding have none of the three."""
    return staged(rows.withColumn("how", F.expr(_judged("m"))).select(*rows.columns, "how.encoding", "how.band", "how.p"), label)


def found_in(docs: DataFrame, text: str = "text", row: str = "row") -> tuple[DataFrame, DataFrame]:
    """The base spans ``row, start, end, kind`` and the pieces ``row, start, end, m`` of runs, all as rows.

    This is the one scan of the texts; texts without a match leave nothing.
    """
    t = f"coalesce(cast(`{text}` AS string), '')"
    cut = docs.select(F.col(row).alias("row"), F.expr(_cut(t, ASSIGN)).alias("assign"), F.expr(_cut(t, RUN)).alias("runs"))
    cut = staged(cut.where("assign IS NOT NULL OR runs IS NOT NULL"), "matches")
    assign = _placed(cut.where("assign IS NOT NULL"), ["row"], "assign").where(F.expr(f"length(regexp_extract(m, {_text(ASSIGN)}, 2)) >= {ASSIGN_LEAST}"))
    runs = staged(_placed(cut.where("runs IS NOT NULL"), ["row"], "runs"), "runs")
    known = [assign, _inside(runs, ACCESS).drop("of"), _inside(runs, HEX).drop("of")]
    base = known[0].drop("m").withColumn("kind", F.lit(KINDS[0]))
    for kind, rows in zip(KINDS[1:], known[1:], strict=False):
        base = base.unionByName(rows.drop("m").withColumn("kind", F.lit(kind)))
    whole = F.expr(f"m RLIKE {_text(WHOLE)}")
    pieces = runs.where(whole).unionByName(_inside(runs.where(~whole), PIECE).drop("of").where(f"length(m) >= {LEAST_RUN}"))
    return staged(base, "base_spans"), staged(pieces, "pieces")


def judged_pieces(base: DataFrame, pieces: DataFrame) -> DataFrame:
    """The pieces that touch no base span, with ``encoding, band, p``."""
    return _judged_rows(_free(pieces, base), "judged")


def judged_parts(base: DataFrame, pieces: DataFrame, kept: DataFrame) -> DataFrame:
    """The parts of all pieces but the kept ones, judged: ``of`` is the piece, ``ways`` the patterns that give the part."""
    left = pieces.join(kept.select("row", "start"), ["row", "start"], "left_anti")
    cut = None
    for way, pattern in enumerate(PARTS):
        own = _inside(left, pattern).where(f"length(m) >= {LEAST_RUN}").withColumn("way", F.lit(way))
        cut = own if cut is None else cut.unionByName(own)
    parts = cut.groupBy("row", "of", "start", "end").agg(F.first("m").alias("m"), F.collect_set("way").alias("ways"))
    wholes = left.select("row", F.col("start").alias("of"), "start", "end")
    return _judged_rows(_free(parts.join(wholes, ["row", "of", "start", "end"], "left_anti"), base), "parts")


def _longest(parts: DataFrame) -> DataFrame:
    """Of parts within one another the longest; of others that overlap, the longer or else the first.

    Parts of one pattern are apart, so that only its part over the start and its part over the
    end of another one can be longer than that.
    """
    here = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("first"), "start", "end")
    by_start = Window.partitionBy("row", "of").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    by_end = Window.partitionBy("row", "of").orderBy("end").rangeBetween(0, Window.unboundedFollowing)
    out, beaten = parts, F.lit(False)
    for way in range(len(PARTS)):
        own = F.when(F.array_contains("ways", way), here)
        out = out.withColumn(f"__s{way}", F.last(own, ignorenulls=True).over(by_start)).withColumn(f"__e{way}", F.first(own, ignorenulls=True).over(by_end))
        for name, touches in ((f"__s{way}", F.col(f"__s{way}.end") > F.col("start")), (f"__e{way}", F.col(f"__e{way}.start") < F.col("end"))):
            other = F.struct(F.col(f"{name}.size").alias("size"), F.col(f"{name}.first").alias("first"))
            beaten = beaten | F.coalesce(touches & (other > F.struct(here["size"].alias("size"), here["first"].alias("first"))), F.lit(False))
    return out.where(~beaten).select(*parts.columns)


def _least(runs: DataFrame, rate: float) -> dict[tuple[str, int], float]:
    """The least p to report for each encoding and band of lengths, from the p of all rows."""
    counts = runs.where("encoding IS NOT NULL").groupBy("encoding", "band", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    bins: dict[tuple[str, int], list[int]] = {}
    for row in counts.collect():  # at most one row for each encoding, band and bin
        bins.setdefault((row.encoding, row.band), [0] * BINS)[row.bin] = row["count"]
    found = {}
    for cell, seen in bins.items():
        # Random runs expected in each bin; one more than seen, so that no cell is closed to a random run.
        per_bin = (sum(seen[BINS // 2 :]) + 1) / (BINS - BINS // 2)
        found[cell] = 2.0
        for first in range(BINS):
            above = sum(seen[first:])
            if above and 1 - min(1.0, per_bin * (BINS - first) / above) <= rate:
                found[cell] = max(first / BINS, 0.01)
                break
    return found


def scan(docs: DataFrame, text: str = "text", rate: float = RATE, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``secrets``: an array of ``start, kind, end`` in order (code points, end exclusive).

    Base kinds come first among equal starts, as in ``KINDS``; runs found by the battery never
    touch a base span. A null text counts as empty and has none. Repeated rows get equal
    results; a column already named ``secrets`` is replaced. The table is staged, so that
    rows keep their number; without ``keep_text`` it comes back without its texts.
    """
    row = fresh_name(docs, "row")
    columns = [c for c in docs.columns if c != "secrets"]
    numbered = staged(docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn(row, F.monotonically_increasing_id()), "documents")
    base, pieces = found_in(numbered, text, row)
    judged = judged_pieces(base, pieces)
    kept = judged.where(_passing(_least(judged, rate)))
    parts = judged_parts(base, pieces, kept)
    random = kept.select("row", "start", "end").unionByName(_longest(parts.where(_passing(_least(parts, rate)))).select("row", "start", "end"))
    spans = base.unionByName(random.withColumn("kind", F.lit(KINDS[-1])))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    own = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("found"))
    own = own.select(F.col("row").alias(row), F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("secrets"))
    left = [f"`{c}`" for c in columns if keep_text or c != text]
    empty = F.expr("cast(array() AS array<struct<start:bigint,kind:string,end:bigint>>)")
    return numbered.select(*left, row).join(own, row, "left").select(*left, F.coalesce("secrets", empty).alias("secrets"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans' text, and all spans as text."""
    count = lambda kind: F.expr(f"cast(size(filter(secrets, x -> x.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")
    written = lambda spans: f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = written("filter(secrets, x -> x.kind <> 'random')")
    return scanned.select("doc_id", *[count(k) for k in KINDS], F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(written("secrets")).alias("spans"))
