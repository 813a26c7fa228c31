"""Quotation linking, by DataFrame functions alone: from quoting messages to conversations without quotes.

Lines are parsed into quote levels. Passages — all lines of one level together, and long
single lines — are hashed after normalising case and white space, alone and together with the
levels below them, and looked up among the own passages of earlier messages with what those
quote. The passage of the lowest level, then the longest, then the one with most levels alike
names the message replied to; among messages alike in all of this, it is the latest earlier
one. That is found by windows over stretches of ids, so that a passage that many messages
wrote or quote makes no pairs and no large group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Single lines shorter than this, normalised, link nothing; whole passages do.
LINE_CHARS = 12
#: Stretches of ids that are sorted on their own.
STRETCHES = 256
# One run of marks and blanks up to the last mark: a repeated group would recurse once for each mark.
_PREFIX = r"^[ \t>]*>[ \t]?"
_ATTRIBUTION = r"^\s*(?:On|Am|Le|El)\s.{1,300}(?:wrote|schrieb|a écrit|escribió)\s*:\s*$"


def parsed_lines(text: Column) -> Column:
    """``level`` and ``line`` (without quote marks) of each line; attribution lines are left out."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: ~F.regexp_replace(x, _PREFIX, "").rlike(_ATTRIBUTION))
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _PREFIX, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _PREFIX, "").alias("line")
        ),
    )


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _levels(lines: Column) -> Column:
    """``level, whole, passages`` of each level that has lines, in order: one sort, then a slice for each level.

    Passages, all normalised: all lines of the level together, and its long single lines.
    """
    sort = F.array_sort(F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), i.alias("at"), normal(x["line"]).alias("text"))))

    def level(own: Column) -> Column:
        texts = F.filter(F.transform(own, lambda x: x["text"]), lambda x: x != "")
        whole = F.array_join(texts, " ")
        long = F.filter(texts, lambda x: F.length(x) >= LINE_CHARS)
        return F.struct(own[0]["level"].alias("level"), whole.alias("whole"), F.array_distinct(F.filter(F.concat(F.array(whole), long), lambda x: x != "")).alias("passages"))

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["level"] != F.get(s, i - 1)["level"]))
        return _let(starts, lambda st: F.transform(st, lambda at, k: level(F.slice(s, at + 1, F.coalesce(F.get(st, k + 1), F.size(s)) - at))))

    return F.when(F.size(lines) > 0, _let(sort, cut)).otherwise(F.expr("cast(array() AS array<struct<level:int,whole:string,passages:array<string>>>)"))


def _chain(levels: Column, beyond: Column) -> Column:
    """Hashes of the first 0, 1, 2, ... levels from number ``beyond`` on, empty ones left out."""
    texts = F.filter(F.transform(F.slice(levels, beyond + 1, F.size(levels)), lambda x: x["whole"]), lambda x: x != "")
    return F.aggregate(texts, F.array(F.lit("")), lambda done, x: F.concat(done, F.array(F.md5(F.concat(F.element_at(done, -1), F.md5(x))))))


def _mark(chain: str) -> Column:
    return F.md5(F.concat(F.md5("passage"), F.col(chain)))


def _latest_before(asked: DataFrame, wrote: DataFrame) -> DataFrame:
    """``asked`` with ``parent_id``: the greatest id below its own among the rows of ``wrote`` with its ``mark``, if any.

    Both have ``id``, its ``stretch`` and ``mark``. A mark may be in most rows: only those of
    one stretch are sorted together, one row for each stretch tells what came before it.
    """
    both = asked.withColumn("writer", F.lit(None).cast("long")).unionByName(wrote.withColumn("writer", F.col("id")), allowMissingColumns=True)
    # Null first: a message stands before itself as a writer, so that it is none of its own.
    own = Window.partitionBy("mark", "stretch").orderBy("id", F.col("writer").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("writer").over(own)).where("writer IS NULL").drop("writer")
    earlier = Window.partitionBy("mark").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    far = both.groupBy("mark", "stretch").agg(F.max("writer").alias("last")).withColumn("far", F.max("last").over(earlier)).drop("last").where("far IS NOT NULL")
    return near.join(far, ["mark", "stretch"], "left").withColumn("parent_id", F.coalesce("near", "far")).drop("near", "far")


def link(messages: DataFrame, message_id: str = "message_id", text: str = "text") -> DataFrame:
    """``message_id, parent_id, quote_level, own_text`` for every row.

    ``parent_id`` is a message of smaller id that wrote a passage which this one quotes:
    the one whose own quotes agree with the levels quoted beyond the passage the furthest, and
    the latest of those; ``quote_level`` is the level of that quote. Agreement is tried for 1, 2,
    4, ... levels and for all. A null or empty text has an empty own text and quotes nothing. A
    null id has no parent and is none. Rows with one id share their quotes and get the same
    parent. Other columns are not read; an empty table gives an empty result.
    """
    source = messages.select(F.col(message_id).cast("long").alias("id"), parsed_lines(F.col(text)).alias("lines"))
    parsed = staged(
        source.withColumn("own_text", F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))), "messages"
    )
    # STRETCHES - 1 ids at most reach the driver.
    shares = [i / STRETCHES for i in range(1, STRETCHES)]
    splits = sorted(set(parsed.agg(F.percentile_approx("id", shares).alias("ids")).first().ids or []))
    stretch = F.expr(f"size(filter(array({', '.join(f'{x}L' for x in splits)}), x -> x <= id))") if splits else F.lit(0)
    # Parsed once: both sides read the levels.
    known = staged(parsed.where("id IS NOT NULL").select("id", stretch.alias("stretch"), _levels(F.col("lines")).alias("levels")), "levels")
    opened = known.select("id", "stretch", "levels", F.posexplode("levels").alias("number", "own"))
    parts = opened.select("id", "stretch", F.col("own.level").alias("level"), _chain(F.col("levels"), F.col("number") + 1).alias("chain"), F.explode("own.passages").alias("passage"))
    wrote = parts.where("level = 0").select("id", "stretch", "passage", F.explode("chain").alias("beyond")).select("id", "stretch", _mark("beyond").alias("mark"))
    quoted = parts.where("level > 0").select("id", "stretch", "level", "passage", F.size("chain").alias("ends"), F.posexplode("chain").alias("depth", "beyond"))
    quoted = quoted.where("depth & (depth - 1) = 0 OR depth = ends - 1")
    asked = quoted.select("id", "stretch", "level", F.length("passage").alias("chars"), "depth", _mark("beyond").alias("mark"))
    found = _latest_before(asked, wrote).where("parent_id IS NOT NULL")
    choice = F.struct("level", (-F.col("chars")).alias("longest"), (-F.col("depth")).alias("deepest"), (-F.col("parent_id")).alias("latest"), "parent_id")
    best = found.groupBy("id").agg(F.min(choice).alias("best"))
    chosen = best.select("id", F.col("best.parent_id").alias("parent_id"), F.col("best.level").alias("quote_level"))
    return parsed.join(chosen, "id", "left").select(F.col("id").alias("message_id"), "parent_id", "quote_level", "own_text")


def conversations(messages: DataFrame, message_id: str = "message_id", text: str = "text") -> DataFrame:
    """``link`` with ``conversation_id`` (its first message) and ``depth`` (replies up to it).

    Sorted by conversation, depth and id, messages stand in reply order. Ancestors are found by
    doubling: a chain of n replies takes about log2(n) joins.
    """
    linked = staged(link(messages, message_id, text), "linked")
    start = linked.where("message_id IS NOT NULL").groupBy(F.col("message_id").alias("id")).agg(F.min("parent_id").alias("up"))
    first = F.col("up").isNull()
    reach = staged(start.select("id", F.coalesce("up", "id").alias("up"), F.when(first, 0).otherwise(1).alias("depth"), first.alias("done")), "reach")
    while True:
        # Only messages that have not come to the start of their conversation are joined again.
        open_ends = reach.where("NOT done")
        if open_ends.isEmpty():
            break
        above = reach.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("there"))
        further = open_ends.join(above, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        reach = staged(reach.where("done").unionByName(further), "reach")
    named = reach.select(F.col("id").alias("message_id"), F.col("up").alias("conversation_id"), "depth")
    return linked.join(named, "message_id", "left").select(
        "message_id", "conversation_id", F.coalesce("depth", F.lit(0)).alias("depth"), "parent_id", "quote_level", "own_text"
    )


def as_quoting_mail(turns: DataFrame, levels: int = 2) -> DataFrame:
    """``message_id, text`` of conversations as people send them by mail: each turn above the turns it answers, quoted.

    The message id is made of ``conv_id`` and ``turn``; the turn before is quoted at level 1,
    the one before that at level 2, and so on.
    """
    body = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    out = body
    for level in range(1, levels + 1):
        mark = ">" * level + " "
        quote = F.concat(F.lit(f"\n{mark}"), F.regexp_replace("text", "\n", f"\n{mark}"))
        earlier = body.select("conv_id", (F.col("turn") + level).alias("turn"), quote.alias(f"q{level}"))
        out = out.join(earlier.groupBy("conv_id", "turn").agg(F.min(f"q{level}").alias(f"q{level}")), ["conv_id", "turn"], "left")
    parts = [F.col("text")] + [F.coalesce(f"q{level}", F.lit("")) for level in range(1, levels + 1)]
    return out.select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("message_id"), F.concat(*parts).alias("text"))
