"""JSON records whose fields change type from record to record.

Lines are parsed once, into VARIANT; the schema that holds all of them is aggregated while
they are staged, and the staged values are projected on it. There is no inference pass over
the source, and no field is lost or makes a record corrupt because an earlier one had it as
another type.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.transform import CORRUPT_COLUMN
from ..workspace import fresh_path

_OBJECT = "OBJECT<"


def _split(inside: str) -> list[str]:
    """The parts of a type's arguments between commas of its own level; quoted names stay whole."""
    parts, depth, at, quoted = [], 0, 0, False
    for i, c in enumerate(inside):
        quoted ^= c == "`"
        if not quoted:
            depth += (c in "<(") - (c in ">)")
            if c == "," and not depth:
                parts.append(inside[at:i])
                at = i + 1
    return [p.strip() for p in [*parts, inside[at:]] if p.strip()]


def held_type(schema: str) -> T.DataType:
    """The column type for a VARIANT schema as Spark writes it.

    Whole numbers become longs, other numbers doubles, objects structs. A field that is a text
    somewhere, or whose values have no type in common, is a text; so is one that is always null.
    """
    schema = schema.strip()
    if schema.startswith(_OBJECT):
        fields = []
        for part in _split(schema[len(_OBJECT) : -1]):
            name, kind = re.match(r"(`(?:[^`]|``)*`|[^:]*):(.*)", part, re.S).groups()
            name = name.strip()
            name = name[1:-1].replace("``", "`") if name.startswith("`") else name
            fields.append(T.StructField(name, held_type(kind)))
        return T.StructType(fields) if fields else T.StringType()
    if schema.startswith("ARRAY<"):
        return T.ArrayType(held_type(schema[len("ARRAY<") : -1]))
    if schema.startswith("DECIMAL"):
        return T.LongType() if re.fullmatch(r"DECIMAL\((?:\d|1[0-8]),\s*0\)", schema) else T.DoubleType()
    return {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType()}.get(schema, T.StringType())


def _ddl(kind: T.DataType) -> str:
    """The type as SQL writes it, any name quoted."""
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"`{f.name.replace('`', '``')}`: {_ddl(f.dataType)}" for f in kind.fields) + ">"
    return f"array<{_ddl(kind.elementType)}>" if isinstance(kind, T.ArrayType) else kind.simpleString()


def read_drifting(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All JSON lines below the paths, with a column for every field that any of them has.

    A line that is no JSON object stays whole in ``_corrupt_record``; blank lines are skipped.
    Texts keep their characters; a number, object or array in a field that is a text elsewhere
    is written as JSON.
    """
    distinct = list(dict.fromkeys(paths))
    lines = spark.read.option("recursiveFileLookup", "true").text(distinct).where("trim(value) <> ''")
    parsed = lines.select("value", F.try_parse_json("value").alias("parsed"))
    record = F.schema_of_variant("parsed").startswith("OBJECT")
    good = F.when(record, F.col("parsed"))
    kept = parsed.select(good.alias("record"), F.when(~F.coalesce(record, F.lit(False)), F.col("value")).alias(CORRUPT_COLUMN))
    path, seen = fresh_path(spark, "variants"), Observation()
    kept.observe(seen, F.schema_of_variant_agg("record").alias("schema"), F.count(CORRUPT_COLUMN).alias("corrupt")).write.parquet(path)
    kind = held_type(seen.get["schema"] or "VOID")
    staged = spark.read.schema(kept.schema).parquet(path)
    corrupt = [F.col(CORRUPT_COLUMN)] if seen.get["corrupt"] else []
    if not isinstance(kind, T.StructType):
        return staged.select(*corrupt)
    # What does not fit its type, such as a number beyond its range, is null by itself.
    return staged.select(F.try_variant_get("record", "$", _ddl(kind)).alias("record"), *corrupt).select("record.*", *corrupt)
