"""Column-level helpers: names, flags, date parts and schema reconciliation."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of a flag that mean "on"; every other value means off.
ON_SPELLINGS = ("True", "true")

# Casts that keep every value, by (stored batch type -> table type).
WIDENING = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    T.ShortType: (T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    T.IntegerType: (T.LongType, T.DoubleType),
    T.FloatType: (T.DoubleType,),
    T.DateType: (T.TimestampType, T.TimestampNTZType),
    T.NullType: (T.DataType,),
}


class SchemaConflict(ValueError):
    """A batch column cannot be stored in the table column of the same name."""


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Drop every ``$`` from the top-level column names, in one projection.

    Two columns that would end up with the same name are an error: a later
    reference to that name could not be resolved.
    """
    renamed = [name.replace("$", "") for name in df.columns]
    clashes = [n for n, seen in Counter(n.lower() for n in renamed).items() if seen > 1]
    if clashes:
        raise SchemaConflict(f"column names collide once '$' is dropped: {sorted(clashes)}")
    if "" in renamed:
        raise SchemaConflict("a column name consists of '$' only")
    return df.toDF(*renamed)


def is_on(flag: Column | str) -> Column:
    """True where the flag text is one of the accepted "on" spellings; null counts as off."""
    column = F.col(flag) if isinstance(flag, str) else flag
    return F.coalesce(column.cast("string").isin(*ON_SPELLINGS), F.lit(False))


def add_date_parts(df: DataFrame, source: str, parts: tuple[str, ...] = ("year", "month", "day")) -> DataFrame:
    """Append integer date parts of ``source``; text that is no timestamp gives null parts."""
    read = {"year": F.year, "month": F.month, "day": F.dayofmonth}
    stamp = F.col(source)
    if isinstance(df.schema[source].dataType, T.StringType):
        stamp = F.try_to_timestamp(stamp)
    return df.withColumns({part: read[part](stamp) for part in parts})


def content_order(schema: T.StructType, skip: tuple[str, ...] = ()) -> list[Column]:
    """A descending order over the row content, to break ordering ties the same way on every run."""
    skipped = {name.lower() for name in skip}
    order = []
    for field in sorted(schema.fields, key=lambda f: f.name):
        if field.name.lower() in skipped:
            continue
        column = F.col(f"`{field.name}`")
        if _holds(field.dataType, T.VariantType):
            column = column.cast("string") if isinstance(field.dataType, T.VariantType) else F.to_json(column)
        elif _holds(field.dataType, T.MapType):
            column = F.to_json(column)
        order.append(column.desc_nulls_last())
    return order


def merged_schema(table: T.StructType, batch: T.StructType) -> T.StructType:
    """The table's columns followed by the batch's new ones; incompatible types raise."""
    known = {f.name.lower(): f for f in table.fields}
    fields = [T.StructField(f.name, f.dataType, True) for f in table.fields]
    for field in batch.fields:
        held = known.get(field.name.lower())
        if held is None:
            kind = T.StringType() if isinstance(field.dataType, T.NullType) else field.dataType
            fields.append(T.StructField(field.name, kind, True))
        elif not _fits(field.dataType, held.dataType):
            raise SchemaConflict(
                f"column {field.name}: batch type {field.dataType.simpleString()} "
                f"does not fit table type {held.dataType.simpleString()}"
            )
    return T.StructType(fields)


def conform_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``: same order and types, absent columns as nulls."""
    held = {f.name.lower(): f for f in df.schema.fields}
    columns = []
    for field in schema.fields:
        source = held.get(field.name.lower())
        if source is None:
            column = F.lit(None).cast(field.dataType)
        else:
            column = F.col(f"`{source.name}`")
            if source.dataType != field.dataType:
                column = column.cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _fits(batch: T.DataType, table: T.DataType) -> bool:
    if type(batch) is type(table):
        # Nested nullability may differ between files; names and leaf types must not.
        return batch.simpleString() == table.simpleString()
    return any(isinstance(table, wider) for wider in WIDENING.get(type(batch), ()))


def _holds(kind: T.DataType, wanted: type) -> bool:
    if isinstance(kind, wanted):
        return True
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, wanted) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, wanted)
    if isinstance(kind, T.MapType):
        return _holds(kind.keyType, wanted) or _holds(kind.valueType, wanted)
    return False
