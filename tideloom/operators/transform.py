"""Per-batch steps between reading and merging."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the view name under which a transform sees its batch.
BATCH_VIEW = "temp"
CORRUPT_COLUMN = "_corrupt_record"
REASON_COLUMN = "_reason"


def sql_transform(
    df: DataFrame,
    query: str | None = None,
    function: Callable[[DataFrame], DataFrame] | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Replace the batch by the result of a SQL query over the view ``temp``.

    The query runs in the session the batch belongs to: inside a streaming
    micro-batch that is not the session the stream was started from.
    """
    if query is not None:
        if not query.strip() or query.strip() == "default":
            raise ValueError("the SQL transformer is switched on without a query")
        df.createOrReplaceTempView(BATCH_VIEW)
        df = df.sparkSession.sql(query)
    if function is not None:
        df = function(df)
    held = {name.lower() for name in df.columns}
    lost = [name for name in required if name.lower() not in held]
    if lost:
        raise ValueError(f"the transformed batch lacks the columns {lost}")
    return df


def mark_invalid(
    df: DataFrame,
    keys: Sequence[str],
    parts: Sequence[str] = (),
    timestamps: Sequence[str] = (),
) -> DataFrame:
    """Append the reason why a row cannot be stored, null where it can.

    A row is rejected if the reader marked it as corrupt, a key column is null,
    a text partition value is empty (it would read back as null), or a text
    listed under ``timestamps`` is not one.
    """
    reason = F.lit(None).cast("string")
    for name in timestamps:
        if isinstance(df.schema[name].dataType, T.StringType):
            unreadable = F.col(name).isNotNull() & F.try_to_timestamp(F.col(name)).isNull()
            reason = F.when(unreadable, f"not a timestamp: {name}").otherwise(reason)
    for name in parts:
        if isinstance(df.schema[name].dataType, T.StringType):
            reason = F.when(F.col(name) == "", f"empty partition value: {name}").otherwise(reason)
    for name in keys:
        reason = F.when(F.col(name).isNull(), f"null key: {name}").otherwise(reason)
    if CORRUPT_COLUMN in df.columns:
        reason = F.when(F.col(CORRUPT_COLUMN).isNotNull(), "corrupt record").otherwise(reason)
    return df.withColumn(REASON_COLUMN, reason)


def split_valid(df: DataFrame, keys: Sequence[str], **checks) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored and rows that cannot, the latter with a reason (see ``mark_invalid``)."""
    judged = mark_invalid(df, keys, **checks)
    good = judged.where(F.col(REASON_COLUMN).isNull()).drop(REASON_COLUMN, CORRUPT_COLUMN)
    return good, judged.where(F.col(REASON_COLUMN).isNotNull())


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    return df.limit(rows)
