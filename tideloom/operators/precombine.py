"""One row per key out of a batch: the one with the greatest ordering tuple."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import content_order
from ..functions.ordering import order_latest_first
from .keyspec import KeySpec

_RANK = "__rank"


def precombine(
    df: DataFrame,
    spec: KeySpec,
    leading: Sequence[Column] = (),
    tiebreak: Sequence[Column] | None = None,
) -> DataFrame:
    """Keep the latest row of every key within the spec's scope.

    Ties are broken by the row content unless ``tiebreak`` says otherwise, so a
    rerun over differently split input keeps the same row. ``rank == 1`` is
    evaluated before the shuffle too: at most one row per key leaves each task,
    however often a key occurs.
    """
    order = [*leading, *order_latest_first(spec.ordering_values())]
    order += content_order(df.schema, skip=(*spec.scope, *spec.ordering)) if tiebreak is None else tiebreak
    if not order:
        order = [F.lit(0).asc()]
    latest = Window.partitionBy(*[F.col(name) for name in spec.scope]).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(latest)).where(F.col(_RANK) == 1).drop(_RANK)
