"""Systematic samples that depend on the row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscore.operators.skew import dense_index


def spaced_sample(df: DataFrame, order_id: str, n: int) -> DataFrame:
    """``n`` rows evenly spaced in order of a distinct integer id, fewer only if there are fewer.

    Row ``i`` of N is taken when it is ``floor(s N / n)`` for some ``s < n``.
    """
    total = df.count()
    take = min(int(n), total)
    if take == 0:
        return df.limit(0)
    index = F.col("_i").cast("decimal(20,0)")
    slot = F.ceil(index * take / total).cast("bigint")
    first = F.floor(slot.cast("decimal(20,0)") * total / take).cast("bigint")
    rows = dense_index(df, order_id, "_i")
    return rows.where((slot < take) & (first == F.col("_i"))).select(*df.columns)
