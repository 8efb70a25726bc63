"""Two independently computed results must hold the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def reconcile(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows one side holds more often than the other, with side and surplus; empty is agreement.

    One grouped count over both sides instead of a difference each way: each row
    is shuffled once, and equal rows combine before the shuffle.
    """
    signed = left.select(*columns, F.lit(1).alias("_n")).unionByName(
        right.select(*columns, F.lit(-1).alias("_n"))
    )
    surplus = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return surplus.select(
        F.when(F.col("_n") > 0, "left_only").otherwise("right_only").alias("side"),
        F.abs("_n").cast("bigint").alias("surplus"),
        *columns,
    )
