"""Processed positions as intervals: what is contiguous takes one row, however long.

Offsets meet by slices of 65,536 and become runs there; runs that touch are joined inside their slice,
and over slices by those at a slice's edge alone. A replay is checked against the intervals and the
attempts in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyline.operators.ledger import POSITION, POSITION_KEYS, STREAM, per_stream
from tallyline.schemas import PROCESSED

SLICE_BITS = 16


def runs_of(positions: DataFrame, *by: str) -> DataFrame:
    """topic, partition, first_offset and last_offset of the runs of contiguous offsets in each slice, told apart by the columns ``by``."""
    sliced = positions.groupBy(*STREAM, *by, F.shiftright("kafka_offset", SLICE_BITS).alias("_slice")).agg(
        F.sort_array(F.collect_set("kafka_offset")).alias("_held")
    )
    firsts = F.filter("_held", lambda x, i: (i == 0) | (F.get("_held", i - 1) != x - 1))
    lasts = F.filter("_held", lambda x, i: (i == F.size("_held") - 1) | (F.get("_held", i + 1) != x + 1))
    return sliced.select(*STREAM, F.inline(F.arrays_zip(firsts.alias("first_offset"), lasts.alias("last_offset"))))


def intervals_of(positions: DataFrame) -> DataFrame:
    """topic, partition, first_offset and last_offset of the runs of contiguous offsets; repeats do not matter."""
    return merged(runs_of(positions))


def _cut(runs: DataFrame) -> DataFrame:
    """Runs cut at the edges of slices."""
    slots = F.explode(F.sequence(F.shiftright("first_offset", SLICE_BITS), F.shiftright("last_offset", SLICE_BITS)))
    pieces = runs.select(*STREAM, "first_offset", "last_offset", slots.alias("_slice"))
    begin, end = F.shiftleft("_slice", SLICE_BITS), F.shiftleft(F.col("_slice") + 1, SLICE_BITS) - 1
    return pieces.withColumns({"first_offset": F.greatest("first_offset", begin), "last_offset": F.least("last_offset", end)})


def _islands(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs that touch or overlap as one, in each group."""
    order = Window.partitionBy(*by).orderBy("first_offset", "last_offset")
    before = F.max("last_offset").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("first_offset") > before + 1), 1).otherwise(0)
    numbered = runs.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min("first_offset").alias("first_offset"), F.max("last_offset").alias("last_offset"))


def merged(runs: DataFrame) -> DataFrame:
    """Intervals of runs that may touch or overlap, as those of several batches.

    Runs meet in their slice. Only those that touch a slice's edge may go on in the next one: a
    stream partition has two of them per slice at most, however many gaps it has.
    """
    size = 1 << SLICE_BITS
    inside = _islands(_cut(runs), [*STREAM, "_slice"]).select(*STREAM, "first_offset", "last_offset")
    at_edge = (F.pmod("first_offset", F.lit(size)) == 0) | (F.pmod(F.col("last_offset") + 1, F.lit(size)) == 0)
    over = _islands(inside.filter(at_edge), STREAM).select(inside.columns)
    return inside.filter(~at_edge).unionByName(over)


def interval_gaps(intervals: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Starts of intervals whose predecessor is not behind the checkpoint: the rows of ``position_gaps``."""
    expected = F.coalesce("durable_next_offset", F.lit(0))
    joined = intervals.join(checkpoint.select(*STREAM, "durable_next_offset"), STREAM, "left")
    return joined.filter(F.col("first_offset") > expected).select(
        *STREAM, F.col("first_offset").alias("kafka_offset"), expected.alias("durable_next_offset")
    )


def _covered(positions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Positions with ``_in``, whether an interval holds them.

    Positions and intervals are ordered together in each slice, so a position sees the intervals that
    begin at or before it without being compared with any other, and no stream partition is one task's.
    """
    begins = _cut(intervals).select(*STREAM, "_slice", F.col("first_offset").alias("kafka_offset"), F.col("last_offset").alias("_last"))
    sliced = positions.withColumn("_slice", F.shiftright("kafka_offset", SLICE_BITS))
    both = sliced.withColumn("_asked", F.lit(True)).unionByName(begins, allowMissingColumns=True)
    order = Window.partitionBy(*STREAM, "_slice").orderBy("kafka_offset", F.col("_last").desc_nulls_last())
    reach = F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = F.coalesce(F.col("kafka_offset") <= reach, F.lit(False))
    return both.withColumn("_in", inside).filter("_asked").select(*positions.columns, "_in")


def unproven_positions(deliveries: DataFrame, attempts: DataFrame, intervals: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Deliveries behind the checkpoint without an exact, processed prior delivery.

    Those outside every interval were never processed, whatever the attempts hold; the
    others are compared with the attempts at their own positions.
    """
    keys = [*POSITION, "event_id", "payload_sha256"]
    bound = F.coalesce("durable_next_offset", F.lit(0)).alias("durable_next_offset")
    # A stream without a checkpoint has processed nothing.
    known = per_stream(checkpoint.select(*STREAM, "durable_next_offset"))
    behind = deliveries.join(known, STREAM, "left").select(*keys, bound).filter("kafka_offset < durable_next_offset")
    by = [*POSITION_KEYS, "event_id", "payload_sha256"]
    processed = attempts.filter(F.col("disposition").isin(*PROCESSED)).select(*[F.col(c).alias(f"_{c}") for c in by])
    proven = F.col("_in")
    for c in by:
        proven = proven & (F.col(c) == F.col(f"_{c}"))
    return _covered(behind, intervals).join(processed, proven, "left_anti").select(*keys, "durable_next_offset")
