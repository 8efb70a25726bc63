"""Membership of runs as bitmaps: 32,768 row numbers to a slice, a bit each.

A run's rows are stored and compared by slices; only slices that differ are opened into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SHEET = ["source_file_id", "sheet_name"]
SLICE_ROWS = 32_768
# A slice is looked at in words of eight bytes.
_WORDS = SLICE_ROWS // 64


def membership_bitmaps(members: DataFrame) -> DataFrame:
    """run_id, file, sheet, slice and bits of every run's rows; a row number given twice is one bit, a null one none."""
    row = F.col("source_row_number")
    dealt = members.filter(row.isNotNull()).groupBy("run_id", *SHEET, F.bitmap_bucket_number(row).alias("slice"))
    return dealt.agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("bits"))


def combined_bitmaps(parts: DataFrame) -> DataFrame:
    """Bitmaps of parts of the same runs as one each, as when members were landed in several loads."""
    return parts.groupBy("run_id", *SHEET, "slice").agg(F.bitmap_or_agg("bits").alias("bits"))


def _word(bits: Column, index: Column) -> Column:
    """Eight bytes of a slice as a long, zero where there is no slice."""
    return F.coalesce(F.conv(F.hex(F.substring(bits, index * 8 + 1, F.lit(8))), 16, -10).cast("bigint"), F.lit(0).cast("bigint"))


def _shift(bit: Column) -> Column:
    """Where the bit of a position lies in its word: bytes from the highest on, bits from the lowest."""
    return (F.lit(7) - F.floor(bit / 8)) * 8 + bit % 8


def _row_number(word: Column, bit: Column) -> Column:
    """The row number of a bit; slices count from 1, and those at 0 and below hold numbers below 1."""
    position = word * 64 + bit
    above = (F.col("slice") - 1) * SLICE_ROWS + position + 1
    return F.when(F.col("slice") > 0, above).otherwise(F.col("slice") * SLICE_ROWS - position).cast("bigint")


def _opened(slices: DataFrame, word: Column, kept: list[str]) -> DataFrame:
    """A row per set bit of ``word``, which is worked out for every word of the slices."""
    words = slices.withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(_WORDS - 1)))).withColumn("_bits", word).filter("_bits <> 0")
    bits = words.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter(F.getbit("_bits", _shift(F.col("_b")).cast("int")) == 1)
    return bits.select(*kept, _row_number(F.col("_w"), F.col("_b")).alias("source_row_number"))


def members_of(bitmaps: DataFrame) -> DataFrame:
    """The rows again: run_id, file, sheet and row number."""
    opened = _opened(bitmaps, _word(F.col("bits"), F.col("_w")), ["run_id", *SHEET])
    return opened.select("run_id", *SHEET, "source_row_number")


def member_counts(bitmaps: DataFrame) -> DataFrame:
    """Selected rows of every run."""
    return bitmaps.groupBy("run_id").agg(F.sum(F.bitmap_count("bits")).alias("actual_count"))


def count_mismatch(bitmaps: DataFrame, expected: DataFrame) -> DataFrame:
    """Runs whose membership does not hold the expected number of rows."""
    both = expected.select("run_id", "expected_count").join(member_counts(bitmaps), "run_id", "full_outer")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("expected_count", "actual_count")]
    return both.select("run_id", *counts).filter("expected_count <> actual_count")


def row_diff(bitmaps: DataFrame, base_run: str, current_run: str) -> DataFrame:
    """Rows added or removed between two runs over the sheets that both touch; slices that are equal stay closed."""
    sides = bitmaps.filter(F.col("run_id").isin(base_run, current_run))

    def of(run: str) -> Column:
        return F.max(F.when(F.col("run_id") == run, F.col("bits")))

    touched = (
        sides.groupBy(*SHEET).agg(F.max(F.col("run_id") == base_run).alias("b"), F.max(F.col("run_id") == current_run).alias("c")).filter("b AND c")
    )
    slices = sides.groupBy(*SHEET, "slice").agg(of(base_run).alias("base"), of(current_run).alias("current"))
    apart = slices.filter(~F.col("base").eqNullSafe(F.col("current"))).join(touched.select(*SHEET), SHEET, "left_semi")
    base, current = _word(F.col("base"), F.col("_w")), _word(F.col("current"), F.col("_w"))
    added = _opened(apart, current.bitwiseAND(F.bitwise_not(base)), SHEET).withColumn("change", F.lit("added"))
    removed = _opened(apart, base.bitwiseAND(F.bitwise_not(current)), SHEET).withColumn("change", F.lit("removed"))
    return added.unionByName(removed).select("change", *SHEET, "source_row_number")
