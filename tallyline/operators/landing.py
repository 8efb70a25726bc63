"""Landing: first write wins, later loads only fill what was never recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from tallyline.schemas import LOCATION

# Rows of both sides that a task should compare, and landed rows up to which the comparison is left to Spark's choice.
TASK_ROWS = 1 << 20
FEW_ROWS = 1 << 16


def align_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Give ``df`` exactly the columns of ``schema``; columns it never had read as null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key: the smallest by ``order``, then by its other columns.

    A grouped minimum combines before the shuffle, so many copies of one key cost
    one row per task, not one hot partition.
    """
    rest = order + [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def land_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` whose location has not landed yet, one per location.

    Both sides are counted first. More than FEW_ROWS landed rows are no broadcast; both sides are then
    dealt by location into as many partitions as they need, so a task's memory does not grow with the tables.
    """
    landed, dealt = existing.select(*LOCATION), incoming
    before = landed.count()
    if before > FEW_ROWS:
        usual = int(existing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(-(-(before + incoming.count()) // TASK_ROWS), usual)
        landed, dealt = landed.repartition(parts, *LOCATION), dealt.repartition(parts, *LOCATION)
    fresh = dealt.join(landed, LOCATION, "left_anti")
    return _first_per_key(fresh.select(*incoming.columns), LOCATION, ["loaded_at"])


def changed_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Locations that landed with another content than they have now; load times and kinds do not count."""
    content = [c for c in incoming.columns if c not in (*LOCATION, "loaded_at", "invoice_no_source_kind")]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*LOCATION, F.struct(*content).alias(name))

    both = side(incoming, "_now").join(side(existing, "_then"), LOCATION)
    return both.filter(F.col("_now") != F.col("_then")).select(*LOCATION).distinct()


def register_files(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Files of ``incoming`` not registered yet, one row per file id."""
    fresh = incoming.join(existing.select("source_file_id"), "source_file_id", "left_anti")
    return _first_per_key(fresh.select(*incoming.columns), ["source_file_id"], ["registered_at"])


def backfill_kind(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fill a missing invoice kind from a later load of the same location; never overwrite."""
    offered = incoming.groupBy(*LOCATION).agg(F.min("invoice_no_source_kind").alias("_offered"))
    filled = F.coalesce("invoice_no_source_kind", "_offered")
    return (
        existing.join(offered, LOCATION, "left")
        .withColumn("invoice_no_source_kind", filled)
        .select(*existing.columns)
    )


def select_rows(default: DataFrame, override: DataFrame | None, run_id: str | Column) -> DataFrame:
    """Membership of a run: the override's locations when given, else the default's."""
    chosen = default if override is None else override
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    return chosen.select(run.alias("run_id"), "source_file_id", "sheet_name", "source_row_number")


def last_selected(selection: DataFrame) -> DataFrame:
    """The highest selected row number of every file and sheet: a scan need not go further."""
    return selection.groupBy("source_file_id", "sheet_name").agg(F.max("source_row_number").alias("last_row"))


def restrict_rows(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Only rows whose location was selected."""
    return rows.join(selection.select(*LOCATION), LOCATION, "left_semi").select(*rows.columns)


def missing_rows(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected locations that the source does not hold."""
    return selection.join(rows.select(*LOCATION), LOCATION, "left_anti").select(*selection.columns)
