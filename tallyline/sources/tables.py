"""Tabular files as sources of located rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Row 1 of a sheet is its header, so the first data row is row 2.
FIRST_DATA_ROW = 2


def located_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with the file they lie in and their row number there.

    The scan knows both, so a location costs no shuffle and no sort, and it is unique
    even when whole rows repeat. A file is named by the table's own name and what follows it
    in the path, so equal base names in different folders stay apart.
    """
    return spark.read.parquet(path).select(
        "*",
        _name_below(spark, path).alias("source_file_name"),
        (F.col("_metadata.row_index") + FIRST_DATA_ROW).alias("source_row_number"),
    )


def _name_below(spark: SparkSession, path: str) -> Column:
    """The file's path from the table's own name on; where the table lies is worked out once, not per row."""
    file, table = F.col("_metadata.file_path"), path.rstrip("/").rsplit("/", 1)[-1]
    parent = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder = f"{parent.toUri().getRawPath()}/" if parent else ""
    if re.search(r"[*?\[{]", path) or not folder.startswith("/") or folder == "//":
        # A pattern, a relative path or the root tells no folder of its own.
        return F.regexp_replace(F.url_decode(file), rf"^.*?/(?={re.escape(table)}(?:/|$))", "")
    below = F.substring(file, F.locate(folder, file) + len(folder), F.length(file))
    return F.when(below.contains("%"), F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))).otherwise(below)
