"""Parquet tables under one root: read with a fixed schema, append, or replace by run."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyline.session import scratch_path


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``, or no rows when nothing was written there yet.

    Columns that older files do not have read as null.
    """
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def append_rows(spark: SparkSession, rows: list[tuple], schema: StructType, path: str) -> None:
    """Append a handful of control rows as one file, which appears whole or not at all."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def kept(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder, for plans that read it more than once."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write the partitions ``df`` holds and leave all others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that no reader is told of any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def claim_next(spark: SparkSession, folder: str, newest: int) -> int:
    """The first number behind ``newest`` that no other writer has taken, taken by creating its file.

    Of writers that meet at a number one gets it and the others go on to the next; a writer that
    ends before it uses its number leaves a hole. This is as exact as the store's exclusive creation.
    """
    number, hadoop = newest, spark._jvm.org.apache.hadoop.fs
    while True:
        number += 1
        claim = hadoop.Path(f"{folder}/{number:019d}")
        try:
            claim.getFileSystem(spark._jsc.hadoopConfiguration()).create(claim, False).close()
            return number
        except Py4JJavaError as exc:
            if "FileAlreadyExists" not in exc.java_exception.getClass().getName():
                raise


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as readers outside Spark's own need it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().toString().replace("file:/", "file:///", 1)
