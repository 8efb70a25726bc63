"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.session import scratch_path

# Texts handled at once inside a task, in bytes; a single longer text is handled alone.
SLICE_BYTES = 4 << 20
# Keys with at least one part in so many of all rows are sent to every task instead of being shuffled; there are no more of them than this.
HOT_SHARE = 1000


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` made and that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def joined_by_share(rows: DataFrame, groups: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """``rows`` with the columns of ``groups``, one row per key, where a few keys may hold most rows.

    ``count`` says how many rows a key has (it is not returned). Keys with at least one HOT_SHARE-th of all rows
    are HOT_SHARE at most and go to every task; all others are joined by a shuffle, in which no
    key has more than that share. Null keys are equal to each other. Rows without a group are dropped.
    """
    groups = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = (F.col(count) * HOT_SHARE >= total) & (F.lit(total) > 0)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    away = [f"_{k}" for k in keys] + [count]
    few = F.broadcast(groups.filter(hot).withColumn("_hot", F.lit(True)))
    met = rows.join(few, same, "left")
    left = met.filter("_hot IS NULL").select(*rows.columns)
    return met.filter("_hot").drop("_hot", *away).unionByName(left.join(groups.filter(~hot), same).drop(*away))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Document id and whole text under fixed names; a null text is empty. Other columns do not matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and what it holds counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece stay within ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)
    give_back()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in sorted ``keys``."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def labels_of(n: int, left: np.ndarray, right: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index linked to each of 0..n-1, directly or over others, given links as two index arrays."""
    found = np.arange(n) if labels is None else labels
    while True:
        new = found.copy()
        np.minimum.at(new, left, found[right])
        np.minimum.at(new, right, found[left])
        np.minimum.at(new, found, new)
        new = new[new]
        if np.array_equal(new, found):
            return found
        found = new
