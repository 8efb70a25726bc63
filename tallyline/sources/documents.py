"""Documents of several parts that appear whole or not at all.

Every part of a new version is written to a folder of its own; one appended row of the manifest
then names the version, and readers take what the newest row of a key names. A version without
that row is never read. The version before the newest is kept for readers that just looked it up.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyline.errors import ResultNotFound, ResultReadError
from tallyline.schemas import DOCUMENT_MANIFEST
from tallyline.sources.storage import append_rows, claim_next, read_or_empty, remove_folder

# Versions of a key that stay: the newest and the one before.
KEPT_VERSIONS = 2


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/manifest", DOCUMENT_MANIFEST)


def _folder(path: str, part: str, key: str, version: str) -> str:
    return f"{path}/{part}/run_id={key}/version={version}"


def commit_document(path: str, key: str, parts: dict[str, DataFrame]) -> str:
    """Write all parts of ``key`` as JSON lines and make them visible at once; returns the version."""
    spark, version = next(iter(parts.values())).sparkSession, uuid.uuid4().hex
    rows = []
    try:
        for part, df in parts.items():
            folder = _folder(path, part, key, version)
            df.drop("run_id").write.mode("error").json(folder)
            rows.append((part, df.drop("run_id").schema.json(), spark.read.schema(df.drop("run_id").schema).json(folder).count()))
        newest = _manifest(spark, path).agg(F.max("seq")).first()[0] or 0
        seq = claim_next(spark, f"{path}/claims", newest)
        append_rows(spark, [(key, version, seq, *row) for row in rows], DOCUMENT_MANIFEST, f"{path}/manifest")
    except Exception:
        for part in parts:
            remove_folder(spark, _folder(path, part, key, version))
        raise
    for old in versions_of(spark, path, key)[KEPT_VERSIONS:]:
        for part in parts:
            remove_folder(spark, _folder(path, part, key, old))
    return version


def versions_of(spark: SparkSession, path: str, key: str) -> list[str]:
    """Versions of a key that were made visible, newest first."""
    own = _manifest(spark, path).filter(F.col("run_id") == key).groupBy("version").agg(F.max("seq").alias("seq"))
    return [row.version for row in own.orderBy(F.desc("seq")).collect()]


def read_document(spark: SparkSession, path: str, key: str) -> dict[str, DataFrame]:
    """The parts of the newest version of ``key``; refuses when there is none, or rows are missing from it."""
    manifest = _manifest(spark, path).filter(F.col("run_id") == key).collect()
    if not manifest:
        raise ResultNotFound(f"run {key} has no result document")
    newest = max(row.seq for row in manifest)
    found = {}
    for row in (row for row in manifest if row.seq == newest):
        schema = StructType.fromJson(json.loads(row.schema_json))
        found[row.part] = spark.read.schema(schema).json(_folder(path, row.part, key, row.version)).withColumn("run_id", F.lit(key))
        if found[row.part].count() != row.rows:
            raise ResultReadError(f"{row.part} of run {key} does not hold its {row.rows} rows")
    return found
