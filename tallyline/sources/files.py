"""Source files and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.functions.identity import sha256_id
from tallyline.functions import strict_json as sj
from tallyline.functions.text import is_blank
from tallyline.schemas import MANIFEST, MANIFEST_KEYS


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files, one row each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def fingerprint_files(files: DataFrame) -> DataFrame:
    """File ids from file bytes."""
    return files.select(
        sha256_id(F.col("content")).alias("source_file_id"),
        F.sha2("content", 256).alias("sha256"),
        F.element_at(F.split("path", "/"), -1).alias("original_file_name"),
        F.col("path").alias("stored_path"),
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest file, named after it."""
    return (
        spark.read.schema(MANIFEST)
        .option("multiLine", True)
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("manifest_file"))
    )


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Manifests without one of the required keys, with the names of those keys."""
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in MANIFEST_KEYS]))
    return manifests.select("manifest_file", missing.alias("missing_keys")).filter(F.size("missing_keys") > 0)


def manifest_selection(manifests: DataFrame) -> DataFrame:
    """Default selection: one row per manifest and selected row number."""
    return manifests.select(
        "manifest_file", F.col("sheet").alias("sheet_name"), F.explode("selected_excel_rows").alias("source_row_number")
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON-lines files without the blank ones: file name and line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))
    return lines.filter(~is_blank(F.col("line")))


def jsonl_violations(lines: DataFrame) -> DataFrame:
    """Lines that are not exactly one JSON object."""
    doc = sj.parsed(F.col("line"))
    is_object = sj.is_whole(doc, F.col("line")) & sj.body_type(doc).startswith("OBJECT")
    return lines.filter(~F.coalesce(is_object, F.lit(False)))
