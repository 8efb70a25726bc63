"""Session settings every job relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcasts are chosen by size in memory; table files are compressed.
    "spark.sql.sources.fileCompressionFactor": "4",
    # Rewriting one run's partition must leave the other runs alone.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Lists of ids up to this long reach the Parquet reader, where Bloom filters decide.
    "spark.sql.parquet.pushdown.inFilterThreshold": "256",
    # Filters reach the sources written here.
    "spark.sql.python.filterPushdown.enabled": "true",
    # A repeated key in an event payload keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "tallyline", master: str | None = None, **settings: str) -> SparkSession:
    """Create (or reuse) a session with the settings above; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in JOB_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="spark-tallyline-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
