"""The orders table read as a log of runs: one run per order.

Orders of status F are succeeded and published runs, P failed ones, O still running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.operators.landing import align_schema
from tallyline.schemas import PUBLICATIONS, RUN_EVENTS, SCOPES


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "*",
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("ordered_at"),
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start event per run and, unless it is still running, an end event.

    Runs of the lowest priority end on a clock one hour behind their start.
    """
    orders = _orders(spark, sf_dir)
    started = orders.select(
        "run_id",
        (F.col("o_orderkey") * 2).alias("event_seq"),
        F.lit("running").alias("status"),
        F.col("ordered_at").alias("at"),
        F.concat(F.lit("file-"), F.col("o_custkey").cast("string")).alias("source_file_id"),
        F.concat(F.lit("/in/"), F.col("o_orderpriority")).alias("input_path"),
    )
    succeeded = F.col("o_orderstatus") == "F"
    drift = F.when(F.col("o_orderpriority") == "5-LOW", F.expr("INTERVAL -1 HOUR")).otherwise(
        F.expr("INTERVAL 1 HOUR")
    )
    ended = orders.filter("o_orderstatus <> 'O'").select(
        "run_id",
        (F.col("o_orderkey") * 2 + 1).alias("event_seq"),
        F.when(succeeded, "succeeded").otherwise("failed").alias("status"),
        (F.col("ordered_at") + drift).alias("at"),
        F.when(~succeeded, F.concat(F.lit("refused: "), F.col("o_orderpriority"))).alias("error_message"),
        F.when(succeeded, F.col("o_orderkey")).alias("publish_seq"),
    )
    return align_schema(started, RUN_EVENTS).unionByName(align_schema(ended, RUN_EVENTS))


def publication_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications as an older log may hold them: some of unfinished or failed runs too."""
    kept = _orders(spark, sf_dir).filter("o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
    rows = kept.select(
        "run_id", F.col("o_orderkey").alias("publish_seq"), F.col("ordered_at").alias("published_at")
    )
    return align_schema(rows, PUBLICATIONS)


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scope per run; runs of unspecified priority left none, low ones no rule ids."""
    orders = _orders(spark, sf_dir).filter("o_orderpriority <> '4-NOT SPECIFIED'")
    older = F.col("o_orderpriority") == "5-LOW"
    rows = orders.select(
        "run_id",
        F.concat(F.lit("file-"), F.col("o_custkey").cast("string")).alias("source_file_id"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("sheet_name"),
        F.concat(F.lit("scope-"), F.col("o_custkey").cast("string")).alias("input_scope_id"),
        F.when(~older, F.lit("rule-1")).alias("aggregation_rule_id"),
        F.when(~older, F.lit("rule-2")).alias("transformation_rule_id"),
    )
    return align_schema(rows, SCOPES)


def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows found in storage: those of succeeded runs, and some never published."""
    orders = _orders(spark, sf_dir).filter("o_orderstatus = 'F' OR o_orderpriority = '2-HIGH'")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.select("o_orderkey", "run_id").join(lines, "o_orderkey").select("run_id")
