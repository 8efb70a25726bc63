"""Event-time daily totals as a running stream with a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.operators.ledger import ledger_product_day
from tallyline.schemas import DAILY_VERSIONS
from tallyline.sources.storage import read_or_empty

_TOTALS = ["signed_quantity_sum", "unique_event_count"]


def streaming_product_day(accepted: DataFrame) -> DataFrame:
    """Totals per UTC day and product over a stream of accepted events.

    There is no watermark: an event may change its own day however late it comes. State
    is one row per day and product. Write it in update or complete mode.
    """
    return ledger_product_day(accepted)


def consume_daily(accepted: DataFrame, folder: str) -> StreamingQuery:
    """Add what is available to the totals of ``folder``: each batch writes the days it changed as a version of its own.

    State survives in the checkpoint, so a late event after a restart changes its day and no
    other. A batch that is replayed replaces its own version.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("observed_date", "product_code", *[F.col(c).cast(DAILY_VERSIONS[c].dataType).alias(c) for c in _TOTALS])
        rows.withColumn("version", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("version").parquet(f"{folder}/versions")

    stream = streaming_product_day(accepted).writeStream.outputMode("update").foreachBatch(each)
    return stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def daily_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Every total that was ever written, with its version."""
    return read_or_empty(spark, f"{folder}/versions", DAILY_VERSIONS)


def daily_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The newest total of every day and product."""
    newest = F.max_by(F.struct(*_TOTALS), "version").alias("_newest")
    found = daily_versions(spark, folder).groupBy("observed_date", "product_code").agg(newest)
    return found.select("observed_date", "product_code", *[F.col(f"_newest.{c}").alias(c) for c in _TOTALS])
