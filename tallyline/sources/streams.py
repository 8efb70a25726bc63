"""Delivery logs as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.schemas import ENVELOPE


# Offsets a micro-batch may hold, over all partitions: a backlog is taken in parts, each refused or kept by itself.
BATCH_OFFSETS = 5_000_000


def kafka_source_options(servers: str, topic: str, batch_offsets: int = BATCH_OFFSETS, **extra: str) -> dict[str, str]:
    """Start at the earliest offset, and fail when the log lost data instead of skipping it.

    Progress is the ledger's and the query's own; nothing commits offsets behind them.
    """
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
        "maxOffsetsPerTrigger": str(batch_offsets),
        **extra,
    }


def kafka_sink_options(servers: str, topic: str, **extra: str) -> dict[str, str]:
    """Every replica acknowledges, and retries do not repeat an event."""
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
        **extra,
    }


def read_events(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Deliveries of a Kafka topic as a stream; the connector must be on the class path."""
    return as_deliveries(spark.readStream.format("kafka").options(**options).load())


def read_event_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same envelope as a stream of JSON files."""
    return as_deliveries(spark.readStream.schema(ENVELOPE).options(**options).json(path))


def as_deliveries(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("topic", "partition", F.col("offset").alias("kafka_offset"), "value")


def keyed_payloads(events: DataFrame) -> DataFrame:
    """Key and value of produced events. The key keeps an event id in one partition."""
    return events.select(F.col("event_id").alias("key"), F.col("payload_json").alias("value"))


def write_events(events: DataFrame, options: dict[str, str]) -> None:
    """Produce canonical events to Kafka; the job fails unless every one was delivered."""
    keyed_payloads(events).write.format("kafka").options(**options).save()
