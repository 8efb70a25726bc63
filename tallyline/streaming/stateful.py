"""The ledger's rule as streaming state: the first accepted delivery of every event id, kept between batches and restarts.

The state lies in buckets of ids, so that a batch asks for it once per bucket and not once per id, and a batch is
classified without reading the ledger at all. Where each stream partition stops is not state: it is the least
conflicting offset among the conflicts written so far, few rows in a folder of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyline.operators import ledger as led
from tallyline.schemas import DISPOSITIONS
from tallyline.sources.storage import read_or_empty

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Buckets of event ids; a checkpoint belongs to one number of them. A task holds one bucket's ids at a time.
BUCKETS = 1 << 16
_DISPOSITION = Row(*DISPOSITIONS.fieldNames())
_DELIVERY = ["event_id", "topic", "partition", "kafka_offset", "payload_sha256"]


class FirstDeliveries(StatefulProcessor):
    """Compares the deliveries of a bucket's event ids with the first accepted one of each.

    A batch's deliveries of one bucket, and the bucket's firsts, are held as positions and digests,
    no payloads; new firsts are appended to the state. A delivery in another stream partition than
    the first has a reason, as in ``classify``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firsts = handle.getListState("firsts", "event_id string, topic string, partition int, kafka_offset long, payload_sha256 string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        firsts = {first[0]: (first[1], first[2], first[4]) for first in self.firsts.get()}
        fresh = []
        for delivery in sorted(tuple(row)[: len(_DELIVERY)] for row in rows):
            event_id, topic, partition, offset, sha = delivery
            first = firsts.get(event_id)
            if first is None:
                first = firsts[event_id] = (topic, partition, sha)
                fresh.append(delivery)
                disposition = "accepted"
            else:
                disposition = "redelivery" if sha == first[2] else "conflict"
            reason = None if (topic, partition) == first[:2] else "event_id_spans_partitions"
            yield _DISPOSITION(topic, partition, offset, event_id, sha, first[2], disposition, reason)
        if fresh:
            self.firsts.appendList(fresh)

    def close(self) -> None:
        pass


def dispositions_stream(deliveries: DataFrame) -> DataFrame:
    """Disposition of every delivery (topic, partition, kafka_offset, event_id, payload_sha256) of a stream of valid ones.

    Deliveries of one id must arrive in the order of their offsets from batch to batch, as the
    positions of a log do; inside a batch their order does not matter. The session's state store must be RocksDB.
    """
    slim = deliveries.select(*_DELIVERY, F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    return slim.groupBy("bucket").transformWithState(FirstDeliveries(), DISPOSITIONS, "Append", "None")


def start_dispositions(deliveries: DataFrame, folder: str) -> StreamingQuery:
    """Classify what is available into ``folder``; a batch that is replayed replaces its own rows."""
    spark = deliveries.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "disposition").parquet(f"{folder}/dispositions")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream = dispositions_stream(deliveries).writeStream.foreachBatch(each)
        return stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        # The query has its own copy of the settings.
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def dispositions_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Everything classified so far."""
    return read_or_empty(spark, f"{folder}/dispositions", DISPOSITIONS)


def stops_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Offset of the first conflict of every stream partition that has one."""
    found = dispositions_so_far(spark, folder).filter("disposition = 'conflict'")
    return found.groupBy(*led.STREAM).agg(F.min("kafka_offset").alias("stop_offset"))
