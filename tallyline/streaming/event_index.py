"""Accepted events found by id without reading the whole ledger.

Committed batches are gathered into generations: folders of hash buckets, each bucket sorted by
event id with a Bloom filter on it. Generations of one level merge into one of the next, so the
number of folders grows with the logarithm of the batches, and a lookup opens in each of them only
the buckets its ids fall into, and there only the row groups that may hold them. A generation
becomes visible by one appended row; one that a larger one covers is no longer read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.schemas import GENERATIONS, KNOWN_EVENTS
from tallyline.sources.storage import append_rows, read_or_empty, remove_folder

# Batches that make a generation, and generations that merge into one of the next level.
FAN = 8
# Events a bucket file should hold.
BUCKET_EVENTS = 1 << 20
# Ids up to this many are named in the scan's filter, where Bloom filters apply; more are told apart by bucket only.
NAMED_IDS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int")


def buckets_for(events: int) -> int:
    """The power of two at which a bucket holds BUCKET_EVENTS at most, on average."""
    return 1 << max(0, (events - 1) // BUCKET_EVENTS).bit_length()


@dataclass(frozen=True)
class EventIndex:
    """Generations of accepted events under one root folder; one writer at a time."""

    spark: SparkSession
    root: str

    @property
    def generations(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/generations", GENERATIONS)

    def live(self) -> list:
        """Generations that no other one covers, newest last; their number is the logarithm of the batches'."""
        rows = self.generations
        wider = rows.select(F.col("low_seq").alias("_low"), F.col("high_seq").alias("_high"), F.col("level").alias("_level"))
        covered = (F.col("_low") <= F.col("low_seq")) & (F.col("_high") >= F.col("high_seq")) & (F.col("_level") > F.col("level"))
        return rows.join(wider, covered, "left_anti").orderBy("low_seq").collect()

    def covered_seq(self) -> int:
        """Batches up to this number are in some generation."""
        return self.generations.agg(F.max("high_seq")).first()[0] or 0

    def _read(self, generation: str) -> DataFrame:
        return self.spark.read.schema(KNOWN_EVENTS).parquet(f"{self.root}/{generation}")

    def add(self, events: DataFrame, low_seq: int, high_seq: int) -> None:
        """A generation of the events of those batches, and the merges it makes due.

        ``events``: event_id, topic, partition, payload_sha256. A crash before the row that makes
        a generation visible leaves a folder that is never read.
        """
        self._write(events, 1, low_seq, high_seq)
        while True:
            live = self.live()
            levels = [row.level for row in live]
            due = next((level for level in sorted(set(levels)) if levels.count(level) >= FAN), None)
            if due is None:
                return
            old = [row for row in live if row.level == due]
            merged = self._read(old[0].generation)
            for row in old[1:]:
                merged = merged.unionByName(self._read(row.generation))
            self._write(merged, due + 1, old[0].low_seq, old[-1].high_seq)
            for row in old:
                remove_folder(self.spark, f"{self.root}/{row.generation}")

    def _write(self, events: DataFrame, level: int, low_seq: int, high_seq: int) -> None:
        generation, found = uuid.uuid4().hex, events.select("event_id", "topic", "partition", "payload_sha256")
        count = found.count()
        buckets = buckets_for(count)
        dealt = found.withColumn("bucket", _bucket(buckets))
        (
            dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "event_id").write.partitionBy("bucket")
            .option("parquet.bloom.filter.enabled#event_id", "true")
            .option("parquet.bloom.filter.expected.ndv#event_id", str(min(count, BUCKET_EVENTS) or 1))
            .parquet(f"{self.root}/{generation}")
        )
        append_rows(self.spark, [(generation, level, buckets, count, low_seq, high_seq)], GENERATIONS, f"{self.root}/generations")

    def known(self, ids: DataFrame) -> DataFrame:
        """Events of the index that may be among ``ids``, all that are included.

        A few ids are looked up by name; for many, the buckets they fall into are read. At most
        NAMED_IDS ids, or one number per bucket of the largest generation, reach the driver.
        """
        live = [row for row in self.live() if row.events]
        if not live:
            return self.spark.createDataFrame([], KNOWN_EVENTS).drop("bucket")
        widest = max(row.buckets for row in live)
        wanted = ids.select("event_id", F.xxhash64("event_id").alias("hash"))
        few = wanted.distinct().limit(NAMED_IDS + 1).collect()
        named = len(few) <= NAMED_IDS
        if named:
            slots = {row.hash % widest for row in few}
        elif widest > 1:
            slots = {row[0] for row in wanted.select(F.pmod("hash", F.lit(widest))).distinct().collect()}
        else:
            slots = {0}
        found = None
        for row in live:
            part = self._read(row.generation)
            own = sorted({slot % row.buckets for slot in slots})
            if len(own) < row.buckets:
                part = part.filter(F.col("bucket").isin(own))
            if named:
                part = part.filter(F.col("event_id").isin([x.event_id for x in few]))
            found = part if found is None else found.unionByName(part)
        return found.select("event_id", "topic", "partition", "payload_sha256")
