"""Registered queries whose operators keep tables of their own: indexes, state, bitmaps, digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.operators import bitmaps as bit
from tallyline.operators import intervals as ivl
from tallyline.operators import ledger as led
from tallyline.operators.digest_tree import digest_tree, differing_leaves, reconcile_by_digest
from tallyline.operators.scope import scope_ids
from tallyline.operators.product_day import contributions, days_of
from tallyline.operators.typed import typed_lines
from tallyline.plans import delivery_views as dv
from tallyline.plans import retail_views as rv
from tallyline.session import scratch_path
from tallyline.sources.replay import read_log, write_log
from tallyline.sources.storage import kept
from tallyline.streaming.daily import consume_daily, daily_totals
from tallyline.streaming.event_index import FAN, EventIndex
from tallyline.streaming.ledger_stream import Ledger, consume_available
from tallyline.streaming.stateful import dispositions_so_far, start_dispositions

Query = Callable[[SparkSession, str], DataFrame]
STORED_QUERIES: dict[str, Query] = {}


def stored(fn: Query) -> Query:
    STORED_QUERIES[fn.__name__] = fn
    return fn


@stored
def dispositions_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log met again by a ledger up to mid January, kept as an index by event id that was filled in nine batches."""
    decoded = dv.decoded_deliveries(spark, sf_dir, with_conflicts=True)
    log = kept(decoded.select(*led.POSITION, "event_id", "payload_sha256", "observed_date"), "log")
    accepted = led.classify(log, unique_positions=True).filter("disposition = 'accepted' AND observed_date < '2024-01-15'")
    batch = F.pmod(F.xxhash64("event_id", F.lit("batch")), F.lit(FAN + 1)).cast("int").alias("batch")
    known = kept(accepted.select("event_id", "topic", "partition", "payload_sha256", batch), "known", "batch")
    index = EventIndex(spark, scratch_path(spark, "event-index"))
    for k in range(FAN + 1):
        index.add(known.filter(F.col("batch") == k), k + 1, k + 1)
    found = led.classify(log, index.known(log.select("event_id")), unique_positions=True)
    return found.groupBy("partition", "disposition").agg(
        F.count(F.lit(1)).alias("deliveries"), F.min("kafka_offset").alias("first_offset")
    )


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; as a pattern, so that it may be one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return dv.located(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))


@stored
def dispositions_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log classified by a stream that keeps the first delivery of every event id as state."""
    folder = scratch_path(spark, "stateful")
    log = dv.decode_events(dv.deliveries(_event_stream(spark, sf_dir), with_conflicts=True)).filter("reason IS NULL")
    start_dispositions(log, folder).awaitTermination()
    return dispositions_so_far(spark, folder).select(
        "topic", "partition", "kafka_offset", "event_id", "payload_sha256", "existing_payload_sha256", "disposition"
    )


@stored
def running_product_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals kept by a stream of all events, once each, read back from the newest versions."""
    folder = scratch_path(spark, "daily")
    once = dv.decode_events(dv.once_each(_event_stream(spark, sf_dir))).filter("reason IS NULL")
    consume_daily(once, folder).awaitTermination()
    return daily_totals(spark, folder).withColumn("signed_quantity_sum", F.col("signed_quantity_sum").cast("string"))


@stored
def row_diff_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a later selection left out, told from bitmaps of both."""
    return bit.row_diff(bit.membership_bitmaps(rv.members_both(spark, sf_dir)), rv.ALL_ROWS_RUN, rv.KEPT_ROWS_RUN)


@stored
def count_mismatch_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs per month against the lines they should hold, counted in bitmaps that were landed in two parts."""
    whole = rv.members_all(spark, sf_dir).withColumn("run_id", F.col("sheet_name"))
    held = rv.members_kept(spark, sf_dir).withColumn("run_id", F.col("sheet_name"))
    expected = whole.groupBy("run_id").agg(F.count(F.lit(1)).alias("expected_count"))
    odd = F.col("source_row_number") % 2 == 1
    parts = bit.membership_bitmaps(held.filter(odd)).unionByName(bit.membership_bitmaps(held.filter(~odd)))
    return bit.count_mismatch(bit.combined_bitmaps(parts), expected)


@stored
def scope_ids_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the selections, of rows read back from bitmaps."""
    return scope_ids(bit.members_of(bit.membership_bitmaps(rv.members_both(spark, sf_dir))))


_DAY = ["observed_date", "stock_code", "sample_quantity_sum", "observed_row_count"]


def _days(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    return days_of(contributions(typed_lines(rv.raw_rows(spark, sf_dir)), members))


@stored
def reconcile_differences_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over different selections: the rows each side alone holds, opened by differing digests only."""
    whole, kept = (_days(spark, sf_dir, m(spark, sf_dir)) for m in (rv.members_all, rv.members_kept))
    return reconcile_by_digest(whole, kept, _DAY)


@stored
def digest_tree_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of a run against themselves in another order and partitioning: no leaf differs."""
    columns = ["source_file_id", "sheet_name", "source_row_number"]
    members = rv.members_all(spark, sf_dir)
    there = digest_tree(members, columns)
    apart = differing_leaves(there, digest_tree(members.repartition(5, "sheet_name"), columns))
    return apart.agg(F.count(F.lit(1)).alias("differing_leaves")).select("differing_leaves", there.filter("level = 0").select("rows").scalar().alias("members"))


@stored
def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log written as segments of files and consumed from there by the ledger stream, then read back as totals."""
    folder = scratch_path(spark, "replay")
    write_log(dv.deliveries(dv.events_table(spark, sf_dir)), f"{folder}/log")
    ledger = Ledger(spark, f"{folder}/ledger")
    consume_available(read_log(spark, f"{folder}/log"), ledger, f"{folder}/checkpoint")
    return led.ledger_product_day(ledger.events).withColumn("signed_quantity_sum", F.col("signed_quantity_sum").cast("string"))


def _merged_intervals(log: DataFrame) -> DataFrame:
    """Intervals of ten batches, joined as a ledger would."""
    batch = F.floor(F.col("kafka_offset") / 100) % 10
    return ivl.merged(ivl.runs_of(log.withColumn("batch", batch), "batch"))


@stored
def position_gaps_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without its signup events in ten batches: where its intervals begin behind the checkpoint."""
    log = dv.decoded_deliveries(spark, sf_dir).filter("product_code <> 'signup'")
    checkpoint = log.groupBy("topic", "partition").agg(F.lit(5).cast("bigint").alias("durable_next_offset"))
    return ivl.interval_gaps(_merged_intervals(log), checkpoint)


@stored
def prior_position_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay of the whole log against intervals and attempts without view events."""
    log = kept(dv.decoded_deliveries(spark, sf_dir).select(*led.POSITION, "event_id", "payload_sha256", "product_code"), "log")
    attempts = kept(led.classify(log, unique_positions=True).filter("product_code <> 'view'"), "attempts")
    checkpoint = log.groupBy("topic", "partition").agg((F.max("kafka_offset") + 1).alias("durable_next_offset"))
    return ivl.unproven_positions(log, attempts, _merged_intervals(attempts), checkpoint)
