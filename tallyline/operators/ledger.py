"""The event ledger's rules as set operations.

The rules are stated one delivery at a time; here a whole log or micro-batch is
classified at once. Nothing orders or lists a whole event id or stream partition in
one task: firsts and stops are grouped minima, which combine before the shuffle, and the
joins back have one small row per key on their other side, which a skew join can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyline.functions.numbers import wide_sum
from tallyline.schemas import PROCESSED

STREAM = ["topic", "partition"]
POSITION = ["topic", "partition", "kafka_offset"]
# Stream partitions a consumer may have; what is known per partition is sent to all tasks.
MAX_STREAMS = 100_000
# The same as join keys: the offset leads, because it is what tells rows apart when sorting.
POSITION_KEYS = ["kafka_offset", "partition", "topic"]


def first_registrations(deliveries: DataFrame) -> DataFrame:
    """Per event id, the position and content of its first delivery."""
    first = F.min(F.struct(*POSITION, "payload_sha256"))
    return deliveries.groupBy("event_id").agg(first.alias("first")).select("event_id", "first.*")


def _numbered_copies(deliveries: DataFrame) -> DataFrame:
    """Deliveries with ``_copy``, 0 for one of the rows that are equal in everything, counted upwards for the others."""
    counted = deliveries.groupBy(*deliveries.columns).agg(F.count(F.lit(1)).alias("_times"))
    return counted.select(*deliveries.columns, F.explode(F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))).alias("_copy"))


def classify(deliveries: DataFrame, ledger: DataFrame | None = None, unique_positions: bool = False) -> DataFrame:
    """Disposition of every delivery against the ledger and the deliveries before it.

    ``accepted``: the id is new. ``redelivery``: same id, same content. ``conflict``: same id,
    other content. The content to compare with is always the first accepted one.
    ``reason`` is set when an id turns up in another stream partition than its first. A
    position that the input holds several times is accepted once. Callers whose positions can
    not repeat, or who refuse repeats themselves, say so and save a shuffle.
    """
    if not unique_positions:
        deliveries = _numbered_copies(deliveries)
    first = first_registrations(deliveries).select(
        "event_id",
        F.col("topic").alias("_t"),
        F.col("partition").alias("_p"),
        F.col("kafka_offset").alias("_o"),
        F.col("payload_sha256").alias("_sha"),
    )
    if ledger is not None:
        # Only the ledger rows of ids in this batch take part; a small batch side is
        # broadcast by size and the ledger is then filtered where it lies.
        known = ledger.join(first.select("event_id"), "event_id", "left_semi").select(
            "event_id",
            F.col("topic").alias("_lt"),
            F.col("partition").alias("_lp"),
            F.col("payload_sha256").alias("_lsha"),
        )
        first = first.join(known, "event_id", "left").select(
            "event_id",
            F.coalesce("_lsha", "_sha").alias("existing_payload_sha256"),
            F.coalesce("_lt", "_t").alias("_t"),
            F.coalesce("_lp", "_p").alias("_p"),
            F.when(F.col("_lsha").isNull(), F.col("_o")).alias("_o"),
        )
    else:
        first = first.withColumnRenamed("_sha", "existing_payload_sha256")
    same_stream = (F.col("topic") == F.col("_t")) & (F.col("partition") == F.col("_p"))
    same_content = F.col("payload_sha256") == F.col("existing_payload_sha256")
    is_first = same_stream & F.coalesce(F.col("kafka_offset") == F.col("_o"), F.lit(False)) & same_content
    if not unique_positions:
        is_first = is_first & (F.col("_copy") == 0)
    return (
        deliveries.join(first, "event_id")
        .withColumn(
            "disposition",
            F.when(is_first, "accepted").when(same_content, "redelivery").otherwise("conflict"),
        )
        .withColumn("reason", F.when(~same_stream, "event_id_spans_partitions"))
        .drop("_t", "_p", "_o", "_copy")
    )


def stop_points(classified: DataFrame) -> DataFrame:
    """Per stream partition: offset of its first conflict, if any, and where to resume.

    The conflict itself is recorded but not passed, so the next run meets it again.
    """
    stop = F.min(F.when(F.col("disposition") == "conflict", F.col("kafka_offset")))
    return classified.groupBy(*STREAM).agg(
        stop.alias("stop_offset"),
        F.coalesce(stop, F.max("kafka_offset") + 1).alias("next_offset"),
        F.min("kafka_offset").alias("low_offset"),
    )


def per_stream(rows: DataFrame) -> DataFrame:
    """One small row per stream partition, sent to every task so that the log is not moved by its few partitions.

    Their number is the topics', not the data's; a table of more than MAX_STREAMS rows fails the job.
    """
    gathered = rows.limit(MAX_STREAMS + 1).agg(F.collect_list(F.struct("*")).alias("all"))
    checked = F.when(F.size("all") <= MAX_STREAMS, F.col("all")).otherwise(
        F.raise_error(F.lit(f"more than {MAX_STREAMS} stream partitions"))
    )
    return F.broadcast(gathered.select(F.inline(checked)))


def cut_at_stops(classified: DataFrame, stops: DataFrame) -> DataFrame:
    """Deliveries up to and including each partition's stop point."""
    limit = per_stream(stops.select(*STREAM, "stop_offset"))
    kept = classified.join(limit, STREAM)
    return kept.filter("stop_offset IS NULL OR kafka_offset <= stop_offset").drop("stop_offset")


def accepted_events(attempts: DataFrame) -> DataFrame:
    """The ledger of unique events: accepted attempts, with where each arrived first."""
    return attempts.filter("disposition = 'accepted'").select(
        "event_id",
        "payload_sha256",
        "payload_json",
        "product_code",
        "occurred_at",
        "observed_date",
        "quantity",
        F.col("topic").alias("first_topic"),
        F.col("partition").alias("first_partition"),
        F.col("kafka_offset").alias("first_offset"),
    )


def conflicts(attempts: DataFrame) -> DataFrame:
    """Conflicting attempts with both contents."""
    return attempts.filter("disposition = 'conflict'").select(
        *[c for c in ("run_id",) if c in attempts.columns],
        *POSITION,
        "event_id",
        "existing_payload_sha256",
        F.col("payload_sha256").alias("incoming_payload_sha256"),
        F.col("payload_json").alias("incoming_payload_json"),
    )


def ledger_product_day(events: DataFrame) -> DataFrame:
    """Exact totals per UTC day and product over unique events, whenever they arrived."""
    return events.groupBy("observed_date", "product_code").agg(
        wide_sum(F.col("quantity")).alias("signed_quantity_sum"),
        F.count(F.lit(1)).alias("unique_event_count"),
    )


def position_gaps(deliveries: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Deliveries whose predecessor is neither in the log nor behind the checkpoint.

    Each offset looks for ``offset - 1`` by an anti-join on the position, which spreads
    evenly; a window over a stream partition would put the partition in one task.
    """
    seen = deliveries.select(*STREAM, (F.col("kafka_offset") + 1).alias("kafka_offset"))
    headless = deliveries.select(*POSITION).join(seen, POSITION_KEYS, "left_anti").distinct()
    bound = checkpoint.select(*STREAM, "durable_next_offset")
    expected = F.coalesce("durable_next_offset", F.lit(0))
    return (
        headless.join(bound, STREAM, "left")
        .filter(F.col("kafka_offset") > expected)
        .select(*POSITION, expected.alias("durable_next_offset"))
    )


def unproven_positions(deliveries: DataFrame, attempts: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Deliveries behind the checkpoint without an exact, processed prior delivery.

    Position, id and content must all be the same; anything else is a position
    mismatch, not a redelivery.
    """
    keys = [*POSITION, "event_id", "payload_sha256"]
    # A stream without a checkpoint has processed nothing: it expects offset zero.
    expected = F.coalesce("durable_next_offset", F.lit(0)).alias("durable_next_offset")
    behind = (
        deliveries.join(per_stream(checkpoint.select(*STREAM, "durable_next_offset")), STREAM, "left")
        .select(*keys, expected)
        .filter("kafka_offset < durable_next_offset")
    )
    processed = attempts.filter(F.col("disposition").isin(*PROCESSED)).select(*keys)
    by = [*POSITION_KEYS, "event_id", "payload_sha256"]
    return behind.join(processed, by, "left_anti").select(*keys, "durable_next_offset")


def ledger_totals(attempts: DataFrame) -> DataFrame:
    """Unique events and recorded conflicts."""
    return attempts.agg(
        F.count_if(F.col("disposition") == "accepted").alias("event_count"),
        F.count_if(F.col("disposition") == "conflict").alias("conflict_count"),
        F.count(F.lit(1)).alias("attempt_count"),
    )


def ledger_is_empty(attempts: DataFrame) -> DataFrame:
    """One row: rows of the ledger (attempts, and the events and conflicts among them) and whether that is none."""
    total = ledger_totals(attempts).select(
        (F.col("attempt_count") + F.col("event_count") + F.col("conflict_count")).alias("materialized_rows")
    )
    return total.withColumn("is_empty", F.col("materialized_rows") == 0)


def produced_positions(deliveries: DataFrame) -> DataFrame:
    """Deliveries in log order."""
    return deliveries.orderBy("topic", "partition", "kafka_offset")


def commit_audit(markers: DataFrame) -> DataFrame:
    """Committed next offset per batch and stream partition, for batches that advanced."""
    return markers.filter("status = 'committed'").select(
        "run_id", "batch_seq", *STREAM, F.col("next_offset").alias("committed_next_offset"), "committed_at"
    )


def checkpoint_of(markers: DataFrame) -> DataFrame:
    """Durable next offset per stream partition."""
    return markers.groupBy(*STREAM).agg(F.max("next_offset").alias("durable_next_offset"))


# Offsets per slice when the newest day so far is carried along a stream partition.
SLICE = 65_536


def late_days(events: DataFrame) -> DataFrame:
    """Events whose day is earlier than the newest day seen at a lower offset.

    A running maximum along a partition, in three steps: inside slices of the offset range,
    over the slices of a block of as many slices, and over the blocks. No task orders more than
    a slice, a block's slices, or the blocks, of which 2^32 offsets have one.
    """
    place = [F.col("first_topic"), F.col("first_partition")]
    slot = F.floor(F.col("first_offset") / SLICE).alias("_slot")
    sliced = events.select("*", slot)
    newest = sliced.groupBy(*place, "_slot").agg(F.max("observed_date").alias("_slice_day"))
    newest = newest.withColumn("_block", F.floor(F.col("_slot") / SLICE))
    blocks = newest.groupBy(*place, "_block").agg(F.max("_slice_day").alias("_block_day"))

    def earlier(of: str, *within: str) -> Window:
        return Window.partitionBy(*place, *within).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)

    passed = blocks.select(*place, "_block", F.max("_block_day").over(earlier("_block")).alias("_blocks_before"))
    before = (
        newest.withColumn("_slices_before", F.max("_slice_day").over(earlier("_slot", "_block")))
        .join(passed, ["first_topic", "first_partition", "_block"])
        .select(*place, "_slot", F.greatest("_slices_before", "_blocks_before").alias("_before"))
    )
    inside = (
        Window.partitionBy(*place, "_slot").orderBy("first_offset").rowsBetween(Window.unboundedPreceding, -1)
    )
    day_inside = F.max("observed_date").over(inside)
    return (
        sliced.withColumn("_inside", day_inside)
        .join(before, ["first_topic", "first_partition", "_slot"])
        .withColumn("newest_day_before", F.greatest("_inside", "_before"))
        .filter("observed_date < newest_day_before")
        .drop("_slot", "_inside", "_before")
    )
