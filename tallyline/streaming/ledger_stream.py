"""Consume a delivery log into the event ledger, exactly once in effect.

A micro-batch is read and decoded once, written as classified attempts in a partition of its
own, and then judged from what was written. Only the marker, one small file written last, makes it
visible; without one its rows are never read. A start of the query is a run; a batch that
is replayed after a crash is written under the new run and finds its events in the ledger,
so they read as redeliveries and totals stay.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.errors import ContractViolation, EventConflict, PositionMismatch
from tallyline.operators import ledger as led
from tallyline.operators.contracts import require_empty
from tallyline.operators.events import decode_events
from tallyline.operators.landing import align_schema
from tallyline.operators.positions import stream_verdicts
from tallyline.operators.publish import run_state
from tallyline.schemas import ATTEMPTS, MARKERS, RUN_EVENTS
from tallyline.sources.storage import append_rows, claim_next, read_or_empty, remove_folder
from tallyline.sources.streams import BATCH_OFFSETS
from tallyline.streaming.event_index import FAN, EventIndex

@dataclass(frozen=True)
class Ledger:
    """Tables of an event ledger under one root folder."""

    spark: SparkSession
    root: str

    @property
    def markers(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/markers", MARKERS)

    @property
    def written(self) -> DataFrame:
        """Every attempt in storage, also of batches that were never marked."""
        return read_or_empty(self.spark, f"{self.root}/attempts", ATTEMPTS)

    @property
    def attempts(self) -> DataFrame:
        """Attempts that count: of marked batches, up to each partition's stop."""
        marks = self.markers.select("run_id", "batch_id", "topic", "partition", "stop_offset", "batch_seq")
        return (
            self.written.join(marks, ["run_id", "batch_id", "topic", "partition"])
            .filter("stop_offset IS NULL OR kafka_offset <= stop_offset")
            .drop("stop_offset")
        )

    @property
    def events(self) -> DataFrame:
        return led.accepted_events(self.attempts)

    @property
    def index(self) -> EventIndex:
        return EventIndex(self.spark, f"{self.root}/event_index")

    def _accepted_of(self, marks: list) -> DataFrame:
        """Accepted attempts of marked batches that the caller names, read from their own folders."""
        runs, batches = sorted({m.run_id for m in marks}), sorted({m.batch_id for m in marks})
        own = self.written.filter(F.col("run_id").isin(runs) & F.col("batch_id").isin(batches) & (F.col("disposition") == "accepted"))
        stops = self.spark.createDataFrame(marks, MARKERS).select("run_id", "batch_id", "topic", "partition", "stop_offset")
        return (
            own.join(stops, ["run_id", "batch_id", "topic", "partition"])
            .filter("stop_offset IS NULL OR kafka_offset <= stop_offset")
            .select("event_id", "topic", "partition", "payload_sha256")
        )

    def known_events(self, ids: DataFrame) -> DataFrame:
        """Accepted events that may be among ``ids``: of the index, and of the batches it does not hold yet.

        Batches enter the index FAN at a time; until then they are few and read by name.
        """
        marks = self.markers.filter(F.col("batch_seq") > self.index.covered_seq()).orderBy("batch_seq").collect()
        seqs = sorted({m.batch_seq for m in marks})
        while len(seqs) >= FAN:
            own, seqs = seqs[:FAN], seqs[FAN:]
            self.index.add(self._accepted_of([m for m in marks if m.batch_seq in own]), own[0], own[-1])
        known = self.index.known(ids)
        return known.unionByName(self._accepted_of([m for m in marks if m.batch_seq in seqs])) if seqs else known

    @property
    def run_events(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/run_events", RUN_EVENTS)

    @property
    def checkpoint(self) -> DataFrame:
        return led.checkpoint_of(self.markers)

    @property
    def binding(self) -> DataFrame:
        """The checkpoint with the cluster and group each stream partition was read from."""
        return self.markers.groupBy(*led.STREAM).agg(
            F.max("next_offset").alias("durable_next_offset"), F.max("cluster_id").alias("cluster_id"), F.max("group_id").alias("group_id")
        )

    def refused_folder(self) -> str:
        """A fresh folder for rows that stop a batch."""
        return f"{self.root}/refused/{uuid.uuid4().hex}"

    def decoded_folder(self) -> str:
        """A fresh folder for a decoded batch, until its attempts are written."""
        return f"{self.root}/decoded/{uuid.uuid4().hex}"

    def log(self, run_id: str, status: str, error: str | None = None) -> None:
        newest = self.run_events.agg(F.max("event_seq")).first()[0] or 0
        row = {name: None for name in RUN_EVENTS.fieldNames()}
        row.update(
            run_id=run_id, event_seq=claim_next(self.spark, f"{self.root}/claims/events", newest), status=status, at=dt.datetime.now(dt.timezone.utc),
            input_path=self.root, error_message=error,
        )
        append_rows(self.spark, [tuple(row.values())], RUN_EVENTS, f"{self.root}/run_events")


def ledger_snapshot(ledger: Ledger) -> dict[str, DataFrame]:
    """Everything a reader asks of the ledger, as DataFrames."""
    attempts = ledger.attempts
    return {
        "totals": led.ledger_totals(attempts),
        "aggregates": led.ledger_product_day(ledger.events).orderBy("observed_date", "product_code"),
        "runs": run_state(ledger.run_events).select("run_seq", "run_id", "status", "error_message", "recovered_at")
        .orderBy("run_seq"),
        "attempts": attempts.select(
            "batch_seq", "run_id", *led.POSITION, "event_id", "payload_sha256", "disposition"
        ).orderBy("batch_seq", *led.POSITION),
        "conflicts": led.conflicts(attempts),
        "checkpoint": ledger.checkpoint,
        "commits": led.commit_audit(ledger.markers).orderBy("batch_seq", *led.STREAM),
    }


def orphan_batches(ledger: Ledger) -> DataFrame:
    """Batches that were written but never marked."""
    batch = ["run_id", "batch_id"]
    return ledger.written.select(*batch).distinct().join(ledger.markers.select(*batch), batch, "left_anti")


def _summary(written: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """One row per stream partition of a batch: what decides whether it may count.

    Counting distinct offsets spreads over offsets first, so a hot partition is no hot task.
    """
    expected = F.coalesce("durable_next_offset", F.lit(0))
    stop = F.min(F.when(F.col("disposition") == "conflict", F.col("kafka_offset")))
    joined = written.join(led.per_stream(checkpoint), led.STREAM, "left").withColumn("_next", expected)
    return joined.groupBy(*led.STREAM, "_next").agg(
        F.count_if(F.col("reason").isNotNull()).alias("refused"),
        F.count_if(F.col("kafka_offset") < F.col("_next")).alias("replayed"),
        F.count(F.lit(1)).alias("deliveries"),
        F.countDistinct("kafka_offset").alias("offsets"),
        F.count_if(F.col("kafka_offset") >= F.col("_next")).alias("fresh"),
        F.max("kafka_offset").alias("high"),
        stop.alias("stop_offset"),
    )


def _refuse_positions(rows: list, written: DataFrame, ledger: Ledger) -> None:
    """Stop on gaps, repeated positions, and replays that the ledger can not prove."""
    for row in rows:
        place = f"{row['topic']}[{row['partition']}]"
        if row["offsets"] != row["deliveries"]:
            raise PositionMismatch(f"{place} delivered a position twice in one batch")
        if row["fresh"] and row["high"] - row["_next"] + 1 != row["fresh"]:
            raise PositionMismatch(f"{place} has a gap behind offset {row['_next']}")
    if any(row["replayed"] for row in rows):
        unproven = led.unproven_positions(written, ledger.attempts, ledger.checkpoint)
        try:
            require_empty(unproven.select(*led.POSITION), "deliveries behind the checkpoint without an exact prior one", ledger.refused_folder())
        except ContractViolation as exc:
            raise PositionMismatch(str(exc)) from exc


def _kept_decoded(ledger: Ledger, batch: DataFrame, folder: str) -> DataFrame:
    """The batch decoded and kept in ``folder``: several steps below read it, and the source is read and decoded once."""
    decoded = decode_events(batch)
    held = decoded.select(*[c for c in decoded.columns if c in ATTEMPTS.fieldNames()])
    held.write.parquet(folder)
    return ledger.spark.read.schema(held.schema).parquet(folder)


def _write_attempts(ledger: Ledger, run_id: str, deliveries: DataFrame, batch_id: int) -> None:
    """Classify decoded deliveries against the visible ledger and append them as attempts."""
    decoded = deliveries.withColumnRenamed("reason", "_invalid")
    known = ledger.known_events(decoded.filter("_invalid IS NULL").select("event_id"))
    # An invalid payload has no event id to be classified by; it keeps its row and reason.
    # Repeated positions are refused afterwards, from what was written.
    classified = led.classify(decoded.filter("_invalid IS NULL"), known, unique_positions=True)
    invalid = decoded.filter("_invalid IS NOT NULL").withColumn("reason", F.col("_invalid"))
    rows = classified.unionByName(invalid, allowMissingColumns=True).select(
        "*",
        F.lit(run_id).alias("run_id"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.current_timestamp().alias("observed_at"),
    )
    # Partitioned by disposition as well: lookups read accepted rows only.
    align_schema(rows, ATTEMPTS).fillna("refused", ["disposition"]).write.mode("append").partitionBy(
        "run_id", "batch_id", "disposition"
    ).parquet(f"{ledger.root}/attempts")


def write_ledger_batch(
    ledger: Ledger, run_id: str, batch: DataFrame, batch_id: int, origins: dict[tuple[str, int], tuple[str, str]] | None = None
) -> None:
    """Classify one micro-batch against the visible ledger, write it, judge it, mark it.

    ``origins`` tells the cluster and group of each stream partition, for its marker.
    """
    folder = ledger.decoded_folder()
    try:
        _write_attempts(ledger, run_id, _kept_decoded(ledger, batch, folder), batch_id)
    finally:
        remove_folder(ledger.spark, folder)

    written = ledger.written.filter((F.col("run_id") == run_id) & (F.col("batch_id") == batch_id))
    # One row per stream partition: their number is the topic's, not the data's.
    summary = _summary(written, ledger.checkpoint).collect()
    if not summary:
        return
    if any(row["refused"] for row in summary):
        require_empty(written.filter("reason IS NOT NULL").select(*led.POSITION, "reason"), "deliveries refused", ledger.refused_folder())
    _refuse_positions(summary, written, ledger)

    seq = (ledger.markers.agg(F.max("batch_seq")).first()[0] or 0) + 1
    now = dt.datetime.now(dt.timezone.utc)
    marks = []
    for row in summary:
        stop = row["stop_offset"]
        reached = row["high"] + 1 if stop is None else stop
        marks.append(
            (run_id, batch_id, seq, row["topic"], row["partition"], stop, max(row["_next"], reached),
             "committed" if stop is None else "conflict", now, *(origins or {}).get((row["topic"], row["partition"]), (None, None)))
        )
    append_rows(ledger.spark, marks, MARKERS, f"{ledger.root}/markers")
    stopped = [row for row in summary if row["stop_offset"] is not None]
    if stopped:
        places = ", ".join(f"{r['topic']}[{r['partition']}] offset {r['stop_offset']}" for r in stopped)
        raise EventConflict(f"an event id has different content at {places}")


def trusted_origins(ledger: Ledger, positions: DataFrame, max_ahead: int) -> dict[tuple[str, int], tuple[str, str]]:
    """Cluster and group per stream partition, once every partition's position may be trusted; else refuse.

    One row per stream partition reaches the driver.
    """
    held = 0 if ledger.written.isEmpty() else 1
    verdicts = stream_verdicts(positions, ledger.binding, held, max_ahead)
    rows = verdicts.limit(led.MAX_STREAMS + 1).collect()
    refused = sorted(f"{r['topic']}[{r['partition']}] {r['reason']}" for r in rows if r["reason"])
    if refused or len(rows) > led.MAX_STREAMS:
        raise PositionMismatch("stream positions are not to be trusted: " + "; ".join(refused))
    return {(r["topic"], r["partition"]): (r["cluster_id"], r["group_id"]) for r in rows}


def start_ledger_stream(
    source: DataFrame, ledger: Ledger, checkpoint_dir: str, run_id: str, origins: dict[tuple[str, int], tuple[str, str]] | None = None
) -> StreamingQuery:
    """Consume everything available at the start, then end."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_ledger_batch(ledger, run_id, batch, batch_id, origins)

    return (
        source.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def consume_available(
    source: DataFrame, ledger: Ledger, checkpoint_dir: str, positions: DataFrame | None = None, max_ahead: int = BATCH_OFFSETS
) -> str:
    """One consumer run over what is available; its state is recorded either way.

    ``positions`` are the broker's: cluster_id, group_id, topic, partition, broker_committed,
    low and high. With them the run starts only if every partition's verdict lets it, and the
    ledger is bound to that cluster and group. ``max_ahead`` is how many offsets a batch may hold.
    """
    run_id = str(uuid.uuid4())
    ledger.log(run_id, "running")
    try:
        origins = None if positions is None else trusted_origins(ledger, positions, max_ahead)
        start_ledger_stream(source, ledger, checkpoint_dir, run_id, origins).awaitTermination()
    except Exception as exc:
        ledger.log(run_id, "failed", str(exc))
        raise
    ledger.log(run_id, "succeeded")
    return run_id
