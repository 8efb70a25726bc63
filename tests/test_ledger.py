import json
import os

import pytest
from pyspark.sql import functions as F

from tallyline.operators import ledger as led
from tallyline.operators.events import batch_product_day, decode_events, dedup_product_day
from tallyline.operators.positions import stream_verdicts
from tallyline.operators.publish import recover_runs, run_state
from tallyline.sources import streams
from tallyline.streaming import ledger_stream as ls
from tallyline.streaming.daily import streaming_product_day


def event(event_id, code, at, quantity):
    return json.dumps({"event_id": event_id, "product_code": code, "occurred_at": at, "quantity": quantity})


E1 = event("e-1", "W", "2026-09-22T10:05:00Z", 3)
E2 = event("e-2", "W", "2026-09-22T09:40:00Z", 2)
E3 = event("e-3", "B", "2026-09-22T11:10:00Z", -1)
LATE = event("e-4", "W", "2026-09-21T23:55:00Z", 4)
OTHER = event("e-2", "W", "2026-09-22T09:40:00Z", 99)
LOG = [E1, E2, E1, E3, LATE, OTHER]
GOLDEN = [("2026-09-21", "W", 4, 1), ("2026-09-22", "B", -1, 1), ("2026-09-22", "W", 5, 2)]


class Feed:
    """A log as JSON files: each call to send adds one file, so one micro-batch may hold many."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.next, self.files = spark, folder, 0, 0
        (folder / "in").mkdir(parents=True)

    def send(self, *values, at=None, partition=0):
        start = self.next if at is None else at
        rows = [
            json.dumps({"topic": "t", "partition": partition, "offset": start + i, "key": None, "value": v})
            for i, v in enumerate(values)
        ]
        file = self.folder / "in" / f"{self.files:04d}.json"
        file.write_text("\n".join(rows))
        # A file stream takes files by modification time; files made within one tick would tie.
        os.utime(file, (1_700_000_000 + self.files, 1_700_000_000 + self.files))
        self.files += 1
        self.next = max(self.next, start + len(values))

    def consume(self, ledger, **options):
        source = streams.read_event_files(self.spark, str(self.folder / "in"), **options)
        return ls.consume_available(source, ledger, str(self.folder / "checkpoint"))


@pytest.fixture()
def ledger(spark, tmp_path):
    return ls.Ledger(spark, str(tmp_path / "ledger"))


@pytest.fixture()
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def days(ledger):
    rows = led.ledger_product_day(ledger.events).orderBy("observed_date", "product_code").collect()
    return [(str(r[0]), r[1], int(r[2]), r[3]) for r in rows]


def next_offset(ledger):
    return {r.partition: r.durable_next_offset for r in ledger.checkpoint.collect()}


def dispositions(ledger):
    return [r.disposition for r in ledger.attempts.orderBy("batch_seq", "partition", "kafka_offset").collect()]


def test_golden_log_restart_late_event_and_conflict_met_twice(feed, ledger):
    feed.send(E1, E2, E1, E3)
    feed.consume(ledger)
    assert next_offset(ledger) == {0: 4}
    assert dispositions(ledger) == ["accepted", "accepted", "redelivery", "accepted"]
    before = ledger.written.count()
    feed.consume(ledger)  # nothing new: the run succeeds, no attempt is added
    assert ledger.written.count() == before
    feed.send(LATE)
    feed.consume(ledger)
    assert (days(ledger), next_offset(ledger)) == (GOLDEN, {0: 5})
    feed.send(OTHER, event("e-9", "W", "2026-09-22T09:00:00Z", 7))
    for _ in range(2):
        with pytest.raises(Exception, match="different content"):
            feed.consume(ledger)
        assert (days(ledger), next_offset(ledger)) == (GOLDEN, {0: 5})
    conflicts = led.conflicts(ledger.attempts).collect()
    assert [(c.kafka_offset, c.event_id) for c in conflicts] == [(5, "e-2"), (5, "e-2")]
    assert conflicts[0].existing_payload_sha256 != conflicts[0].incoming_payload_sha256
    shot = ls.ledger_snapshot(ledger)
    assert [r.status for r in shot["runs"].collect()] == ["succeeded"] * 3 + ["failed"] * 2
    assert tuple(shot["totals"].first()) == (4, 2, 7)
    assert [r.committed_next_offset for r in shot["commits"].collect()] == [4, 5]


@pytest.mark.parametrize("when", ["before marker", "after marker"])
def test_crash_around_the_marker_does_not_count_twice(feed, ledger, monkeypatch, when):
    feed.send(E1, E2, E1, E3)
    real = ls.append_rows

    def dying(spark, rows, schema, path):
        if not path.endswith("markers"):
            return real(spark, rows, schema, path)
        if when == "after marker":
            real(spark, rows, schema, path)
        raise RuntimeError("executor lost")

    monkeypatch.setattr(ls, "append_rows", dying)
    with pytest.raises(Exception, match="lost"):
        feed.consume(ledger)
    monkeypatch.setattr(ls, "append_rows", real)
    assert ls.orphan_batches(ledger).count() == (1 if when == "before marker" else 0)
    feed.consume(ledger)
    feed.send(LATE)
    feed.consume(ledger)
    assert (days(ledger), next_offset(ledger)) == (GOLDEN, {0: 5})
    if when == "after marker":
        assert dispositions(ledger)[4:8] == ["redelivery"] * 4


def test_any_split_into_batches_gives_the_same_ledger(feed, ledger):
    for value in LOG[:5]:
        feed.send(value)
    feed.consume(ledger, maxFilesPerTrigger="1")
    assert ledger.markers.count() == 5
    assert (days(ledger), next_offset(ledger)) == (GOLDEN, {0: 5})
    assert dispositions(ledger) == ["accepted", "accepted", "redelivery", "accepted", "accepted"]


@pytest.mark.parametrize(
    "values, at, message",
    [
        ([E1, "{}"], None, "wrong_fields"),
        ([E1, '{"a":1} x'], None, "malformed_json"),
        ([E1], 2, "gap"),
        ([E1, E2], -1, "without an exact prior"),
    ],
)
def test_bad_batches_move_nothing(feed, ledger, values, at, message):
    feed.send(*values, at=at)
    with pytest.raises(Exception, match=message):
        feed.consume(ledger)
    assert ledger.attempts.count() == 0 and next_offset(ledger) == {}


def test_replay_needs_the_exact_prior_position(feed, ledger):
    feed.send(E1, E2)
    feed.consume(ledger)
    feed.send(E1, at=1)  # offset 1 was e-2
    with pytest.raises(Exception, match="without an exact prior"):
        feed.consume(ledger)
    assert next_offset(ledger) == {0: 2}


def test_an_event_id_stays_in_its_partition(feed, ledger):
    feed.send(E1)
    feed.consume(ledger)
    feed.send(E1, at=0, partition=1)
    with pytest.raises(Exception, match="spans_partitions"):
        feed.consume(ledger)


def test_interrupted_consumer_runs_are_closed(spark, ledger):
    ledger.log("gone", "running")
    runs = run_state(ledger.run_events)
    pubs = spark.createDataFrame([], "run_id string, publish_seq bigint")
    (row,) = recover_runs(runs, pubs, runs, F.current_timestamp(), "why", status="interrupted").collect()
    assert (row.run_id, row.status, row.recovery_reason) == ("gone", "interrupted", "why")


def test_two_independent_batches_agree(spark):
    decoded = decode_events(spark.createDataFrame([(v,) for v in LOG[:5]], "value string"))
    assert [(str(r[0]), r[1], int(r[2]), r[3]) for r in dedup_product_day(decoded).orderBy("observed_date", "product_code").collect()] == GOLDEN
    raw = decoded.dropDuplicates(["event_id"]).select(
        "event_id", "product_code", F.col("occurred_text").alias("occurred_at"), "quantity"
    )
    assert [(str(r[0]), r[1], int(r[2]), r[3]) for r in batch_product_day(raw).orderBy("observed_date", "product_code").collect()] == GOLDEN


def test_wide_ledger_sum(spark):
    top = decode_events(
        spark.createDataFrame([(event(f"m{i}", "W", "2026-09-22T10:00:00Z", 2**63 - 1),) for i in (1, 2)], "value string")
    )
    assert int(led.ledger_product_day(top).first().signed_quantity_sum) == 2 * (2**63 - 1)


def test_one_hot_event_id_is_one_accept(spark):
    log = spark.range(5000).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("kafka_offset"),
        F.lit("hot").alias("event_id"), F.lit("x").alias("payload_sha256"),
    )
    got = {r.disposition: r["count"] for r in led.classify(log).groupBy("disposition").count().collect()}
    assert got == {"accepted": 1, "redelivery": 4999}


def test_late_days_across_slices(spark, monkeypatch):
    monkeypatch.setattr(led, "SLICE", 2)
    days_seen = ["2026-01-02", "2026-01-01", "2026-01-02", "2026-01-03", "2026-01-03", "2026-01-02", "2026-01-04"]
    events = spark.createDataFrame(
        [("t", 0, i, d) for i, d in enumerate(days_seen)],
        "first_topic string, first_partition int, first_offset bigint, observed_date string",
    )
    assert sorted(r.first_offset for r in led.late_days(events).collect()) == [1, 5]


POSITIONS = [
    # cluster, group, partition, broker, low, high, checkpoint next, ledger rows, max ahead, reason, start
    ("c", "g", 0, 1, 0, 1, None, 0, 1, "empty_ledger_but_group_advanced", None),
    ("c", "g", 0, -1001, 0, 100, None, 0, 1, None, 0),
    ("c", "g", 0, -1001, 3, 100, None, 0, 1, "log_does_not_start_at_zero", None),
    ("c", "g", 0, -1001, 0, 100, None, 5, 1, "ledger_without_checkpoint", None),
    ("c", "g", 0, -1001, 0, 1, 1, 5, 1, None, 1),
    ("c", "g", 0, -1001, 0, 9, 2, 5, 1, "uncommitted_group_too_far_behind", None),
    ("c", "g", 0, 2, 0, 2, 1, 5, 1, "group_ahead_of_ledger", None),
    ("d", "g", 0, 0, 0, 1, 1, 5, 1, "different_stream", None),
    ("c", "g", 0, 0, 2, 2, 1, 5, 1, "log_begins_after_checkpoint", None),
    ("c", "g", 0, 3, 0, 4, 5, 5, 1, "log_ends_before_checkpoint", None),
    ("c", "g", 0, 3, 0, 9, 5, 5, 1, "ledger_too_far_ahead", None),
    ("c", "g", 0, 3, 0, 9, 5, 5, 10, None, 5),
    ("", "g", 0, 3, 0, 9, 5, 5, 1, "missing_cluster_id", None),
    ("c", "g", 0, 3, -1, 9, 5, 5, 1, "invalid_watermarks", None),
    ("c", "g", 1, 3, 0, 9, 5, 5, 1, "unsupported_partition", None),
]


def test_position_verdicts(spark):
    for c, g, p, broker, low, high, nxt, rows, ahead, reason, start in POSITIONS:
        positions = spark.sql(
            f"SELECT '{c}' cluster_id, '{g}' group_id, 't' topic, {p} partition, {broker}L broker_committed, {low}L low, {high}L high"
        )
        checkpoint = spark.sql(
            f"SELECT 'c' cluster_id, 'g' group_id, 't' topic, {p} partition, {nxt or 0}L durable_next_offset"
        ).limit(0 if nxt is None else 1)
        got = stream_verdicts(positions, checkpoint, rows, ahead, single_partition=True).first()
        assert (got.reason, got.start_offset) == (reason, start)


def at(spark, broker, low, high, cluster="c", group="g"):
    return spark.sql(f"SELECT '{cluster}' cluster_id, '{group}' group_id, 't' topic, 0 partition, {broker}L broker_committed, {low}L low, {high}L high")


def test_consuming_is_bound_to_one_stream(feed, ledger):
    spark = ledger.spark
    topic = "t"
    feed.send(E1, E2)
    source = lambda: streams.read_event_files(spark, str(feed.folder / "in")).withColumn("topic", F.lit(topic))
    run = lambda positions: ls.consume_available(source(), ledger, str(feed.folder / "bound"), positions)
    for bad, reason in ((at(spark, 1, 0, 2), "empty_ledger_but_group_advanced"), (at(spark, -1001, 1, 2), "log_does_not_start_at_zero")):
        with pytest.raises(Exception, match=reason):
            run(bad)
    run(at(spark, -1001, 0, 2))
    assert tuple(ledger.binding.first())[2:] == (2, "c", "g")
    feed.send(E3)
    for bad, reason in (
        (at(spark, 2, 0, 3, cluster="d"), "different_stream"), (at(spark, 2, 0, 3, group="h"), "different_stream"),
        (at(spark, 3, 0, 3), "group_ahead_of_ledger"), (at(spark, 3, 3, 3), "log_begins_after_checkpoint"), (at(spark, 1, 0, 1), "log_ends_before_checkpoint"),
    ):
        with pytest.raises(Exception, match=reason):
            run(bad)
    assert next_offset(ledger) == {0: 2}
    run(at(spark, 2, 0, 3))
    assert next_offset(ledger) == {0: 3}


def test_the_log_twice_accepts_each_id_once(spark):
    rows = [("t", 0, i, f"e{i % 3}", "x" if i < 5 else "y") for i in range(6)]
    log = spark.createDataFrame(rows, "topic string, partition int, kafka_offset bigint, event_id string, payload_sha256 string")
    got = led.classify(log.unionByName(log)).groupBy("disposition").count().collect()
    assert {r.disposition: r["count"] for r in got} == {"accepted": 3, "redelivery": 3 + 2 * 2, "conflict": 2}


def test_stops_do_not_move_the_log_by_stream(spark):
    rows = [("t", i % 2, i, f"e{i % 3}", "x") for i in range(6)]
    log = spark.createDataFrame(rows, "topic string, partition int, kafka_offset bigint, event_id string, payload_sha256 string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = led.classify(log, unique_positions=True)
        plan = led.cut_at_stops(found, led.stop_points(found))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.split("\n") if "Join" in line and "topic" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


def test_kafka_options_never_commit_or_skip():
    source = streams.kafka_source_options("h:1", "t")
    assert source["startingOffsets"] == "earliest" and source["failOnDataLoss"] == "true"
    assert not any("auto" in k for k in source) and int(source["maxOffsetsPerTrigger"]) > 0
    sink = streams.kafka_sink_options("h:1", "t")
    assert sink["kafka.acks"] == "all" and sink["kafka.enable.idempotence"] == "true"


def test_produced_payloads_are_keyed_by_event(spark):
    decoded = decode_events(spark.createDataFrame([(E1,)], "value string"))
    row = streams.keyed_payloads(decoded).first()
    assert row.key == "e-1" and json.loads(row.value) == json.loads(E1)


def test_running_totals_follow_late_events(spark, feed):
    feed.send(E1, E2, E3)
    feed.send(LATE)
    source = streams.read_event_files(spark, str(feed.folder / "in"), maxFilesPerTrigger="1")
    totals = streaming_product_day(decode_events(source).filter("reason IS NULL"))
    query = totals.writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("totals").orderBy("observed_date", "product_code").collect()
    assert [(str(r[0]), r[1], int(r[2]), r[3]) for r in rows] == GOLDEN
