"""Bitmaps, digest trees, intervals, streaming state and versioned totals against the plain operators."""

import random

import pytest
from pyspark.sql import Row, functions as F
from test_ledger import E1, E2, E3, GOLDEN, LATE, Feed, event

from tallyline.operators import bitmaps, intervals, scope
from tallyline.operators import ledger as led
from tallyline.operators.contracts import count_mismatch
from tallyline.operators.digest_tree import differing_leaves, digest_tree, reconcile_by_digest
from tallyline.operators.events import decode_events
from tallyline.operators.reconcile import reconcile
from tallyline.plans import stored_queries
from tallyline.sources import streams
from tallyline.streaming.daily import consume_daily, daily_totals, daily_versions
from tallyline.streaming.event_index import FAN, EventIndex
from tallyline.streaming.stateful import FirstDeliveries, dispositions_so_far, start_dispositions, stops_so_far


def rows(df):
    return sorted(map(str, df.collect()))


# --- bitmaps ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def members(spark):
    rng = random.Random(1)
    made = [(run, f"f{k % 2}", f"s{k % 3}", k) for k in [*range(2, 200), 32_768, 32_769, 65_536, 65_537, 1_048_576, 5_000_000_000] for run in ("a", "b") if rng.random() < 0.7]
    made += [("a", "f0", "only-a", 7), ("b", "f9", "only-b", 9), ("a", "f0", "s0", 0), ("b", "f0", "s0", -1), ("a", "f0", "s0", -40_000)]
    return spark.createDataFrame(made, "run_id string, source_file_id string, sheet_name string, source_row_number long").repartition(3)


def test_bitmaps_hold_what_the_rows_hold(members):
    stored = bitmaps.membership_bitmaps(members)
    assert rows(bitmaps.members_of(stored)) == rows(members)
    assert stored.count() < members.count() / 5
    assert rows(scope.scope_ids(bitmaps.members_of(stored))) == rows(scope.scope_ids(members))
    expected = members.groupBy("run_id").agg((F.count("*") + F.when(F.col("run_id") == "a", 1).otherwise(0)).alias("expected_count"))
    assert rows(bitmaps.count_mismatch(stored, expected)) == rows(count_mismatch(members, expected))
    odd = F.col("source_row_number") % 2 == 0
    parts = bitmaps.membership_bitmaps(members.filter(odd)).unionByName(bitmaps.membership_bitmaps(members.filter(~odd)))
    assert rows(bitmaps.members_of(bitmaps.combined_bitmaps(parts))) == rows(members)


def test_only_differing_slices_are_opened(members):
    stored = bitmaps.membership_bitmaps(members)
    assert rows(bitmaps.row_diff(stored, "a", "b")) == rows(scope.row_diff(members, "a", "b"))
    twin = members.filter("run_id = 'a'").unionByName(members.filter("run_id = 'a'").withColumn("run_id", F.lit("c")))
    assert bitmaps.row_diff(bitmaps.membership_bitmaps(twin), "a", "c").count() == 0
    twice = members.unionByName(members).unionByName(members.limit(1).withColumn("source_row_number", F.lit(None).cast("long")))
    assert rows(bitmaps.members_of(bitmaps.membership_bitmaps(twice))) == rows(members)
    assert bitmaps.row_diff(stored.limit(0), "a", "b").count() == 0


# --- digest trees ----------------------------------------------------------------


def test_trees_open_differing_leaves_only(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 700).alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    right = left.repartition(3, "v")
    columns = ["k", "v"]
    assert differing_leaves(digest_tree(left, columns), digest_tree(right, columns)).count() == 0
    assert reconcile_by_digest(left, right, columns).count() == 0
    changed = right.filter("k IS NULL OR k <> 3").unionByName(right.filter("k = 3 AND v <> '1'")).unionByName(spark.createDataFrame([(9, "new"), (None, "new")], left.schema))
    assert rows(reconcile_by_digest(left, changed, columns)) == rows(reconcile(left, changed, columns))
    assert 1 <= differing_leaves(digest_tree(left, columns), digest_tree(changed, columns)).count() <= 9
    assert rows(reconcile_by_digest(left, left.limit(0), columns, 1)) == rows(reconcile(left, left.limit(0), columns))
    tree = digest_tree(left, columns)
    assert tree.filter("level = 0").first().rows == 5000 and tree.groupBy("level").agg(F.sum("rows").alias("n")).filter("n <> 5000").count() == 0


# --- intervals -------------------------------------------------------------------


def test_intervals_are_runs_over_slices_and_batches(spark):
    held = [*range(0, 10), *range(12, 15), 65_535, 65_536, 65_537, *range(131_071, 131_073), 200_000]
    positions = spark.createDataFrame([("t", p, o) for p in (0, 1) for o in held if p == 0 or o > 5] * 2, "topic string, partition int, kafka_offset long")
    found = intervals.intervals_of(positions.repartition(4))
    want = [(0, 9), (12, 14), (65_535, 65_537), (131_071, 131_072), (200_000, 200_000)]
    got = sorted((r.partition, r.first_offset, r.last_offset) for r in found.collect())
    assert got == [(0, a, b) for a, b in want] + [(1, 6 if a == 0 else a, b) for a, b in want]
    parts = [intervals.intervals_of(positions.filter(F.col("kafka_offset") % 3 == k)) for k in range(3)]
    assert rows(intervals.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))) == rows(found)
    checkpoint = spark.createDataFrame([("t", 0, 12)], "topic string, partition int, durable_next_offset long")
    assert rows(intervals.interval_gaps(found, checkpoint)) == rows(led.position_gaps(positions, checkpoint))


def test_replays_outside_the_intervals_are_unproven(spark):
    log = [("t", 0, k, f"e{k}", f"sha{k}") for k in range(20)] + [("u", 1, 3, "x", "y")]
    schema = "topic string, partition int, kafka_offset long, event_id string, payload_sha256 string"
    deliveries = spark.createDataFrame([(*r[:4], "other") if r[2] == 4 else r for r in log], schema)
    attempts = spark.createDataFrame([r for r in log if r[2] not in (7, 8)], schema).withColumn("disposition", F.lit("accepted"))
    checkpoint = spark.createDataFrame([("t", 0, 15)], "topic string, partition int, durable_next_offset long")
    found = intervals.unproven_positions(deliveries, attempts, intervals.intervals_of(attempts), checkpoint)
    assert sorted(r.kafka_offset for r in found.collect()) == [4, 7, 8]
    assert rows(found) == rows(led.unproven_positions(deliveries, attempts, checkpoint))


# --- streaming -------------------------------------------------------------------


@pytest.fixture()
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def decoded(feed):
    source = streams.read_event_files(feed.spark, str(feed.folder / "in"), maxFilesPerTrigger="1")
    return decode_events(source).filter("reason IS NULL")


def test_state_outlives_a_restart_and_classifies_as_the_whole_log_does(spark, feed, tmp_path):
    folder = str(tmp_path / "state")
    other = event("e-2", "W", "2026-09-22T09:40:00Z", 99)
    feed.send(E1, E2, E1)
    feed.send(E3, E1)
    start_dispositions(decoded(feed), folder).awaitTermination()
    feed.send(LATE, other, E2, other)
    feed.send(E1, partition=1, at=0)
    start_dispositions(decoded(feed), folder).awaitTermination()
    whole = decode_events(streams.as_deliveries(spark.read.json(str(feed.folder / "in")).selectExpr("topic", "cast(partition AS int) AS partition", "offset", "value")))
    shown = ["topic", "partition", "kafka_offset", "event_id", "payload_sha256", "existing_payload_sha256", "disposition", "reason"]
    want = led.classify(whole.filter("reason IS NULL").drop("reason"), unique_positions=True).select(*shown)
    found = dispositions_so_far(spark, folder)
    assert rows(found.select(*shown)) == rows(want)
    assert [tuple(r) for r in stops_so_far(spark, folder).collect()] == [("t", 0, 6)]


def test_a_late_event_after_a_restart_changes_its_own_day(spark, feed, tmp_path):
    folder = str(tmp_path / "daily")
    feed.send(E1, E2)
    feed.send(E3)
    consume_daily(decoded(feed), folder).awaitTermination()
    before = daily_versions(spark, folder).count()
    feed.send(LATE)
    consume_daily(decoded(feed), folder).awaitTermination()
    found = daily_totals(spark, folder).orderBy("observed_date", "product_code").collect()
    assert [(str(r[0]), r[1], int(r[2]), r[3]) for r in found] == GOLDEN
    new = daily_versions(spark, folder).orderBy(F.desc("version")).limit(1).collect()
    assert daily_versions(spark, folder).count() == before + 1 and str(new[0].observed_date) == "2026-09-21"


# --- growth ----------------------------------------------------------------------


def test_gaps_and_positions_are_told_without_comparing_ranges(spark):
    """Positions and intervals of a slice are ordered together; an edge run goes on over slices, any other stays in its own."""
    held = [o for o in range(200_000) if o % 3 or 65_500 < o < 131_100]
    positions = spark.createDataFrame([("t", 0, o, f"e{o}", "s") for o in held], "topic string, partition int, kafka_offset long, event_id string, payload_sha256 string")
    found = intervals.intervals_of(positions)
    assert found.agg(F.sum(F.expr("last_offset - first_offset + 1"))).first()[0] == len(held)
    assert [tuple(r)[2:] for r in found.filter("last_offset - first_offset > 2").collect()] == [(65_500, 131_099)]
    deliveries = spark.range(200_000).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("kafka_offset"), F.concat(F.lit("e"), "id").alias("event_id"), F.lit("s").alias("payload_sha256"))
    checkpoint = spark.createDataFrame([("t", 0, 200_000)], "topic string, partition int, durable_next_offset long")
    unproven = intervals.unproven_positions(deliveries, positions.withColumn("disposition", F.lit("accepted")), found, checkpoint)
    assert unproven.count() == 200_000 - len(held)
    joins = [line for line in unproven._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("<=" in line for line in joins)


def test_state_is_asked_for_once_per_bucket():
    class Held(list):
        calls = 0

        def get(self):
            self.calls += 1
            return iter(list(self))

        def appendList(self, new):
            self.calls += 1
            self.extend(new)

    held = Held()
    processor = FirstDeliveries()
    processor.init(type("Handle", (), {"getListState": lambda self, *_: held})())
    feed = [Row(f"e{k % 500}", "t", 0, k, f"sha{k % 500 if k != 700 else 'other'}", 1) for k in range(1000)]
    found = list(processor.handleInputRows((1,), iter(feed), None))
    assert [sum(r[6] == d for r in found) for d in ("accepted", "redelivery", "conflict")] == [500, 499, 1]
    again = list(processor.handleInputRows((1,), iter([Row("e3", "t", 1, 0, "sha3", 1)]), None))
    assert [tuple(r)[5:] for r in again] == [("sha3", "redelivery", "event_id_spans_partitions")]
    assert held.calls == 3 and len(held) == 500


def test_the_index_is_filled_from_a_log_that_was_classified_once(spark, monkeypatch):
    filled = []
    monkeypatch.setattr(EventIndex, "add", lambda self, events, *_: filled.append(sorted(events.inputFiles())))
    stored_queries.dispositions_by_index(spark, "/root/testdata/sf0.001")
    assert len(filled) == FAN + 1 and all("/known-" in f for own in filled for f in own)
