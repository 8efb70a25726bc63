"""The index of accepted events: what a lookup finds, and how little it opens."""

import pytest
from pyspark.sql import functions as F

from tallyline.operators import ledger as led
from tallyline.streaming import event_index, ledger_stream
from tallyline.streaming.event_index import EventIndex, buckets_for


def events(spark, low, high):
    return spark.range(low, high).select(
        F.concat(F.lit("e-"), F.col("id")).alias("event_id"), F.lit("t").alias("topic"), (F.col("id") % 4).cast("int").alias("partition"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload_sha256"),
    )


def files_and_rows_read(df):
    """Files and rows that the scans of a plan without a shuffle took in."""
    df.collect()
    found = []

    def walk(node):
        if "FileSourceScan" in node.getClass().getName():
            metrics = node.metrics()
            found.append((metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()))
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(f for f, _ in found), sum(r for _, r in found)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(event_index, "FAN", 3)
    monkeypatch.setattr(event_index, "BUCKET_EVENTS", 500)


def test_files_read_stay_flat_while_the_ledger_grows_tenfold(spark, tmp_path, small):
    index, opened = EventIndex(spark, str(tmp_path / "index")), {}
    ids = spark.createDataFrame([("e-17",), ("e-500",), ("other",)], "event_id string")
    for batch in range(20):
        index.add(events(spark, batch * 1000, (batch + 1) * 1000), batch + 1, batch + 1)
        if batch in (1, 19):
            found = index.known(ids)
            opened[batch] = files_and_rows_read(found)
            assert {r.event_id for r in found.collect()} == {"e-17", "e-500"}
    live = index.live()
    assert len(live) <= 2 * 4 and sum(r.events for r in live) == 20_000
    files = sum(buckets_for(r.events) for r in live)
    assert files >= 32 and opened[19][0] <= 3 * len(live) < files
    assert opened[19][0] <= opened[1][0] + 9
    # Of the buckets that are opened, only row groups whose Bloom filter may hold an id are read.
    assert opened[19][1] <= 4 * 500
    absent = spark.createDataFrame([("nowhere",)], "event_id string")
    assert files_and_rows_read(index.known(absent))[1] <= 500


def test_many_ids_are_told_apart_by_bucket(spark, tmp_path, small, monkeypatch):
    monkeypatch.setattr(event_index, "NAMED_IDS", 2)
    index = EventIndex(spark, str(tmp_path / "index"))
    index.add(events(spark, 0, 8000), 1, 1)
    ids = events(spark, 100, 104)
    found = index.known(ids)
    files, rows = files_and_rows_read(found)
    assert files <= 4 < buckets_for(8000) == 16
    assert found.join(ids, "event_id").count() == 4
    assert index.known(ids.limit(0)).count() == 0 and EventIndex(spark, str(tmp_path / "none")).known(ids).count() == 0


def test_a_batch_that_was_not_made_visible_is_not_read(spark, tmp_path, small, monkeypatch):
    index = EventIndex(spark, str(tmp_path / "index"))
    index.add(events(spark, 0, 10), 1, 1)

    def lost(*args):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patch:
        patch.setattr(event_index, "append_rows", lost)
        with pytest.raises(RuntimeError):
            index.add(events(spark, 10, 20), 2, 2)
    assert index.covered_seq() == 1 and index.known(events(spark, 0, 20)).count() == 10
    index.add(events(spark, 10, 20), 2, 2)
    index.add(events(spark, 20, 20), 3, 3)
    assert index.known(events(spark, 0, 20)).count() == 20
    assert [(r.low_seq, r.high_seq, r.level) for r in index.live()] == [(1, 3, 2)]


def test_the_stream_looks_up_old_and_recent_batches(spark, tmp_path, small, monkeypatch):
    from test_ledger import Feed, event

    monkeypatch.setattr(ledger_stream, "FAN", 3)
    feed, ledger = Feed(spark, tmp_path), ledger_stream.Ledger(spark, str(tmp_path / "ledger"))
    for k in range(5):
        feed.send(event(f"e-{k}", "W", "2026-09-22T10:05:00Z", k), event("e-0", "W", "2026-09-22T10:05:00Z", 0))
    feed.consume(ledger, maxFilesPerTrigger="1")
    assert ledger.index.covered_seq() == 3
    found = ledger.attempts.groupBy("disposition").count().collect()
    assert {r.disposition: r["count"] for r in found} == {"accepted": 5, "redelivery": 5}
    assert led.ledger_totals(ledger.attempts).first().event_count == 5
