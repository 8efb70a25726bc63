"""The log in files as a stream: where it starts, what it remembers, and what it refuses."""

import json
import shutil

import pyarrow as pa
import pytest
from test_ledger import E1, E2, E3, GOLDEN, LATE, days

from tallyline.sources.replay import LogReader, Segment, log_table, read_log, write_log
from tallyline.streaming import ledger_stream as ls


def send(spark, path, *values, at, partition=0):
    rows = [("t", partition, at + k, v) for k, v in enumerate(values)]
    write_log(spark.createDataFrame(rows, "topic string, partition int, kafka_offset long, value string"), path, 1)


def consume(spark, tmp_path, ledger, **options):
    return ls.consume_available(read_log(spark, str(tmp_path / "log"), **options), ledger, str(tmp_path / "checkpoint"))


def test_progress_over_restarts_and_new_partitions(spark, tmp_path):
    path, ledger = str(tmp_path / "log"), ls.Ledger(spark, str(tmp_path / "ledger"))
    send(spark, path, E1, E2, E1, at=0)
    consume(spark, tmp_path, ledger)
    send(spark, path, E2, at=3)
    send(spark, path, E3, LATE, E3, at=0, partition=1)
    consume(spark, tmp_path, ledger)
    assert days(ledger) == GOLDEN
    assert {(r.partition, r.durable_next_offset) for r in ledger.checkpoint.collect()} == {(0, 4), (1, 3)}
    before = ledger.written.count()
    consume(spark, tmp_path, ledger)
    assert ledger.written.count() == before == log_table(spark, path).count() == 7


def test_lost_offsets_stop_the_stream(spark, tmp_path):
    path, ledger = tmp_path / "log", ls.Ledger(spark, str(tmp_path / "ledger"))
    send(spark, str(path), E1, E2, at=0)
    consume(spark, tmp_path, ledger)
    send(spark, str(path), E3, E1, LATE, E1, at=2)
    for gone in ("segment=0", "segment=1"):
        shutil.move(path / "topic=t" / "partition=0" / gone, tmp_path / f"gone-{gone}")
    with pytest.raises(Exception, match="lost offsets"):
        consume(spark, tmp_path, ledger)
    assert ledger.checkpoint.first().durable_next_offset == 2
    shutil.move(tmp_path / "gone-segment=1", path / "topic=t" / "partition=0" / "segment=1")
    consume(spark, tmp_path, ledger)
    assert ledger.checkpoint.first().durable_next_offset == 6


def test_a_hole_inside_a_segment_stops_the_stream(spark, tmp_path):
    send(spark, str(tmp_path / "log"), E1, at=0)
    rows = spark.createDataFrame([("t", 0, 4, E2), ("t", 0, 6, E3)], "topic string, partition int, kafka_offset long, value string")
    write_log(rows, str(tmp_path / "log"), 4)
    with pytest.raises(Exception, match="lost offsets"):
        consume(spark, tmp_path, ls.Ledger(spark, str(tmp_path / "ledger")))


def test_a_batch_reads_its_source_once(spark, tmp_path):
    read, ledger = spark.sparkContext.accumulator(0), ls.Ledger(spark, str(tmp_path / "ledger"))

    def counted(row):
        read.add(1)
        return row

    rows = spark.sparkContext.parallelize([("t", 0, k, v) for k, v in enumerate((E1, E2, E1, E3, LATE))]).map(counted)
    batch = spark.createDataFrame(rows, "topic string, partition int, kafka_offset long, value string")
    ls.write_ledger_batch(ledger, "run", batch, 0)
    assert read.value == ledger.written.count() == 5
    assert not list((tmp_path / "ledger" / "decoded").iterdir())


def test_segments_are_read_as_arrow_batches(tmp_path):
    odd = '{"a":"\\u0000 \\\\ \U0001f600"}'
    lines = {"b.json": [{"value": odd, "offset": 7}, {"offset": 5, "value": "x", "more": [1]}], "a.json": [{"offset": 6}], "c.json": []}
    for name, held in lines.items():
        (tmp_path / name).write_text("\n\n".join(json.dumps(line) for line in held))
    reader, files = LogReader({"path": tmp_path.as_uri()}), [str(tmp_path / name) for name in lines]
    (found,) = reader.read(Segment("t", 3, 5, 9, files))
    assert isinstance(found, pa.RecordBatch)
    assert [tuple(row.values()) for row in found.to_pylist()] == [("t", 3, 5, "x"), ("t", 3, 6, None), ("t", 3, 7, odd)]
    assert [row["kafka_offset"] for part in reader.read(Segment("t", 3, 6, 7, files)) for row in part.to_pylist()] == [6]
    (tmp_path / "c.json").write_text('{"value":"y"}\n')
    with pytest.raises(ValueError, match="without an offset"):
        list(reader.read(Segment("t", 3, 5, 9, files)))
