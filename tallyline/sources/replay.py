"""A delivery log in files as a streaming source with a broker's rules of progress.

A log is JSON lines with offsets, in segments: one folder per topic, stream partition and range of
offsets, as ``write_log`` makes them. A stream starts at the earliest offset, remembers the next one
per stream partition, and fails when offsets it has not read are gone instead of going on behind
them. Segments are read in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs, json
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tallyline.schemas import LOG_LINES
from tallyline.sources.storage import qualified

# Offsets of a segment.
SEGMENT_BITS = 16
# Rows that reach Spark at once.
READ_ROWS = 10_000


def write_log(deliveries: DataFrame, path: str, segment_bits: int = SEGMENT_BITS) -> None:
    """Append deliveries (topic, partition, kafka_offset, value) as segments; one file and one task per segment."""
    segment = F.shiftright("kafka_offset", segment_bits).alias("segment")
    rows = deliveries.select("topic", "partition", segment, F.col("kafka_offset").alias("offset"), "value")
    keys = ["topic", "partition", "segment"]
    rows.repartition(*keys).sortWithinPartitions(*keys, "offset").write.mode("append").partitionBy(*keys).json(path)


@dataclass
class Segment(InputPartition):
    """Offsets of a stream partition from ``first`` up to, not including, ``end``, in the files of one segment."""

    topic: str
    partition: int
    first: int
    end: int
    files: list[str]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


_LINE = pa.schema([("offset", pa.int64()), ("value", pa.string())])


def _lines(path: str, files: list[str]) -> pa.Table:
    """Offsets and values of files, in the order of their offsets; other fields of a line are left out."""
    store, _ = _opened(path)
    held = [_LINE.empty_table()]
    for file in files:
        with store.open_input_stream(file) as stream:
            data = stream.read()
        if data.strip():
            # One block, as far as Arrow allows, so that no line is too long for it.
            whole = json.ReadOptions(use_threads=False, block_size=min(len(data) + 1, (1 << 31) - 1))
            held.append(json.read_json(pa.BufferReader(data), whole, json.ParseOptions(_LINE, unexpected_field_behavior="ignore")))
    lines = pa.concat_tables(held)
    if lines["offset"].null_count:
        raise ValueError(f"a line without an offset in {', '.join(files)}")
    return lines if (np.diff(lines["offset"].to_numpy()) >= 0).all() else lines.sort_by("offset")


def _offsets(path: str, files: list[str]) -> np.ndarray:
    """Offsets of files, ascending."""
    return _lines(path, files)["offset"].to_numpy()


class LogReader(DataSourceStreamReader):
    """Offsets are the next ones to read, by ``topic[partition]``."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.strict = options.get("failondataloss", "true").lower() == "true"

    def _segments(self) -> dict[str, dict[int, list[str]]]:
        """Files of every segment of every stream partition."""
        store, root = _opened(self.path)
        found: dict[str, dict[int, list[str]]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            names = info.path[len(root) :].strip("/").split("/")
            if info.is_file and len(names) == 4 and not names[3].startswith(("_", ".")):
                topic, partition, segment = (name.split("=", 1)[1] for name in names[:3])
                found.setdefault(f"{topic}[{partition}]", {}).setdefault(int(segment), []).append(info.path)
        return found

    def initialOffset(self) -> dict:
        """The earliest offset of every stream partition."""
        return {place: int(_offsets(self.path, own[min(own)])[0]) for place, own in self._segments().items()}

    def latestOffset(self) -> dict:
        """Behind the last offset of every stream partition; the last segment alone is read for it."""
        return {place: int(_offsets(self.path, own[max(own)])[-1]) + 1 for place, own in self._segments().items()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        segments, planned = self._segments(), []
        for place, reached in end.items():
            own = segments.get(place, {})
            held = {s: _offsets(self.path, own[s]) for s in ({min(own), max(own)} if own else ())}
            earliest = int(held[min(own)][0]) if own else reached
            # A stream partition that appeared after the start is read from its beginning.
            first = start.get(place, earliest)
            if self.strict and (first < earliest and first < reached or reached < first or (own and held[max(own)][-1] + 1 < reached) or (not own and first < reached)):
                raise RuntimeError(f"{place} lost offsets: {first} to {reached} are wanted, it begins at {earliest}")
            first = max(first, earliest)
            topic, partition = place[:-1].rsplit("[", 1)
            if first < reached:
                planned += [Segment(topic, int(partition), first, reached, files) for _, files in sorted(own.items())]
        return planned

    def read(self, segment: Segment) -> Iterator[pa.RecordBatch]:
        """Rows of a segment as Arrow batches, which need no conversion row by row."""
        lines = _lines(self.path, segment.files)
        offsets = lines["offset"].to_numpy()
        low, high = (int(k) for k in np.searchsorted(offsets, [segment.first, segment.end]))
        lines, offsets = lines.slice(low, high - low), offsets[low:high]
        torn = np.flatnonzero(np.diff(offsets) != 1)
        if self.strict and torn.size:
            expected, found = int(offsets[torn[0]]) + 1, int(offsets[torn[0] + 1])
            raise RuntimeError(f"{segment.topic}[{segment.partition}] lost offsets: {expected} is wanted, {found} follows")
        for part in lines.to_batches(max_chunksize=READ_ROWS):
            place = [pa.repeat(pa.scalar(segment.topic), len(part)), pa.repeat(pa.scalar(segment.partition, pa.int32()), len(part))]
            yield pa.RecordBatch.from_arrays([*place, *part.columns], names=["topic", "partition", "kafka_offset", "value"])

    def commit(self, end: dict) -> None:
        """Progress is the ledger's and the query's own."""


class ReplayLog(DataSource):
    """Format ``replay_log`` with the options ``path`` and ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return "replay_log"

    def schema(self) -> str:
        return "topic string, partition int, kafka_offset long, value string"

    def streamReader(self, schema) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()})


def read_log(spark: SparkSession, path: str, fail_on_loss: bool = True) -> DataFrame:
    """Deliveries of a log as a stream, from the earliest offset on."""
    spark.dataSource.register(ReplayLog)
    return spark.readStream.format("replay_log").option("path", qualified(spark, path)).option("failOnDataLoss", str(fail_on_loss).lower()).load()


def log_table(spark: SparkSession, path: str) -> DataFrame:
    """The same deliveries as a table."""
    rows = spark.read.schema(LOG_LINES).json(path)
    return rows.select("topic", "partition", F.col("offset").alias("kafka_offset"), "value")
