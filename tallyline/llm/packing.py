"""Packing documents into sequences of a fixed number of tokens by minimum bin slack.

Pieces of equal length are interchangeable, so the plan works on how many pieces there are of
each length: at most as many numbers as a sequence has tokens, whatever the corpus holds. The
plan says for each length which ranks go where; the pieces are then looked up in it in
parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyline.llm.common import id_and_text, slices, table, written
from tallyline.llm.tokens import crc32_of, encoder

SEQUENCE_TOKENS = 1024
# Texts encoded at once, in bytes: what encoding needs for a moment is many times the text.
ENCODED_BYTES = 1 << 20
_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("part", pa.int64()), ("place", pa.int64())]
)
_PACKED = pa.schema([*list(_PIECE)[:5], pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, behind a first one that may be shorter."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first), *((start, capacity) for start in range(first, n_tokens, capacity))]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` best: a subset-sum over one bit per total.

    Bit t of a row is set if the lengths so far can sum to t. Longer lengths come first, and a
    length that occurs often enters in doubling lots. The best total is traced back row by row.
    """
    rows, lots, reach, limit = [1], [], 1, (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:
            take = min(lot, left)
            left, lot = left - take, lot * 2
            reach |= reach << take * length & limit
            lots.append((length, take))
            rows.append(reach)
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for k in range(len(lots) - 1, -1, -1):
        if not rows[k] >> total & 1:
            length, take = lots[k]
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, pieces per length) of each kind of sequence, by minimum bin slack.

    The longest piece left opens a sequence and the fullest feasible combination closes it. As
    many sequences of that kind follow as the counts allow, so the plan's size depends on the
    capacity and not on the corpus.
    """
    left, kinds = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        used = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        kinds.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return kinds


def _cut_pieces(tokenizer_path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches, size=ENCODED_BYTES):
            ids, lengths = encoder(tokenizer_path).encode(batch.column("text"))
            rows, at = [], 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), lengths.tolist()):
                for k, (start, length) in enumerate(cut(n, capacity)):
                    rows.append((doc_id, k, start, length, crc32_of(ids[at + start : at + start + length]), part, seen[length]))
                    seen[length] += 1
                at += n
            yield table(_PIECE, **dict(zip(_PIECE.names, map(list, zip(*rows)))))

    return run


def _places(kinds: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, in order: the first rank, the first sequence, pieces per sequence, and the offset there."""
    rows, taken, sequence = [], {}, 0
    for times, used in kinds:
        offset = 0
        for length in sorted(used, reverse=True):
            first = taken.get(length, 0)
            rows.append((length, first, sequence, used[length], offset))
            taken[length] = first + times * used[length]
            offset += length * used[length]
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), columns))


def _place(places: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (places["length"] << 44) + places["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            past, each = rank - places["rank"][k], places["each"][k]
            yield table(
                _PACKED,
                **{name: batch.column(name) for name in _PACKED.names[:5]},
                sequence_id=places["sequence"][k] + past // each,
                offset=places["offset"][k] + past % each * length,
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document has at least its end id, so a null or empty text gives one piece of length 1.
    Repeated documents are packed as often as they occur; null document ids pass through. No
    documents give no pieces. A piece's rank among those of its length is its place in its task
    plus the counts of the tasks before, so no length is ranked in one task.
    """
    pieces = written(
        id_and_text(docs).mapInArrow(
            _cut_pieces(tokenizer_path, capacity),
            "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long",
        ),
        "pieces",
    )
    counts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    # At most ``capacity`` rows reach the driver.
    histogram = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(
        _place(_places(plan(histogram, capacity))),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
