"""Token ids as ORC files ordered by document id.

The files hold one row per document: doc_id, the number of ids, the ids before it in its own
file, and the ids themselves. ORC stores the integers run-length encoded, keeps minimum and
maximum per stripe and per row group, and carries Bloom filters on doc_id, so a reader skips
stripes that cannot hold an id and tasks read different stripes at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyline.llm.common import id_and_text, slices, table
from tallyline.llm.tokens import crc32_of, encoder

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(64 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.compress": "LZ4",
}
_FILE = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_before", pa.int64()), ("token_ids", pa.list_(pa.int32()))]
)
_READ = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_before", pa.int64()), ("ids_crc32", pa.int64()), ("file_name", pa.string())]
)


def _encode(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in slices(batches):
            ids, lengths = encoder(tokenizer_path).encode(batch.column("text"))
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lengths),
                    pa.array(before + ends - lengths),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32())),
                ],
                schema=_FILE,
            )
            before += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Encode every whole text, end each document with id 2, and write ORC in ascending doc_id order.

    Texts are range-partitioned by document id before they are encoded, so each file holds one
    range of ids and file names ascend with the ids. A null text is an empty one and gives only
    the end id; null document ids come first; repeated ids lie next to each other, ordered by the hash of
    their text. No documents give files without rows.
    """
    rows = id_and_text(docs)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    tokens = placed.mapInArrow(_encode(tokenizer_path), "doc_id long, n_tokens long, ids_before long, token_ids array<int>")
    tokens.write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with their file's name; filters on doc_id prune stripes and row groups."""
    schema = "doc_id long, n_tokens long, ids_before long, token_ids array<int>"
    return spark.read.schema(schema).orc(path).withColumn("file_name", F.col("_metadata.file_name"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("token_ids")
        flat, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        yield table(
            _READ,
            doc_id=batch.column("doc_id"),
            n_tokens=batch.column("n_tokens"),
            ids_before=batch.column("ids_before"),
            ids_crc32=[crc32_of(flat[a:b]) for a, b in zip(edges, edges[1:])],
            file_name=batch.column("file_name"),
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    A file's ids before it are summed from its rows' counts; the running total goes over files,
    not documents.
    """
    files = read_token_files(spark, path)
    sizes = files.groupBy("file_name").agg(F.sum("n_tokens").alias("file_ids"))
    earlier = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file_name", F.coalesce(F.sum("file_ids").over(earlier), F.lit(0)).alias("base"))
    rows = files.mapInArrow(_digest, "doc_id long, n_tokens long, ids_before long, ids_crc32 long, file_name string")
    return rows.join(bases, "file_name").select("doc_id", (F.col("base") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")
