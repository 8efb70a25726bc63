"""Exact duplicates by an extendible-hash index in the shared folder, in DataFrame functions only.

A text's hash code leads to a slot of the directory by its first bits, and the slot to a bucket.
The directory doubles as long as a bucket holds more codes than it may; only overfull buckets
split. Texts meet by code and are compared byte by byte; different texts of one code are chained.
The index files are written by owner tasks, each of which has a range of buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.llm.common import joined_by_share, written

# Different hash codes in a bucket before it splits.
CAPACITY = 1 << 14
BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Index:
    """``directory``: slot, bucket, local_depth; ``entries``: bucket, code, chain, digest, keep_id, group_size."""

    directory: DataFrame
    entries: DataFrame
    depth: int


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one blank; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest_of(text: Column) -> Column:
    """SHA-256 of a normalised text."""
    return F.unhex(F.sha2(text, 256))


def slot_of(code: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash code, 1 to 64 of them."""
    return F.shiftrightunsigned(code, 64 - depth)


def hashed(docs: DataFrame, code: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, code and digest (SHA-256) of every row's normalised text; other columns do not matter."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"]).alias("text"))
    return texts.select("doc_id", code(F.col("text")).alias("code"), digest_of(F.col("text")).alias("digest"))


def directory_of(codes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory over the different values of ``code``, and its depth.

    It starts as deep as that many codes need and doubles while a bucket is overfull. Codes of
    buckets that are not are not counted again. A bucket that split less often than the
    directory doubled has several slots.
    """
    open_codes = written(codes.select("code").distinct(), "codes")
    n = open_codes.count()
    depth = max(1, math.ceil(math.log2(max(1, n / capacity))))
    buckets = None
    while True:
        sizes = open_codes.groupBy(slot_of(F.col("code"), depth).alias("prefix")).agg(F.count("*").alias("codes"))
        sizes = written(sizes.withColumn("local_depth", F.lit(depth)), "bucket-sizes")
        fitting = sizes.filter(F.col("codes") <= capacity)
        buckets = fitting if buckets is None else buckets.unionByName(fitting)
        full = sizes.filter(F.col("codes") > capacity)
        if full.isEmpty():
            break
        inside = slot_of(F.col("code"), depth) == F.col("prefix")
        open_codes = written(open_codes.join(full.select("prefix"), inside, "left_semi"), "codes")
        depth += 1
    # A bucket is called after its first slot.
    first = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    last = first + F.expr(f"shiftleft(1L, {depth} - local_depth)") - 1
    slots = buckets.select(F.explode(F.sequence(first, last)).alias("slot"), first.alias("bucket"), "local_depth")
    return written(slots, "directory"), depth


def build_index(docs: DataFrame, rows: DataFrame, capacity: int = CAPACITY, code: Callable[[Column], Column] = F.xxhash64) -> Index:
    """The index of all texts; ``rows`` are the documents as ``hashed`` gives them.

    Copies are compared and counted where they lie before they move, so a text of very many
    copies reaches its place once per task. Each different text is an entry.
    """
    directory, depth = directory_of(rows, capacity)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"]).alias("text"))
    same = texts.groupBy(code(F.col("text")).alias("code"), "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = written(same.select("code", digest_of(F.col("text")).alias("digest"), "keep_id", "group_size"), "entries")
    chained = Window.partitionBy("bucket", "code").orderBy("keep_id", "digest")
    placed = found.withColumn("slot", slot_of(F.col("code"), depth)).join(directory.select("slot", "bucket"), "slot").drop("slot")
    owned = placed.repartitionByRange("bucket", "code").withColumn("chain", F.row_number().over(chained)).sortWithinPartitions("bucket", "code", "chain")
    return Index(directory, written(owned, "index"), depth)


def _by_text(docs: DataFrame, wanted: DataFrame, code: Callable[[Column], Column]) -> DataFrame:
    """Rows whose code and digest two different texts share, grouped by the texts themselves."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"]).alias("text"))
    near = texts.select("*", code(F.col("text")).alias("code"), digest_of(F.col("text")).alias("digest")).join(wanted, ["code", "digest"], "left_semi")
    groups = near.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return joined_by_share(near, groups.withColumn("n", F.col("group_size")), ["text"]).select("doc_id", "digest", "keep_id", "group_size")


def look_up(docs: DataFrame, rows: DataFrame, index: Index, code: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, digest, keep_id and group_size of every row, from its bucket.

    Bucket, code and digest name an entry; should two different texts share all three, their
    rows are looked up by the texts.
    """
    keys = ["bucket", "code", "digest"]
    doubtful = index.entries.groupBy(*keys).agg(F.count("*").alias("texts")).filter("texts > 1").select(*keys)
    sure = index.entries.select(*keys, "keep_id", "group_size", F.col("group_size").alias("n"))
    placed = rows.withColumn("slot", slot_of(F.col("code"), index.depth)).join(index.directory.select("slot", "bucket"), "slot").drop("slot")
    if doubtful.isEmpty():
        return joined_by_share(placed, sure, keys).select("doc_id", "digest", "keep_id", "group_size")
    told = joined_by_share(placed, sure.join(doubtful, keys, "left_anti"), keys).select("doc_id", "digest", "keep_id", "group_size")
    return told.unionByName(_by_text(docs, doubtful.select("code", "digest"), code))


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, code: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when they are after ``normalised``; a null text is empty. Whole texts are
    compared. Every input row gives one row. Of equal texts the smallest id stays; a null id
    only where no equal text has one. Rows that repeat id and text count in the group's size and are all
    kept, being one document. Extra columns are ignored. No rows give no rows.
    """
    rows = written(hashed(docs, code), "hashed")
    found = look_up(docs, rows, build_index(docs, rows, capacity, code), code)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns and their texts as they are."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    own = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.sha2(normalised(docs["text"]), 256) == F.col("_digest"))
    return docs.join(kept, own, "left_semi")
