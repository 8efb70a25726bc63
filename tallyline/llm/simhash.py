"""SimHash near-duplicates, compared bit-sliced.

Two fingerprints that differ in at most two bits agree in at least two of four 16-bit
quarters, so only fingerprints that share a pair of quarters are compared. In such a bucket
the fingerprints lie vertically: plane b holds bit b of 64 neighbours in one word, and one
carry-save counter per neighbour is advanced for all 64 with a few word operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import groups_of, id_and_text, labels_of, raw_texts, slices, table, written
from tallyline.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
LANES = 64
# Fingerprints of one bucket that a task holds at once; larger buckets are cut into pairs of blocks.
BLOCK = 4096
# Pairs of a fingerprint and a block of 64 others that are compared at once.
AT_ONCE = 1 << 18
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_PRINT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fingerprint", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes) -> int:
    """64 majority bits over the hashes of the text's shingles, repeats included; no words give 0.

    A-Z are lower-cased; words are runs of anything but blanks and control characters 9 to 13.
    A text of fewer words than a shingle has is one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends[: 1 - SHINGLE_WORDS] - lengths[: 1 - SHINGLE_WORDS] + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE_WORDS - 1 :].tolist())), np.uint64, len(starts)
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(text) for text in raw_texts(batch)], np.uint64)
        yield table(_PRINT, doc_id=batch.column("doc_id"), text_key=batch.column("text_key"), fingerprint=found.view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fingerprint) of every whole text; null texts are empty and have fingerprint 0."""
    rows = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_key long, fingerprint long")


def _keys() -> Column:
    """The six pairs of quarters of a fingerprint: (which pair, their 32 bits)."""
    quarters = [F.shiftrightunsigned("fingerprint", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    return F.array(
        *[F.struct(F.lit(t).alias("pair"), (quarters[i] * 65536 + quarters[j]).alias("bits")) for t, (i, j) in enumerate(combinations(range(4), 2))]
    )


def _buckets(prints: DataFrame) -> DataFrame:
    """Fingerprints by bucket; a bucket of over BLOCK is cut into blocks, one row per pair of blocks to compare."""
    keyed = prints.select("fingerprint", F.explode(_keys()).alias("k")).select("fingerprint", "k.pair", "k.bits")
    counts = keyed.groupBy("pair", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    large = written(counts.select("pair", "bits", F.ceil(F.col("n") / BLOCK).alias("blocks")), "large-buckets")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    cut = keyed.join(large, ["pair", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return (
        cut.select("fingerprint", "pair", "bits", own.alias("own"), other.alias("other"))
        .select("fingerprint", F.xxhash64("pair", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    )


def _planes(prints: np.ndarray) -> np.ndarray:
    """Blocks of 64 fingerprints turned over: row k, word b holds bit b of the 64 fingerprints of block k."""
    padded = np.zeros(-(-len(prints) // LANES) * LANES, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, LANES, 8), axis=2, bitorder="little")
    turned = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little"))
    return turned.view(np.uint64)[:, :, 0]


def close(prints: np.ndarray, query: np.ndarray, block: np.ndarray, planes: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes of ``block[i]`` lie within RADIUS of fingerprint ``query[i]``: indices i and their lane words.

    Two counter bits and a sticky bit per lane; a block is given up once every lane has passed
    the radius.
    """
    alive = np.arange(len(query))
    one, two, over = np.zeros(len(query), np.uint64), np.zeros(len(query), np.uint64), ~lanes[block]
    value, place = prints[query], block
    for bit in range(64):
        differs = planes[place, bit] ^ (np.uint64(0) - (value >> np.uint64(bit) & np.uint64(1)))
        carry = one & differs
        one ^= differs
        over = over | two & carry
        two ^= carry
        if bit % 8 == 7:
            over = over | one & two
            keep = over != _ALL
            if not keep.all():
                alive, one, two, over, value, place = (x[keep] for x in (alive, one, two, over, value, place))
            if not len(alive):
                break
    return alive, ~over


def bucket_links(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets ``prints[start:start+size]`` as two fingerprint arrays: each fingerprint to the smallest index it reaches."""
    blocks_of = -(-sizes // LANES)
    first_block = np.cumsum(blocks_of) - blocks_of
    planes, lanes, base = [], [], []
    for start, size in zip(starts.tolist(), sizes.tolist()):
        planes.append(_planes(prints[start : start + size]))
        full, rest = divmod(size, LANES)
        lanes += [_ALL] * full + [np.uint64((1 << rest) - 1)] * (rest > 0)
        base += range(start, start + size, LANES)
    planes, lanes, base = np.concatenate(planes), np.array(lanes, np.uint64), np.array(base, np.int64)
    query = np.concatenate([np.arange(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist())])
    bucket = np.repeat(np.arange(len(starts)), sizes)
    each = blocks_of[bucket]
    ends = np.cumsum(each)
    labels = np.arange(len(prints))
    at = 0
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        n = each[at:to]
        q = np.repeat(query[at:to], n)
        b = np.repeat(first_block[bucket[at:to]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found, words = close(prints, q, b, planes, lanes)
        which, lane = np.nonzero(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        labels = labels_of(len(prints), q[found[which]], base[b[found[which]]] + lane, labels)
        at = to
    moved = np.flatnonzero(labels != np.arange(len(prints)))
    return prints[moved], prints[labels[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of one task; rows arrive sorted by bucket."""
    held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts, sizes = groups_of(keys)
        many = sizes > 1
        if not many.any():
            return table(_LINK, a=[], b=[])
        a, b = bucket_links(prints, starts[many], sizes[many])
        return table(_LINK, a=a.view(np.int64), b=b.view(np.int64))

    for batch in batches:
        keys = np.r_[held_keys, batch.column("bucket").to_numpy()]
        prints = np.r_[held, batch.column("fingerprint").to_numpy().view(np.uint64)]
        if not len(keys):
            continue
        done = int(np.searchsorted(keys == keys[-1], True)) if keys[0] != keys[-1] else 0
        yield links(keys[:done], prints[:done])
        held_keys, held = keys[done:], prints[done:]
    yield links(held_keys, held)


def _named(prints: DataFrame) -> DataFrame:
    """(fingerprint, root, component_id) of every different fingerprint."""
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    rows = _buckets(classes.select("fingerprint")).repartition("bucket").sortWithinPartitions("bucket")
    groups = components(rows.mapInArrow(_compare, "a long, b long"))
    rooted = classes.join(groups, classes.fingerprint == groups.node, "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    return rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fingerprint", "root", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    Documents with equal fingerprints form one class, so copies cost nothing more; classes
    within two bits are linked and ``component_id`` is the smallest doc_id reachable. A null or
    empty text has fingerprint zero and links like any other. Every input row gives one row,
    repeated ids included; a null doc_id never names a component unless nothing else is in it.
    No documents give no rows. Other columns are ignored.
    """
    prints = written(fingerprints(docs), "fingerprints")
    named = _named(prints).drop("root")
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which one per group stays: the one with the smallest id, then text hash."""
    prints = written(fingerprints(docs), "fingerprints")
    rows = prints.join(_named(prints), "fingerprint").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    # A null id comes last.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n")
    kept = written(rows.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_kept_id"), "k.text_key", "k.n"), "kept")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))

    def those(keys: DataFrame) -> DataFrame:
        return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys["_kept_id"]) & (key == keys["text_key"]), "left_semi")

    single, repeated = kept.filter("n = 1"), kept.filter("n > 1")
    if repeated.isEmpty():
        return those(single)
    # Rows equal in id and text: any one of them.
    return those(single).unionByName(those(repeated).withColumn("_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_key"]).drop("_key"))
