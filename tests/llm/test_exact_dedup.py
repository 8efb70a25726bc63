"""The extendible-hash index against plain grouping."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyline.llm import exact_dedup
from tallyline.llm.exact_dedup import build_index, directory_of, exact_groups, hashed, without_copies

ROWS = "doc_id long, text string, n long, code string, bucket int"


def expected(rows):
    groups: dict = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def sample():
    rng = random.Random(3)
    rows = [(k, " \t".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))) for k in range(1500)]
    rows += [(2000 + k, "the same text" + " " * (k % 3 + 1) + "again\r\n") for k in range(900)]
    rows += [(9001, None), (9002, ""), (9003, " "), (9004, "\x0b\x0c"), (9005, " "), (9005, " "), (None, "only null ids"), (None, "the same text again\n")]
    return rows + [(9010, "long " * 100_000), (9011, "long  " * 100_000), (9012, "long " * 99_999 + "lonG "), (9013, "É"), (9014, "é")]


@pytest.mark.parametrize("code", [F.xxhash64, lambda text: F.xxhash64(F.length(text) % 5)])
def test_groups_match_plain_code(spark, code):
    rows = sample()
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], ROWS).repartition(7)
    got = exact_groups(df, 4, code)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest_of", lambda text: F.unhex(F.sha2(F.substring(text, 1, 1), 256)))
    rows = sample()
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, lambda text: F.xxhash64(F.substring(text, 1, 1)))
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == [r[:4] for r in expected(rows)]


def test_only_overfull_buckets_split(spark):
    codes = spark.range(2000).select(F.xxhash64("id").alias("code"))
    directory, depth = directory_of(codes, 10)
    slots = directory.orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(2**depth))
    filled = {r.bucket: r.n for r in codes.groupBy(exact_dedup.slot_of(F.col("code"), depth).alias("slot")).count().join(directory, "slot").groupBy("bucket").agg(F.sum("count").alias("n")).collect()}
    assert max(filled.values()) <= 10
    depths = {r.bucket: r.local_depth for r in slots}
    assert len(set(depths.values())) > 1 and max(depths.values()) == depth
    for bucket, local in depths.items():
        own = [r.slot for r in slots if r.bucket == bucket]
        assert own == list(range(bucket, bucket + 2 ** (depth - local)))


def test_owners_have_ranges_and_chains(spark):
    rows = spark.createDataFrame(sample(), "doc_id long, text string")
    code = lambda text: F.xxhash64(F.length(text))
    index = build_index(rows, hashed(rows, code), 4, code)
    found = index.entries.withColumn("owner", F.col("_metadata.file_name")).collect()
    ranges = {}
    for r in found:
        low, high = ranges.get(r.owner, (r.bucket, r.bucket))
        ranges[r.owner] = (min(low, r.bucket), max(high, r.bucket))
    spans = sorted(ranges.values())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    chains = {}
    for r in found:
        chains.setdefault(r.code, []).append(r.chain)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in chains.values()) and max(map(len, chains.values())) > 1


def test_kept_documents_keep_columns_and_texts(spark):
    df = spark.createDataFrame([(1, "a  b", 5, "c", 1), (2, "a b", 6, "d", 2), (3, "c", 7, "e", 3), (3, "c", 8, "f", 4)], ROWS)
    assert sorted(map(tuple, without_copies(df).collect())) == [(1, "a  b", 5, "c", 1), (3, "c", 7, "e", 3), (3, "c", 8, "f", 4)]
    assert without_copies(df).columns == df.columns
    assert exact_groups(df.limit(0)).count() == 0
