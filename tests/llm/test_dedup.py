import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from reference import components, cosine_links, fingerprint, simhash_groups as expected_groups

from tallyline.llm import simhash, vector_dedup
from tallyline.llm.components import components as linked
from tallyline.llm.simhash import deduplicated, simhash_groups
from tallyline.llm.vector_dedup import near_vectors


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in linked(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {k: 200 for k in range(200, 209)} | {300: 300, 301: 300}
    assert got == want
    assert linked(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = ["", None, " \t", "One", "one", "Two words", "a b c", "A  b\nc", "é È x", "x" * 9]


def texts_with_copies():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(200)]
        rows.append(" ".join(base))
        for _ in range(k % 3):
            base[rng.randrange(200)] = rng.choice(words)
            rows.append(" ".join(base))
    return rows


@pytest.mark.parametrize("text", TEXTS + ["Ein  Text\x0bmit\x1cSonder zeichen und mehr", "a b " * 5000])
def test_fingerprint_matches_the_definition(text):
    assert simhash.fingerprint((text or "").encode()) == fingerprint(text)


def test_simhash_groups_match_brute_force(spark):
    rows = list(enumerate(TEXTS + texts_with_copies(), 10)) + [(10, ""), (None, "one"), (None, "alone here now")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = [tuple(r) for r in simhash_groups(df).collect()]
    assert sorted(got, key=str) == expected_groups(rows)
    assert simhash_groups(df.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (3, "A b c d"), (3, "a b c d"), (3, "a b c d"), (9, "other text altogether here"), (None, "a b c d"), (1, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS text_key", "1 AS root")
    kept = deduplicated(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    assert got == [(1, ""), (3, "a b c d"), (9, "other text altogether here")]
    assert deduplicated(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 2**32))
def test_bit_sliced_comparison_finds_exactly_the_close_ones(values, seed):
    rng = random.Random(seed)
    for v in values[:20]:
        for flips in range(1, 5):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), flips)))
    prints = np.array(values, np.uint64)
    a, b = simhash.bucket_links(prints, np.array([0]), np.array([len(prints)]))
    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    root = components(len(values), links)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted((values[i], values[r]) for i, r in enumerate(root) if r != i)


def test_large_buckets_are_cut_without_losing_a_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = list(enumerate(texts_with_copies() * 2 + [f"same words here again {k % 7}" for k in range(60)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in simhash_groups(df).collect()), key=str) == expected_groups(rows)


def vectors(n=400, dims=24):
    rng = np.random.default_rng(3)
    rows, base = [], None
    for k in range(n):
        if k % 4 == 0:
            base = rng.normal(size=dims)
        noise = rng.normal(size=dims) * rng.choice([0.0, 0.2, 0.38, 0.6])
        rows.append((k, [float(np.float32(x)) for x in base + noise], int(k % 40 < 30)))
    near = rng.normal(size=dims)
    rows += [(n + k, [float(np.float32(x)) for x in near + rng.normal(size=dims) * 0.25], 1) for k in range(120)]
    odd = [None, [], [0.0] * dims, [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [1.0, 2.0], [2.0, 4.0]]
    rows += [(2000 + k, v, 1) for k, v in enumerate(odd)] + [(2100, rows[0][1], None), (0, rows[0][1], rows[0][2]), (None, rows[4][1], rows[4][2])]
    return rows


@pytest.mark.parametrize("block", [vector_dedup.BLOCK, 40])
def test_near_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "7 AS bucket", "'x' AS node")
    got = near_vectors(df).collect()
    want = [r if r[1] or r[2] is not None else r for r in cosine_links(rows)]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = vector_dedup.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(vector_dedup.hadamard(y), x)
