"""Codes, errors and codebooks against plain Lloyd rounds in Python's integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tallyline.llm import vector_codes as vc
from tallyline.llm.vector_codes import assignments, nearest, tree_over, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string, code string, n int, vector int"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = next((len(r[1]) for r in order if r[1] and len(r[1]) % parts == 0), 0)
    d = width // parts
    own = [r for r in order if width and len(r[1]) == width]
    books = [[r[1][p * d : p * d + d] for r in own[:entries]] for p in range(parts)]

    def near(p, part):
        away = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in books[p]]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        met = [[[] for _ in books[p]] for p in range(parts)]
        for _, v, _ in own:
            for p in range(parts):
                part = v[p * d : p * d + d]
                met[p][near(p, part)[0]].append(part)
        books = [[[sum(c) // len(c) for c in zip(*m)] if m else e for m, e in zip(met[p], books[p])] for p in range(parts)]
    out = []
    for i, v, lab in kept:
        found = [near(p, v[p * d : p * d + d]) for p in range(parts)] if width and len(v) == width else None
        out.append((i, found and "".join(f"{e:02x}" for e, _ in found), found and sum(a for _, a in found), lab))
    totals = {}
    for _, _, error, lab in out:
        if error is not None:
            totals[lab] = totals.get(lab, 0) + error
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, c, e, totals.get(lab), digest) for i, c, e, lab in out), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "c", 1, 2) for i, v, lab in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, vector_codes(df).collect()), key=str)


@pytest.mark.parametrize("few", [0, 1, 30, 400])
def test_codes_match_plain_code(spark, few):
    rng = random.Random(few)
    rows = [(rng.randrange(2000) * 3, [rng.gauss(k % 5, 0.7) for _ in range(32)], rng.choice(["a", "b", None])) for k in range(few)]
    rows += [(1, None, "a"), (2, [None] * 32, "a"), (3, [math.inf] + [0.0] * 31, "a"), (4, [math.nan] * 32, None), (5, [], "c"), (6, [1.0] * 17, "a"), (7, [0.5] * 48, "d")] if few else []
    rows += rows[10:14] * 2
    got = run(spark, rows)
    if few == 1:
        # Id 7 is the only vector that can be cut besides the one made above, and the smaller id names the width.
        assert len({r[4] for r in got}) == 1
    assert got == plain_codes(rows)


def test_ties_and_hot_labels(spark):
    rows = [(k, [float((k * (p + 1)) % 3) / 256 for p in range(16)], "hot" if k % 3 else f"l{k}") for k in range(900)]
    assert run(spark, rows) == plain_codes(rows)


def test_numbers_of_any_size(spark):
    rows = [(k, [float((-1) ** k) * 1e300 * (k + p) if k % 4 == 0 else k * 1e7 + p for p in range(16)], None) for k in range(80)]
    want = plain_codes(rows, entries=64)
    got = run(spark, rows)
    assert [r[:2] for r in got] == [r[:2] for r in want] and got[0][4] == want[0][4]
    assert [r[2] for r in got] == [r[2] if r[2] < 2**63 else None for r in want]


def test_whole_nodes_and_uncertain_leaves_cover_every_point():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (2, 64, 3))
    points = (centres[:, rng.integers(0, 64, 4000)] + rng.integers(-9, 10, (2, 4000, 3))).astype(np.int64)
    parts, entries = tree_over(points, 16), tree_over(centres, 1)
    whole, (leaves, _) = assignments(parts, entries)
    assigned = sum(int((parts.edges[level][node + 1] - parts.edges[level][node]).sum()) for level, node, _ in whole)
    left = np.unique(leaves)
    assert assigned + int((parts.edges[-1][left + 1] - parts.edges[-1][left]).sum()) == 8000
    assert assigned > 2000 and any(level < parts.levels - 1 for level, node, _ in whole if len(node))
    code, sums, sizes = nearest(points, centres)
    want = ((points[:, :, None] - centres[:, None]) ** 2).sum(-1).argmin(-1)
    assert (code == want).all() and sizes.sum() == 8000
    assert (sums[1, 5] == points[1][want[1] == 5].sum(0)).all()


def test_uncertain_leaves_are_compared_in_lots(monkeypatch):
    monkeypatch.setattr(vc, "COMPARED_NUMBERS", 100)
    rng = np.random.default_rng(4)
    points = rng.integers(-20, 20, (3, 500, 2))
    books = points[:, :37].copy()
    code, _, _ = nearest(points, books)
    assert (code == ((points[:, :, None] - books[:, None]) ** 2).sum(-1).argmin(-1)).all()
