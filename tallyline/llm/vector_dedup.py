"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by fast Hadamard rotations with random signs; the hash of one rotation is
the axis it lies closest to, and a bucket is a pair of such axes. Each vector is kept in its
own bucket of every table and looks into the PROBES nearest ones. Every pair that meets is
verified by its cosine in double precision and counted in the first table in which it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyline.llm.common import groups_of, joined_by_share, labels_of, table, written
from tallyline.llm.components import components

MIN_COSINE = 0.93
# At 64 dimensions a pair at the threshold meets in one table with probability 0.86 (measured over 20,000
# random pairs), so all eight tables miss it with 2e-7; closer pairs meet more often.
TABLES = 8
PROBES = 8
SEED = 20240607
# Rows of one bucket that meet in one task; larger buckets are cut into a grid of blocks.
BLOCK = 2048
# Elements of a matrix of cosines held at once.
AT_ONCE = 1 << 21
# Verified pairs counted at once.
LOT = 1 << 17
_NEAREST = 8
_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


@lru_cache
def _signs(dims: int, table_no: int) -> np.ndarray:
    """Random signs of a table: two hashes of three rotations each."""
    return np.random.default_rng([SEED, dims, table_no]).choice([-1.0, 1.0], size=(2, 3, dims))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, length-preserving; the width is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(-1, n // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        half *= 2
    return x / np.sqrt(n)


def buckets(unit: np.ndarray, table_no: int) -> np.ndarray:
    """The PROBES nearest buckets of each row in a table, its own bucket first."""
    dims = 1 << max(3, (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), dims))
    padded[:, : unit.shape[1]] = unit
    losses, axes = [], []
    for signs in _signs(dims, table_no):
        turned = padded
        for s in signs:
            turned = hadamard(turned * s)
        size = np.abs(turned)
        near = np.argsort(-size, axis=1, kind="stable")[:, :_NEAREST]
        value = np.take_along_axis(size, near, 1)
        losses.append((value[:, :1] - value) ** 2)
        axes.append(near * 2 + (np.take_along_axis(turned, near, 1) < 0))
    loss = (losses[0][:, :, None] + losses[1][:, None, :]).reshape(len(unit), -1)
    pair = (axes[0][:, :, None] * (2 * dims) + axes[1][:, None, :]).reshape(len(unit), -1)
    best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
    return np.take_along_axis(pair, best, 1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector once per table in its own bucket, and once per further bucket it looks into."""
    names = ["node", "weight", "label_group", "bucket", "own", "table", "vector"]
    for batch in batches:
        widths = np.diff(batch.column("vector").offsets.to_numpy())
        for width in np.unique(widths):
            part = batch.take(pa.array(np.flatnonzero(widths == width)))
            node, weight, group, vector = (part.column(n) for n in ("node", "weight", "label_group", "vector"))
            unit = _unit(vector.flatten().to_numpy(zero_copy_only=False).reshape(-1, int(width)).astype(np.float64))
            for t in range(TABLES):
                found = buckets(unit, t)
                for p in range(PROBES):
                    bucket = _mixed(group.to_numpy() + int(width) * 7919 + t * 104729, found[:, p])
                    own, no = np.full(len(unit), p == 0), np.full(len(unit), t, np.int32)
                    yield pa.RecordBatch.from_arrays([node, weight, group, pa.array(bucket), pa.array(own), pa.array(no), vector], names=names)


def _mixed(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One number per bucket; two buckets sharing a number only cost comparisons that are verified anyway."""
    with np.errstate(over="ignore"):
        x = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + value.astype(np.uint64)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(29)).view(np.int64)


class _Meet:
    """Which pairs of rows meet in a table, and whether they met in an earlier one."""

    def __init__(self, unit: np.ndarray):
        self.probes = [buckets(unit, t) for t in range(TABLES)]

    def looks(self, a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
        """Whether a looks into b's bucket in table t."""
        return (self.probes[t][a] == self.probes[t][b, :1]).any(1)

    def first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """First table in which a looks into b's bucket or b into a's; TABLES if none."""
        found = np.full(len(a), TABLES)
        for t in range(TABLES - 1, -1, -1):
            found[self.looks(a, b, t) | self.looks(b, a, t)] = t
        return found


class _Task:
    """Verified pairs of a task's cells, counted in lots."""

    def __init__(self, rows: pa.Table):
        self.node, self.weight, self.group, self.table, self.own, self.looking = (
            rows.column(name).to_numpy() for name in ("node", "weight", "label_group", "table", "own", "looks")
        )
        lists = rows.column("vector").combine_chunks()
        self.width = np.diff(lists.offsets.to_numpy())
        self.vectors, self.at = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(self.width)]
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def unit(self, rows: np.ndarray) -> np.ndarray:
        """Rows of one width as unit vectors in double precision."""
        width = int(self.width[rows[0]])
        return _unit(self.vectors[self.at[rows][:, None] + np.arange(width)].astype(np.float64))

    def cell(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of a cell's looking and kept rows that reach MIN_COSINE."""
        looking, kept = rows[self.looking[rows]], rows[self.own[rows]]
        if not len(looking) or not len(kept):
            return
        right = self.unit(kept)
        step = max(1, AT_ONCE // len(kept))
        for part in (looking[k : k + step] for k in range(0, len(looking), step)):
            a, b = np.nonzero(self.unit(part) @ right.T >= MIN_COSINE)
            a, b = part[a], kept[b]
            real = (self.node[a] != self.node[b]) & (self.group[a] == self.group[b])
            if real.any():
                self.pairs.append((a[real], b[real]))
            if sum(len(x) for x, _ in self.pairs) > LOT:
                yield from self.counted()

    def counted(self) -> Iterator[pa.RecordBatch]:
        """Weights linked to each node by the pairs so far, and the smallest node each reaches over them.

        A pair counts only in the first table in which it meets, and once where both look at each other.
        """
        pairs, self.pairs = self.pairs, []
        if not pairs:
            return
        a, b = (np.concatenate(x) for x in zip(*pairs))
        for width in np.unique(self.width[a]):
            own = self.width[a] == width
            left, right = a[own], b[own]
            nodes, first_row, place = np.unique(self.node[np.r_[left, right]], return_index=True, return_inverse=True)
            met = _Meet(self.unit(np.r_[left, right][first_row]))
            i, j = place[: len(left)], place[len(left) :]
            here = np.zeros(len(left), bool)
            for t in np.unique(self.table[left]):
                at = np.flatnonzero(self.table[left] == t)
                x, y = i[at], j[at]
                here[at] = (met.first(x, y) == t) & met.looks(x, y, t) & ((nodes[x] < nodes[y]) | ~met.looks(y, x, t))
            gained = np.zeros(len(nodes), np.int64)
            np.add.at(gained, i[here], self.weight[right[here]])
            np.add.at(gained, j[here], self.weight[left[here]])
            labels = labels_of(len(nodes), i[here], j[here])
            some = np.flatnonzero(gained)
            yield table(_FOUND, node=nodes[some], links=gained[some], to=nodes[labels[some]])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the cells of one task; rows arrive sorted by cell."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        task = _Task(rows)
        # Cells share a number only by chance; telling them apart by table and width as well keeps them exact.
        starts, sizes = groups_of(rows.column("cell").to_numpy())
        useful = np.flatnonzero((sizes > 1) & (np.add.reduceat(task.own.astype(np.int64), starts) > 0)) if len(starts) else []
        for k in useful:
            members = np.arange(starts[k], starts[k] + sizes[k])
            kinds = task.width[members].astype(np.int64) * TABLES + task.table[members]
            for kind in np.unique(kinds):
                yield from task.cell(members[kinds == kind])
        yield from task.counted()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        cell = rows.column("cell").to_numpy()
        done = int(np.searchsorted(cell == cell[-1], True)) if cell[0] != cell[-1] else 0
        if done:
            yield from links(rows.slice(0, done).combine_chunks())
        held = rows.slice(done).to_batches()
    if held:
        yield from links(pa.Table.from_batches(held).combine_chunks())


def _cells(rows: DataFrame) -> DataFrame:
    """Rows by cell: a bucket, or a pair of blocks of a bucket of over BLOCK rows.

    In a whole bucket every row looks at the kept ones. In a cut one, each block of kept rows
    meets each block of looking rows in a cell of its own.
    """
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    large = written(counts.select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")), "large-buckets")
    cut = rows.join(large, "bucket", "left")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)

    def place(kept, looking, own: bool):
        return F.struct(F.xxhash64("bucket", kept, looking).alias("cell"), F.lit(own).alias("own"), F.lit(not own).alias("looks"))

    kept = F.transform(every, lambda other: place(mine, other, True))
    looking = F.transform(every, lambda other: place(other, mine, False))
    whole = F.array(F.struct(F.col("bucket").alias("cell"), F.col("own"), F.lit(True).alias("looks")))
    places = F.when(F.col("blocks").isNull(), whole).when(F.col("own"), F.concat(kept, looking)).otherwise(looking)
    return cut.withColumn("p", F.explode(places)).select("node", "weight", "label_group", "table", "vector", "p.cell", "p.own", "p.looks")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; links need equal non-null labels and a cosine of MIN_COSINE.

    Equal vectors under one label form one class, represented by its smallest id, and count as
    linked to each other. Vectors that are null, empty, zero or hold null or non-finite
    components, or whose label is null, link with nothing; vectors of different lengths do not
    link. Every input row gives one row; a null vec_id counts as a link of others but names no
    component. No vectors give no rows; other columns are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    element = element if element in ("float", "double") else "double"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{element}>").alias("vector")
    )
    usable = (
        F.col("label").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    digest = F.when(F.coalesce(usable, F.lit(False)), F.sha2(F.to_json(F.struct("label", "vector")), 256))
    marked = written(rows.withColumn("digest", digest), "vectors")
    classes = written(
        marked.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"), F.first("vector").alias("vector"), F.first("label").alias("label"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vector-classes",
    )
    # Classes and labels have numbers of their own, so no two are taken for one.
    labels = classes.groupBy("label").agg(F.count("*").alias("n"))
    labels = written(labels.withColumn("label_group", F.monotonically_increasing_id()), "labels")
    grouped = joined_by_share(classes.select("node", "weight", "label", "vector"), labels, ["label"])
    spread = grouped.select("node", "weight", "label_group", "vector").mapInArrow(
        _spread, f"node long, weight long, label_group long, bucket long, own boolean, table int, vector array<{element}>"
    )
    cells = _cells(spread).repartition("cell").sortWithinPartitions("cell")
    found = written(cells.mapInArrow(_verify, "node long, links long, to long"), "vector-links")
    degrees = found.groupBy("node").agg(F.sum("links").alias("other_links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    rooted = (
        classes.select("digest", "node", "weight", "first_id")
        .join(degrees, "node", "left")
        .join(groups, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select(
        "digest", "component_id", (F.coalesce("other_links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return marked.select("vec_id", "digest").join(named, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
