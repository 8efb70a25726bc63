"""Vectors as codes of small integer codebooks, fitted by Lloyd's rounds over two trees.

Every task builds a tree over the parts of its vectors and one over the codebook's entries, and
goes down both at once. Integer bounds on the distance between two nodes' boxes drop the entries
that are nearest to no part of a node; a node with one entry left is assigned as a whole, its
cached sums added to the entry's. What stays uncertain down to the leaves is decided by integer
distances. Tasks return sums per entry, so a round moves as much as the codebooks hold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyline.llm.common import joined_by_share, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Numbers a tree is built over at once, and parts in a leaf.
BLOCK_NUMBERS = 1 << 19
LEAF = 16
# Numbers compared at once where leaves stay uncertain.
COMPARED_NUMBERS = 1 << 21
# Sums travel in digits of this many bits, so that they may be of any size.
DIGIT_BITS = 40
_LONG = (1 << 63) - 1


@dataclass
class Tree:
    """Boxes, sums and sizes of the nodes of each level; ``order`` lists the points so that nodes are runs of it."""

    order: np.ndarray
    edges: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @property
    def levels(self) -> int:
        return len(self.edges)


def tree_over(points: np.ndarray, leaf: int) -> Tree:
    """One tree for each of the first axis' point sets (sets, points, components), all of the same shape.

    Nodes split at the middle of their widest component. Node j of set s has number
    s * 2^level + j, its children twice that and one more.
    """
    sets, n, d = points.shape
    flat = points.reshape(sets * n, d)
    order = np.arange(sets * n)
    depth = max(0, math.ceil(math.log2(n / leaf)))
    while 1 << depth > n:
        depth -= 1
    edges, low, high, sums = [], [], [], []
    for level in range(depth + 1):
        inner = (n * np.arange(1 << level)) >> level
        starts = (n * np.arange(sets)[:, None] + inner[None, :]).ravel()
        sorted_points = flat[order]
        edges.append(np.r_[starts, sets * n])
        low.append(np.minimum.reduceat(sorted_points, starts))
        high.append(np.maximum.reduceat(sorted_points, starts))
        sums.append(np.add.reduceat(sorted_points, starts))
        if level < depth:
            widest = np.argmax(high[-1] - low[-1], axis=1)
            node = np.repeat(np.arange(len(starts)), np.diff(edges[-1]))
            order = order[np.lexsort((sorted_points[np.arange(sets * n), widest[node]], node))]
    return Tree(order, edges, low, high, sums)


def _bounds(a: Tree, at: int, i: np.ndarray, b: Tree, bt: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance that points of two boxes can have."""
    below, above = a.low[at][i] - b.high[bt][j], b.low[bt][j] - a.high[at][i]
    gap = np.maximum(np.maximum(below, above), 0)
    reach = np.maximum(np.abs(below), np.abs(above))
    return (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)


def _children(parent: np.ndarray) -> np.ndarray:
    return np.stack([2 * parent, 2 * parent + 1], axis=1)


def assignments(parts: Tree, entries: Tree) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Whole nodes as (level, nodes, entries), and (leaves, entries) pairs that stay uncertain, ordered by leaf.

    An entry is dropped only if it is farther than some entry from every point of the node, so
    entries at equal distance stay to be told apart by their index.
    """
    whole: list[tuple[int, np.ndarray, np.ndarray]] = []
    sets = len(parts.edges[0]) - 1
    roots = len(entries.edges[0]) - 1
    node, entry = np.repeat(np.arange(sets), roots // sets), np.arange(roots)
    at, bt = 0, 0
    while True:
        least, greatest = _bounds(parts, at, node, entries, bt, entry)
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        bound = np.repeat(np.minimum.reduceat(greatest, starts), np.diff(np.r_[starts, len(node)]))
        kept = least <= bound
        node, entry = node[kept], entry[kept]
        single = bt == entries.levels - 1
        if single:
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            alone = np.diff(np.r_[starts, len(node)]) == 1
            whole.append((at, node[starts[alone]], entry[starts[alone]]))
            rest = np.repeat(~alone, np.diff(np.r_[starts, len(node)]))
            node, entry = node[rest], entry[rest]
            if not len(node) or at == parts.levels - 1:
                return whole, (node, entry)
        a = _children(node) if at < parts.levels - 1 else node[:, None]
        b = _children(entry) if not single else entry[:, None]
        node, entry = np.repeat(a, b.shape[1], axis=1).ravel(), np.tile(b, (1, a.shape[1])).ravel()
        at, bt = min(at + 1, parts.levels - 1), min(bt + 1, entries.levels - 1)
        by_node = np.argsort(node, kind="stable")
        node, entry = node[by_node], entry[by_node]


def _uncertain(points: np.ndarray, parts: Tree, leaves: np.ndarray, entry: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, entry) of the points of uncertain leaves by integer distances, the lower index first among equals."""
    if not len(leaves):
        return
    m = books.shape[1]
    flat_books = books.reshape(-1, books.shape[2])
    starts = np.flatnonzero(np.r_[True, leaves[1:] != leaves[:-1]])
    choices = np.diff(np.r_[starts, len(leaves)])
    edges = parts.edges[-1]
    first, size = edges[leaves[starts]], edges[leaves[starts] + 1] - edges[leaves[starts]]
    turn = np.cumsum(size * choices * books.shape[2]) // COMPARED_NUMBERS
    for lot in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(turn)) + 1):
        pairs = size[lot] * choices[lot]
        run = np.repeat(lot, pairs)
        r = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        point = parts.order[first[run] + r // choices[run]]
        chosen = entry[starts[run] + r % choices[run]]
        away = points[point] - flat_books[chosen]
        key = (away * away).sum(axis=1) * m + chosen % m
        each = np.repeat(choices[lot], size[lot])
        heads = np.cumsum(each) - each
        yield point[heads], np.minimum.reduceat(key, heads) % m + point[heads] // (len(points) // books.shape[0]) * m


def nearest(points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For points (parts, n, d) and books (parts, entries, d): the entry of each point, and sums and sizes per entry."""
    sets, n, d = points.shape
    m = books.shape[1]
    if not _fits(points, books):
        return _nearest_of_any_size(points, books)
    flat = points.reshape(sets * n, d)
    parts, entries = tree_over(points, LEAF), _entry_tree(books)
    whole, (leaves, left) = assignments(parts, entries)
    code = np.empty(sets * n, np.int64)
    sums, sizes = np.zeros((sets * m, d), np.int64), np.zeros(sets * m, np.int64)
    for level, node, place in whole:
        entry = entries.order[place]
        run = parts.edges[level][node + 1] - parts.edges[level][node]
        np.add.at(sums, entry, parts.sums[level][node])
        np.add.at(sizes, entry, run)
        places = np.repeat(parts.edges[level][node] - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))
        code[parts.order[places]] = np.repeat(entry, run)
    for point, entry in _uncertain(flat, parts, leaves, entries.order[left], books):
        np.add.at(sums, entry, flat[point])
        np.add.at(sizes, entry, 1)
        code[point] = entry
    return code.reshape(sets, n) % m, sums.reshape(sets, m, d), sizes.reshape(sets, m)


def _entry_tree(books: np.ndarray) -> Tree:
    """A tree whose leaves are single entries; the last level has a node for each, whatever their number."""
    sets, m, d = books.shape
    tree = tree_over(books, 1)
    if 1 << (tree.levels - 1) == m:
        return tree
    # Not a power of two: a flat tree, in which every entry is told apart at once.
    flat = books.reshape(sets * m, d)
    return Tree(np.arange(sets * m), [np.arange(sets * m + 1)], [flat], [flat], [flat])


def _fits(points: np.ndarray, books: np.ndarray) -> bool:
    """Whether all distances times the number of entries fit 62 bits."""
    if points.dtype == object or books.dtype == object:
        return False
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(books).max(initial=0)))
    return (2 * most) ** 2 * points.shape[0] * points.shape[2] * max(64, books.shape[1]) < 1 << 62


def _nearest_of_any_size(points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by Python's integers, which no value is too large for."""
    points, books = points.astype(object), books.astype(object)
    sets, n, d = points.shape
    m = books.shape[1]
    code, sums, sizes = np.zeros((sets, n), np.int64), np.zeros((sets, m, d), object), np.zeros((sets, m), np.int64)
    for s in range(sets):
        for i in range(n):
            away = [sum((x - y) ** 2 for x, y in zip(points[s, i], books[s, e])) for e in range(m)]
            code[s, i] = e = away.index(min(away))
            sums[s, e] += points[s, i]
            sizes[s, e] += 1
    return code, sums, sizes


def _scaled(x: float) -> int:
    return math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE


def _blocks(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, which of them have the width, their integer parts as (parts, n, components))."""
    size = max(1, BLOCK_NUMBERS // width)
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            block = batch.slice(start, size)
            vectors = block.column("vector")
            fitting = vectors.value_lengths().to_numpy(zero_copy_only=False) == width
            values = vectors.filter(pa.array(fitting)).flatten().to_numpy(zero_copy_only=False)
            if len(values) and np.abs(values).max() * SCALE < 2.0**52:
                whole = np.floor(values * SCALE).astype(np.int64)
            else:
                whole = np.array([_scaled(x) for x in values.tolist()], object)
            yield block, fitting, np.ascontiguousarray(whole.reshape(-1, parts, width // parts).transpose(1, 0, 2))


def _round(books: np.ndarray, width: int):
    parts, m, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((parts, m, d), object), np.zeros((parts, m), object)
        for _, _, points in _blocks(batches, width, parts):
            if points.shape[1]:
                _, more, count = nearest(points, books)
                sums, sizes = sums + more.astype(object), sizes + count.astype(object)
        rows = []
        for (part, entry), size in np.ndenumerate(sizes):
            if size:
                rows.append((part, entry, -1, 0, int(size)))
                for place, value in enumerate(sums[part, entry]):
                    digit = 0
                    while not -(1 << 62) < value < 1 << 62:
                        rows.append((part, entry, place, digit, value & ((1 << DIGIT_BITS) - 1)))
                        value, digit = value >> DIGIT_BITS, digit + 1
                    rows.append((part, entry, place, digit, value & ((1 << DIGIT_BITS) - 1)))
                    rows.append((part, entry, place, digit + 1, value >> DIGIT_BITS))
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "entry", "place", "digit", "value"])

    return run


def _code(books: np.ndarray, width: int, schema: pa.Schema):
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, fitting, points in _blocks(batches, width, parts):
            codes, errors = [None] * block.num_rows, [None] * block.num_rows
            if points.shape[1]:
                code, _, _ = nearest(points, books)
                exact = points if _fits(points, books) else points.astype(object)
                away = exact - books[np.arange(parts)[:, None], code]
                error = (away * away).sum(axis=(0, 2)).tolist()
                shown = code.T.astype(np.uint8)
                for k, row in enumerate(np.flatnonzero(fitting).tolist()):
                    codes[row], errors[row] = shown[k].tobytes().hex(), int(error[k]) if error[k] <= _LONG else None
            columns = [block.column("vec_id"), block.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


@dataclass(frozen=True)
class Codebooks:
    """Integer entries (parts, entries, components) for vectors of ``width`` components; ``width`` is 0 if there is none to learn from."""

    entries: np.ndarray
    width: int

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector (doubles) of the rows whose vector is not null and holds finite numbers only."""
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["label"].alias("label"), embeddings["embedding"].cast("array<double>").alias("vector"))
    infinite = float("inf")
    return rows.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite)))


def fitted(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``usable`` rows: the first rows by id, then rounds of assigning and averaging, rounded down.

    Rows of equal id are ordered by their vectors, null ids come last. At most ``entries`` rows, and
    per round a row per component of the codebooks, reach the driver.
    """
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    cuttable = rows.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    head = cuttable.orderBy(*order).select(F.size("vector").alias("width")).first()
    if head is None:
        return Codebooks(np.zeros((parts, 0, 0), object), 0)
    own = cuttable.filter(F.size("vector") == head.width)
    first = own.orderBy(*order).limit(entries).select("vec_id", "vector").orderBy(*order).collect()
    numbers = np.array([[_scaled(x) for x in row.vector] for row in first], object)
    books = _narrow(numbers.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        made = own.mapInArrow(_round(books, head.width), "part int, entry int, place int, digit int, value long")
        totals: dict[tuple[int, int], dict[int, int]] = {}
        for row in made.groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect():
            entry = totals.setdefault((row.part, row.entry), {})
            entry[row.place] = entry.get(row.place, 0) + (row.value << DIGIT_BITS * row.digit)
        moved = books.astype(object)
        for (part, entry), total in totals.items():
            moved[part, entry] = [total[place] // total[-1] for place in range(books.shape[2])]
        books = _narrow(moved)
    return Codebooks(books, head.width)


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """As 64-bit integers where all fit."""
    return numbers.astype(np.int64) if all(abs(x) < 1 << 52 for x in numbers.ravel().tolist()) else numbers


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of ``usable`` rows; both null for vectors of another width than the codebooks'.

    An error beyond a long is null.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    spec = f"vec_id long, label {types['label']}, code string, error long"
    if not books.width:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("vec_id", pa.int64()), ("label", to_arrow_type(rows.schema["label"].dataType)), ("code", pa.string()), ("error", pa.int64())])
    return rows.mapInArrow(_code(books.entries, books.width, schema), spec)


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row.

    Rows whose vector is null or holds null or non-finite components are left out. Repeated rows
    are coded as often as they occur and count so in the means. Fewer rows than entries give
    smaller codebooks. Vectors that can not be cut, or have another width than the first that can, have a
    null code and error, which no label's error counts. Null labels are one label. Extra columns
    are ignored; no rows give no rows.
    """
    rows = written(usable(embeddings), "vectors")
    books = fitted(rows)
    found = written(coded(rows, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = found.groupBy("label").agg(total.try_cast("long").alias("label_error"), F.count("*").alias("n"))
    return joined_by_share(found, labels, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
