"""Reconciliation by a tree of digests: what is equal is never moved.

Rows fall into hash buckets. A bucket's digest is the number of its rows and two sums of row hashes, so
neither order nor partitioning matters, and a parent's digest is the sum of its children's. Two
sides compare their roots, then the children of nodes that differ; only the rows of differing
leaves are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.operators.reconcile import reconcile

LEVELS = 3
FAN_BITS = 4
_DIGEST = ["rows", "first_sum", "second_sum"]


def _leaf(columns: list[str], levels: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("leaf"), *columns), F.lit(1 << FAN_BITS * levels))


def digest_tree(rows: DataFrame, columns: list[str], levels: int = LEVELS) -> DataFrame:
    """level, node, rows, first_sum and second_sum of every node that has rows; the root is level 0, node 0.

    Leaves are counted where the rows lie; what is shuffled are at most 16^levels digests a task.
    """
    hashes = [F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)") for seed in ("first", "second")]
    leaves = rows.groupBy(_leaf(columns, levels).alias("leaf")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(hashes[0]).alias("first_sum"), F.sum(hashes[1]).alias("second_sum")
    )
    every = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    node = F.expr(f"shiftright(leaf, {FAN_BITS} * ({levels} - level))")
    return every.groupBy("level", node.alias("node")).agg(*[F.sum(c).alias(c) for c in _DIGEST])


def differing_leaves(left: DataFrame, right: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves of two trees that do not agree: node, from the root down through nodes that differ."""
    both = left.join(right.select("level", "node", *[F.col(c).alias(f"_{c}") for c in _DIGEST]), ["level", "node"], "full_outer")
    apart = both.filter(~_same()).select("level", "node")
    found = apart.filter("level = 0").select("node")
    for level in range(1, levels + 1):
        below = apart.filter(F.col("level") == level).select("node")
        parents = found.select(F.col("node").alias("_parent"))
        found = below.join(parents, F.shiftright("node", FAN_BITS) == F.col("_parent"), "left_semi")
    return found


def _same() -> Column:
    same = F.lit(True)
    for c in _DIGEST:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return same


def reconcile_by_digest(left: DataFrame, right: DataFrame, columns: list[str], levels: int = LEVELS) -> DataFrame:
    """The rows of ``reconcile``, of which only those in differing leaves take part; equal sides move digests alone.

    At most 16^levels node numbers reach the driver, none if the sides agree.
    """
    leaves = differing_leaves(digest_tree(left, columns, levels), digest_tree(right, columns, levels), levels)
    opened = [row.node for row in leaves.collect()]
    inside = _leaf(columns, levels).isin(opened)
    return reconcile(left.filter(inside), right.filter(inside), columns)
