"""Trust in stream progress: compare the broker's position with the ledger's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_verdicts(
    positions: DataFrame,
    checkpoint: DataFrame,
    ledger_rows: int | None = 0,
    max_ahead: int = 1,
    single_partition: bool = False,
) -> DataFrame:
    """Verdict per stream: ``reason`` is null when reading may start at ``start_offset``.

    Fails closed; the first matching reason wins. A stream that is not bound yet needs
    an empty ledger (``ledger_rows``), a log that starts at zero and a group that has
    not advanced. A bound one may be at most ``max_ahead`` offsets ahead of the group:
    one where each delivery is committed on its own, a batch where batches are.
    """
    bound = checkpoint.select(
        "topic",
        "partition",
        F.col("cluster_id").alias("bound_cluster_id"),
        F.col("group_id").alias("bound_group_id"),
        "durable_next_offset",
    )
    joined = positions.join(bound, ["topic", "partition"], "left")
    low, high, broker, nxt = (F.col(c) for c in ("low", "high", "broker_committed", "durable_next_offset"))
    other_partition = F.col("partition") != 0 if single_partition else F.lit(False)
    unbound = nxt.isNull()
    differs = (F.col("cluster_id") != F.col("bound_cluster_id")) | (F.col("group_id") != F.col("bound_group_id"))
    reason = (
        F.when(F.col("cluster_id").isNull() | (F.col("cluster_id") == ""), "missing_cluster_id")
        .when(other_partition, "unsupported_partition")
        .when((low < 0) | (high < low), "invalid_watermarks")
        .when(unbound & F.lit(bool(ledger_rows)), "ledger_without_checkpoint")
        .when(unbound & (low != 0), "log_does_not_start_at_zero")
        .when(unbound & (broker > 0), "empty_ledger_but_group_advanced")
        .when(differs, "different_stream")
        .when(low > nxt, "log_begins_after_checkpoint")
        .when(broker > nxt, "group_ahead_of_ledger")
        .when(high < nxt, "log_ends_before_checkpoint")
        .when((broker < 0) & (nxt > max_ahead), "uncommitted_group_too_far_behind")
        .when((broker >= 0) & (nxt - broker > max_ahead), "ledger_too_far_ahead")
    )
    caught_up = (broker >= high) | ((high == 0) & (F.coalesce(nxt, F.lit(0)) == 0) & (broker < 0))
    return joined.select(
        "cluster_id",
        "group_id",
        "topic",
        "partition",
        reason.alias("reason"),
        F.when(reason.isNull(), F.coalesce(nxt, F.lit(0))).cast("bigint").alias("start_offset"),
        F.when(reason.isNull(), caught_up).alias("caught_up"),
    )
