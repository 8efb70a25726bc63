"""What a run was asked to compute: fingerprints of its rows and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.identity import sha256_id

# Each level folds at most this many entries into one digest, so three levels
# cover 2^48 row numbers and no list ever grows with the data.
FANOUT_BITS = 16


def _digest(items: str) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def scope_ids(members: DataFrame) -> DataFrame:
    """Order-free fingerprint of the selected rows of each run, file and sheet.

    Row numbers are hashed in slices of 65,536, the slice digests in slices of
    65,536, and those once more; equal sets get equal ids at every size.
    """
    keys = ["run_id", "source_file_id", "sheet_name"]
    slices = (
        members.groupBy(*keys, F.shiftright("source_row_number", FANOUT_BITS).alias("slot"))
        # A set, not a list: repeated members can not grow a slice past its width.
        .agg(F.sort_array(F.collect_set("source_row_number")).alias("rows"))
        .select(*keys, "slot", F.size("rows").cast("bigint").alias("row_count"), _digest("rows").alias("digest"))
    )
    counted = slices.groupBy(*keys, F.shiftright("slot", FANOUT_BITS).alias("parent")).agg(
        F.sort_array(F.collect_list(F.struct("slot", "digest"))).alias("children"),
        F.sum("row_count").alias("row_count"),
    )
    second = counted.select(
        *keys, F.col("parent").alias("slot"), "row_count", _children_digest().alias("digest")
    )
    top = second.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("slot", "digest"))).alias("children"),
        F.sum("row_count").alias("selected_row_count"),
    )
    named = F.concat_ws("|", "source_file_id", "sheet_name", _children_digest())
    return top.select(*keys, sha256_id(named).alias("input_scope_id"), "selected_row_count")


def _children_digest() -> Column:
    """Digest over ordered ``slot:digest`` entries."""
    entry = F.transform("children", lambda c: F.concat_ws(":", c["slot"].cast("string"), c["digest"]))
    return F.sha2(F.array_join(entry, ","), 256)


def with_rule_defaults(results: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Fill ids that older results never recorded.

    The aggregation rule is recomputed from the rule text kept with the result and
    the scope from recomputed ``scopes``; a missing transformation rule stays null.
    """
    filled = results.withColumn(
        "aggregation_rule_id",
        F.coalesce("aggregation_rule_id", sha256_id(F.trim("applied_rule_text"))),
    )
    if scopes is None:
        return filled
    recomputed = scopes.select("run_id", F.col("input_scope_id").alias("_scope"))
    return (
        filled.join(recomputed, "run_id", "left")
        .withColumn("input_scope_id", F.coalesce("input_scope_id", "_scope"))
        .drop("_scope")
    )


def row_diff(members: DataFrame, base_run: str, current_run: str) -> DataFrame:
    """Selected rows added or removed between two runs over the same file and sheet.

    Sheets that only one of the runs touches are another source, not a changed selection,
    and give no rows.
    """
    sides = members.filter(F.col("run_id").isin(base_run, current_run))
    per_row = sides.groupBy("source_file_id", "sheet_name", "source_row_number").agg(
        F.max(F.col("run_id") == base_run).alias("in_base"),
        F.max(F.col("run_id") == current_run).alias("in_current"),
    )
    per_sheet = (
        sides.groupBy("source_file_id", "sheet_name")
        .agg(
            F.max(F.col("run_id") == base_run).alias("b"),
            F.max(F.col("run_id") == current_run).alias("c"),
        )
        .filter("b AND c")
        .select("source_file_id", "sheet_name")
    )
    changed = per_row.filter("in_base <> in_current")
    return changed.join(per_sheet, ["source_file_id", "sheet_name"], "left_semi").select(
        F.when(F.col("in_current"), "added").otherwise("removed").alias("change"),
        "source_file_id",
        "sheet_name",
        "source_row_number",
    )
