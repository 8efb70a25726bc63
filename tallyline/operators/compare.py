"""Two published results, value by value and row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.numbers import checked_sum, wide_sum
from tallyline.operators.product_day import PAGE_ROWS

GROUP = ["observed_date", "stock_code"]
LOCATION_OUT = ["source_file_id", "sheet_name", "source_row_number"]


def _either(base: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both sides under one roof, flagged by side."""
    return base.select(*columns, F.lit(True).alias("in_base")).unionByName(
        current.select(*columns, F.lit(False).alias("in_base"))
    )


def location_diff(base_long: DataFrame, current_long: DataFrame) -> DataFrame:
    """Contributing locations that only one side has, per group.

    One grouped pass over both sides; the file id is part of the location, so a
    changed file marks every group it feeds.
    """
    keys = [*GROUP, *LOCATION_OUT]
    seen = (
        _either(base_long, current_long, keys)
        .groupBy(*keys)
        .agg(F.max("in_base").alias("b"), F.min("in_base").alias("only_base"))
    )
    return seen.filter("b = only_base").select(F.when(F.col("b"), "removed").otherwise("added").alias("change"), *keys)


def location_diff_counts(diff: DataFrame) -> DataFrame:
    """Added and removed locations per group, as counts."""
    return diff.groupBy(*GROUP).agg(
        F.count_if(F.col("change") == "added").alias("added_row_count"),
        F.count_if(F.col("change") == "removed").alias("removed_row_count"),
    )


def nested_location_diff(diff: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Added and removed locations as ordered lists for export, cut into bounded pages."""
    page = F.floor(F.col("source_row_number") / page_rows).cast("bigint").alias("page")
    return diff.groupBy(*GROUP, "change", "source_file_id", "sheet_name", page).agg(
        F.sort_array(F.collect_list("source_row_number")).alias("source_row_numbers")
    )


def _state(metric: str) -> Column:
    return F.when(F.col(metric).isNotNull(), "available").otherwise("not_present")


def compare_rows(base_long: DataFrame, current_long: DataFrame) -> DataFrame:
    """The rows of ``compare_groups``, straight from both sides' contributing rows, each of which is read and moved once.

    Rows of one location and group meet first, which tells whether one side alone has it; their totals are then summed per group.
    """
    keys = [*GROUP, *LOCATION_OUT]
    base, current = F.col("in_base"), ~F.col("in_base")
    seen = _either(base_long, current_long, [*keys, "quantity"]).groupBy(*keys).agg(
        F.count_if(base).alias("base_rows"),
        F.count_if(current).alias("current_rows"),
        wide_sum(F.when(base, F.col("quantity"))).alias("base_sum"),
        wide_sum(F.when(current, F.col("quantity"))).alias("current_sum"),
    )
    groups = seen.groupBy(*GROUP).agg(
        F.sum("base_rows").alias("_base"),
        F.sum("current_rows").alias("_current"),
        checked_sum(F.col("base_sum")).alias("base_sample_quantity_sum"),
        checked_sum(F.col("current_sum")).alias("current_sample_quantity_sum"),
        F.count_if(F.col("base_rows") == 0).alias("added_row_count"),
        F.count_if(F.col("current_rows") == 0).alias("removed_row_count"),
    )
    counted = groups.withColumns({f"{side}_observed_row_count": F.when(F.col(f"_{side}") > 0, F.col(f"_{side}")) for side in ("base", "current")})
    return _compared(counted, F.col("added_row_count"), F.col("removed_row_count"))


def compare_groups(base_day: DataFrame, current_day: DataFrame, diff: DataFrame) -> DataFrame:
    """Both sides' values per group; a side without the group is ``not_present``, not zero.

    A side's files are summed first, so a group is one row however many files feed it.
    """
    sides = {
        name: day.groupBy(*GROUP).agg(
            checked_sum(F.col("sample_quantity_sum")).alias(f"{name}_sample_quantity_sum"),
            F.sum("observed_row_count").alias(f"{name}_observed_row_count"),
        )
        for name, day in (("base", base_day), ("current", current_day))
    }
    both = sides["base"].join(sides["current"], GROUP, "full_outer")
    added = F.coalesce("added_row_count", F.lit(0))
    removed = F.coalesce("removed_row_count", F.lit(0))
    return _compared(both.join(location_diff_counts(diff), GROUP, "left"), added, removed)


def _compared(both: DataFrame, added: Column, removed: Column) -> DataFrame:
    sums = F.col("base_sample_quantity_sum").eqNullSafe(F.col("current_sample_quantity_sum"))
    counts = F.col("base_observed_row_count").eqNullSafe(F.col("current_observed_row_count"))
    return both.select(
        *GROUP,
        _state("base_observed_row_count").alias("base_state"),
        _state("current_observed_row_count").alias("current_state"),
        "base_sample_quantity_sum",
        "current_sample_quantity_sum",
        "base_observed_row_count",
        "current_observed_row_count",
        added.cast("bigint").alias("added_row_count"),
        removed.cast("bigint").alias("removed_row_count"),
        (~(sums & counts) | (added > 0) | (removed > 0)).alias("changed"),
    )


def compare_basis(base_scopes: DataFrame, current_scopes: DataFrame) -> DataFrame:
    """Why two results may differ: one row with seven flags and a code.

    Files, sheets and scopes are compared as sets, so a run may cover many of each.
    """
    columns = ["source_file_id", "sheet_name", "input_scope_id", "aggregation_rule_id", "transformation_rule_id"]
    sides = _either(base_scopes, current_scopes, columns)

    def differs(*keys: str) -> Column:
        seen = sides.groupBy(*keys).agg(F.max("in_base").alias("b"), F.min("in_base").alias("c"))
        return F.coalesce(seen.agg(F.max(F.col("b") == F.col("c"))).scalar(), F.lit(False))

    def rule(name: str, of_base: bool) -> Column:
        return F.max(F.when(F.col("in_base") == of_base, F.col(name)))

    rules = sides.agg(
        rule("aggregation_rule_id", True).alias("base_rule"),
        rule("aggregation_rule_id", False).alias("current_rule"),
        rule("transformation_rule_id", True).alias("base_transformation"),
        rule("transformation_rule_id", False).alias("current_transformation"),
    )
    flags = rules.select(
        differs("source_file_id").alias("source_file_changed"),
        differs("sheet_name").alias("sheet_changed"),
        differs("source_file_id", "sheet_name", "input_scope_id").alias("selection_scope_changed"),
        (~F.col("base_rule").eqNullSafe(F.col("current_rule"))).alias("aggregation_rule_changed"),
        (~F.col("base_transformation").eqNullSafe(F.col("current_transformation"))).alias(
            "transformation_rule_changed"
        ),
        (F.col("base_transformation").isNull() | F.col("current_transformation").isNull()).alias(
            "transformation_rule_unrecorded"
        ),
    )
    elsewhere = F.expr(
        "source_file_changed OR sheet_changed OR aggregation_rule_changed"
        " OR transformation_rule_changed OR transformation_rule_unrecorded"
    )
    return flags.select(
        F.when(elsewhere, "source_sheet_or_rule_changed")
        .when(F.col("selection_scope_changed"), "selection_scope_changed")
        .otherwise("same_input_scope_and_rule")
        .alias("code"),
        "*",
    )


def basis_reasons(basis: DataFrame) -> DataFrame:
    """The criteria that changed or could not be checked, as a list."""
    flag = F.col
    unrecorded, changed = flag("transformation_rule_unrecorded"), flag("transformation_rule_changed")
    reasons = F.array(
        F.when(flag("source_file_changed"), "source file"),
        F.when(flag("sheet_changed"), "sheet"),
        F.when(flag("aggregation_rule_changed"), "aggregation rule"),
        F.when(changed & unrecorded, "transformation rule (an older result recorded none)")
        .when(changed, "transformation rule")
        .when(unrecorded, "transformation rule not recorded"),
        F.when(flag("selection_scope_changed"), "selection scope"),
    )
    return basis.withColumn("changed_criteria", F.array_compact(reasons))
