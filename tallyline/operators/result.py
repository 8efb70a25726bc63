"""The published document of a run: one header and many product lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.operators.contracts import assert_no_columns
from tallyline.operators.product_day import AGGREGATION_RULE
from tallyline.operators.typed import TRANSFORMATION_RULE


def _texts(**entries: str) -> Column:
    return F.struct(*[F.lit(text).alias(name) for name, text in entries.items()])


def result_header(scopes: DataFrame, runs: DataFrame, manifests: DataFrame, member_counts: DataFrame) -> DataFrame:
    """One row per run and sheet: what was read, by which rules, and what is not claimed.

    The selected rows themselves stay in the membership table; the header holds
    their fingerprint and number.
    """
    return (
        scopes.join(runs.select("run_id", "status", "completed_at"), "run_id")
        .join(member_counts.select("run_id", "source_file_id", "sheet_name", "selected_row_count"),
              ["run_id", "source_file_id", "sheet_name"], "left")
        .join(manifests, ["source_file_id"], "left")
        .select(
            F.lit("complete_for_selected_rows").alias("result_state"),
            "run_id",
            F.struct("status", "completed_at").alias("run"),
            F.struct(
                "dataset", "source_url", "source_file_id", "sheet_name", "selected_row_count",
                "input_scope_id", "scope_note",
            ).alias("source"),
            _texts(
                sample_quantity_sum="signed quantity over the selected rows only",
                observed_row_count="selected rows in the group",
                date_basis="date part of the invoice date as the source shows it",
                not_claimed="completeness for a day or file; sales, refunds or revenue; business duplicates",
            ).alias("metric_contract"),
            "aggregation_rule_id",
            "transformation_rule_id",
            _texts(
                source_field="InvoiceNo",
                true="the observed invoice text starts with C or c",
                false="no such prefix was seen; that does not confirm a sale",
                unknown="no invoice text could be observed",
                not_claimed="link to an original transaction, refund, payment or discount",
            ).alias("source_cancellation_marker_contract"),
            F.lit(TRANSFORMATION_RULE.strip()).alias("applied_transformation_rule"),
            F.lit(AGGREGATION_RULE.strip()).alias("applied_rule_text"),
        )
    )


def result_products(day: DataFrame, pages: DataFrame) -> DataFrame:
    """Product lines with their totals, one row per page of contributing rows."""
    keys = ["run_id", "source_file_id", "observed_date", "stock_code"]
    # A product is never null here: a gate refuses such rows before any result is built.
    lines = day.join(pages, keys).withColumn("data_state", F.lit("available"))
    return assert_no_columns(lines, ["customer"])
