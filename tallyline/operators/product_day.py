"""Signed quantity per product and day, and the rows behind every number."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from tallyline.functions.numbers import checked_sum, wide_sum
from tallyline.functions.text import contains_text
from tallyline.functions.times import display_ts
from tallyline.schemas import LOCATION

# The rule text is what a run records; change it together with the code below.
AGGREGATION_RULE = """
product day, version 1
rows: typed lines of the run's membership, joined by file, sheet and row number
group: source file, date part of invoice_timestamp, stock_code
sample_quantity_sum: exact signed sum of quantity, refused outside BIGINT
observed_row_count: number of rows
"""

# Rows per page of a nested contribution list. A page is one slice of row numbers of
# one sheet, so its length is bounded by this number however large the group is.
PAGE_ROWS = 65_536


def _observed_date() -> Column:
    return F.to_date("invoice_timestamp").alias("observed_date")


def _run_lines(typed: DataFrame, members: DataFrame, columns: list[str | Column]) -> DataFrame:
    """Join the needed columns of typed lines to membership by location."""
    lines = typed.select(*LOCATION, *columns)
    return lines.join(members.select("run_id", *LOCATION), LOCATION)


def product_day(typed: DataFrame, members: DataFrame) -> DataFrame:
    """One row per run, file, day and product."""
    lines = _run_lines(typed, members, [_observed_date(), "stock_code", "quantity"])
    return lines.groupBy("run_id", "source_file_id", "observed_date", "stock_code").agg(
        checked_sum(F.col("quantity")).alias("sample_quantity_sum"),
        F.count(F.lit(1)).alias("observed_row_count"),
    )


def days_of(contribution_rows: DataFrame) -> DataFrame:
    """Product days summed from contributing rows, where those are there already."""
    return contribution_rows.groupBy("run_id", "source_file_id", "observed_date", "stock_code").agg(
        checked_sum(F.col("quantity")).alias("sample_quantity_sum"),
        F.count(F.lit(1)).alias("observed_row_count"),
    )


def contributions(
    typed: DataFrame,
    members: DataFrame,
    stock_code: str | None = None,
    observed_date: dt.date | str | None = None,
) -> DataFrame:
    """Every contributing row, long form; optionally those of one product or day."""
    if stock_code is not None:
        typed = typed.filter(F.col("stock_code") == stock_code)
    if observed_date is not None:
        typed = typed.filter(F.to_date("invoice_timestamp") == F.lit(observed_date).cast("date"))
    return _run_lines(
        typed,
        members,
        [
            _observed_date(),
            "stock_code",
            "invoice_no",
            "source_cancellation_marker",
            "invoice_no_source_kind",
            "description",
            "quantity",
            display_ts(F.col("invoice_timestamp")).alias("invoice_timestamp"),
            "unit_price_source_text",
            "country",
        ],
    )


def nested_contributions(contribution_rows: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Contribution lists for export, in source-row order, cut into pages.

    A group's list may be arbitrarily long, so each page covers ``page_rows``
    consecutive row numbers of one sheet; pages in order give the whole list.
    """
    item = F.struct(
        "source_row_number",
        "invoice_no",
        "source_cancellation_marker",
        "invoice_no_source_kind",
        "stock_code",
        "description",
        "quantity",
        "invoice_timestamp",
        "unit_price_source_text",
        "country",
    )
    return _paged(contribution_rows, page_rows).agg(F.sort_array(F.collect_list(item)).alias("contributing_rows"))


def _paged(contribution_rows: DataFrame, page_rows: int) -> GroupedData:
    page = F.floor(F.col("source_row_number") / page_rows).cast("bigint")
    return contribution_rows.groupBy("run_id", "source_file_id", "observed_date", "stock_code", "sheet_name", page.alias("page"))


def page_totals(contribution_rows: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Number of rows and exact quantity of the same pages, for readers that do not want the rows themselves."""
    return _paged(contribution_rows, page_rows).agg(
        F.count(F.lit(1)).alias("page_row_count"), wide_sum(F.col("quantity")).alias("page_quantity_sum")
    )


def days_of_pages(pages: DataFrame) -> DataFrame:
    """Product days summed from page totals: the rows of ``days_of``."""
    return pages.groupBy("run_id", "source_file_id", "observed_date", "stock_code").agg(
        checked_sum(F.col("page_quantity_sum")).alias("sample_quantity_sum"), F.sum("page_row_count").alias("observed_row_count")
    )


def independent_product_day(raw: DataFrame, members: DataFrame) -> DataFrame:
    """The same totals straight from raw text, sharing no code with the typed view.

    Quantities are added as decimals and the day is cut from the date text, so an error in
    typing or grouping shows up as a difference. A text with more than 18 decimal places, or a total
    with a fraction, gives a null total, never a rounded one.
    """
    wanted = raw.join(members.select("run_id", *LOCATION), LOCATION)
    plain = F.regexp_replace(F.trim("quantity_raw"), "_", "")
    fits = ~plain.rlike(r"\.[0-9]{18}[0-9]*[1-9]|[eE]-")
    amount = F.when(fits, plain.try_cast("decimal(38,18)"))
    total = F.when(F.count(amount) == F.count(F.lit(1)), F.sum(amount.cast("decimal(38,18)")))
    day = F.make_date(
        F.regexp_extract("invoice_date_raw", r"(\d{4})\D(\d{1,2})\D(\d{1,2})", 1).cast("int"),
        F.regexp_extract("invoice_date_raw", r"(\d{4})\D(\d{1,2})\D(\d{1,2})", 2).cast("int"),
        F.regexp_extract("invoice_date_raw", r"(\d{4})\D(\d{1,2})\D(\d{1,2})", 3).cast("int"),
    )
    return wanted.groupBy(
        "run_id", "source_file_id", day.alias("observed_date"), F.col("stock_code_raw").alias("stock_code")
    ).agg(
        F.when(total % 1 == 0, total.cast("bigint")).alias("sample_quantity_sum"),
        F.count("source_row_number").alias("observed_row_count"),
    )


def quality_summary(day: DataFrame, contribution_rows: DataFrame) -> DataFrame:
    """Per run: rows linked to results, and whether every one carries a marker."""
    totals = day.groupBy("run_id").agg(
        F.sum("observed_row_count").alias("linked_row_count"),
        F.count(F.lit(1)).alias("group_count"),
    )
    marked = contribution_rows.groupBy("run_id").agg(
        F.every(F.col("source_cancellation_marker").isNotNull()).alias("marker_recorded")
    )
    return totals.join(marked, "run_id", "left")


def product_search(day: DataFrame, text: str) -> DataFrame:
    """Groups whose product code holds the text, ignoring case; none is absent, not zero."""
    return day.filter(contains_text(F.col("stock_code"), text))


def marker_label(contribution_rows: DataFrame) -> DataFrame:
    """Readable marker; rows of results that never recorded one say so."""
    marker = F.col("source_cancellation_marker")
    return contribution_rows.withColumn(
        "marker_label",
        F.when(marker.isNull(), "not computed")
        .when(marker == "true", "cancellation prefix observed")
        .when(marker == "false", "no cancellation prefix observed")
        .otherwise("unknown"),
    )
