"""The line-item table read as raw transaction rows.

Every raw row is made from one table row, so the view has as many rows as the table.
Its file is the table file, its sheet the shipping month, its row number the place in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.operators.landing import select_rows
from tallyline.sources.tables import located_parquet

ALL_ROWS_RUN = "run-all"
KEPT_ROWS_RUN = "run-without-returns"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located_parquet(spark, f"{sf_dir}/lineitem.parquet")


def _sheet() -> Column:
    return F.substring(F.col("l_shipdate").cast("string"), 1, 7)


def _location() -> list[Column]:
    return [
        F.col("source_file_name").alias("source_file_id"),
        _sheet().alias("sheet_name"),
        F.col("source_row_number"),
    ]


def _invoice(residue: Column) -> tuple[Column, Column]:
    """Invoice text and kind: mostly numbers, returns with a marker, and every odd shape."""
    order = F.col("l_orderkey").cast("string")
    returned = F.col("l_returnflag") == "R"
    text = (
        F.when(residue == 0, None)
        .when(residue == 1, "   ")
        .when(residue == 2, "True")
        .when(residue == 3, F.concat(F.lit("\tC"), order, F.lit("\n")))
        .when(residue == 4, F.concat(F.lit("\u00a0C"), order))
        .when(returned, F.concat(F.lit(" c"), order))
        .otherwise(order)
    )
    kind = (
        F.when(residue == 0, "missing")
        .when(residue == 2, "unsupported")
        .when(residue == 5, None)
        .when(returned | (residue < 5), "text")
        .otherwise("integer")
    )
    return text, kind


def _units() -> Column:
    return F.col("l_quantity").cast("bigint")


def _clean_quantity(residue: Column) -> Column:
    """Signed whole numbers, some in decimal or exponent notation."""
    units = _units()
    signed = F.when(F.col("l_returnflag") == "R", -units).otherwise(units).cast("string")
    return F.when(residue == 6, F.concat(signed, F.lit(".0"))).when(
        residue == 7, F.concat(signed, F.lit("e0"))
    ).otherwise(signed)


def _dirty_quantity(residue: Column) -> Column:
    units = _units().cast("string")
    return (
        F.when(residue == 10, F.concat(units, F.lit(".5")))
        .when(residue == 11, "abc")
        .when(residue == 12, None)
        .when(residue == 13, "9223372036854775808")
        .when(residue == 14, F.concat(units, F.lit(".0000000000000000001")))
        .when(residue == 15, F.concat(units, F.lit("e3")))
        .when(residue == 16, "9223372036854775807")
        .when(residue == 17, F.concat(F.lit("0x"), units))
        .otherwise(_clean_quantity(residue))
    )


def _raw(rows: DataFrame, dirty: bool) -> DataFrame:
    residue = F.col("l_orderkey") % 97
    text, kind = _invoice(residue)
    day = F.col("l_shipdate").cast("string")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    product = F.concat(F.lit("P"), (F.col("l_partkey") % 8).cast("string"))
    if dirty:
        day = F.when(residue == 20, F.substring(day, 1, 7)).when(
            residue == 21, F.regexp_replace(day, "-", "/")
        ).otherwise(day)
        price = F.when(residue == 22, None).otherwise(price)
        product = F.when(residue == 23, None).otherwise(product)
    return rows.select(
        *_location(),
        text.alias("invoice_no_raw"),
        kind.alias("invoice_no_source_kind"),
        product.alias("stock_code_raw"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("description_raw"),
        (_dirty_quantity(residue) if dirty else _clean_quantity(residue)).alias("quantity_raw"),
        day.alias("invoice_date_raw"),
        price.alias("unit_price_raw"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("customer_id_raw"),
        F.concat(F.lit("NATION_"), (F.col("l_suppkey") % 25).cast("string")).alias("country_raw"),
        F.col("l_shipdate").cast("timestamp").alias("loaded_at"),
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows that pass every gate."""
    return _raw(lineitem(spark, sf_dir), dirty=False)


def dirty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with lossy quantities and missing fields among them."""
    return _raw(lineitem(spark, sf_dir), dirty=True)


def members_all(spark: SparkSession, sf_dir: str, run_id: str = ALL_ROWS_RUN) -> DataFrame:
    """Membership of a run over every row."""
    return select_rows(lineitem(spark, sf_dir).select(*_location()), None, run_id)


def members_kept(spark: SparkSession, sf_dir: str, run_id: str = KEPT_ROWS_RUN) -> DataFrame:
    """Membership of a run that leaves returned lines out."""
    kept = lineitem(spark, sf_dir).filter("l_returnflag <> 'R'")
    return select_rows(kept.select(*_location()), None, run_id)


def members_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members_all(spark, sf_dir).unionByName(members_kept(spark, sf_dir))
