"""Raw rows to typed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.functions.numbers import lossless_bigint
from tallyline.functions.text import cancellation_marker
from tallyline.functions.times import invoice_ts

# The rule text is what a run records; change it together with the code below.
TRANSFORMATION_RULE = """
typed lines, version 1
invoice_no: source text, unchanged
source_cancellation_marker: unknown without an observable invoice text; true when the text,
  stripped of space, tab, CR and LF, starts with C or c; else false
quantity: exact BIGINT of the source text, else null
invoice_timestamp: zone-free timestamp led by a full date, else null
unit_price: source text, unchanged
customer id: not carried
"""


def typed_lines(raw: DataFrame) -> DataFrame:
    """Typed view of landed rows. The customer id stays behind."""
    invoice, kind = F.col("invoice_no_raw"), F.col("invoice_no_source_kind")
    return raw.select(
        "source_file_id",
        "sheet_name",
        "source_row_number",
        invoice.alias("invoice_no"),
        cancellation_marker(invoice, kind).alias("source_cancellation_marker"),
        kind,
        F.col("stock_code_raw").alias("stock_code"),
        F.col("description_raw").alias("description"),
        F.col("quantity_raw").alias("quantity_source_text"),
        lossless_bigint(F.col("quantity_raw")).alias("quantity"),
        invoice_ts(F.col("invoice_date_raw")).alias("invoice_timestamp"),
        F.col("unit_price_raw").alias("unit_price_source_text"),
        F.col("country_raw").alias("country"),
    )
