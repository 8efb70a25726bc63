"""Explicit schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _TS, _D = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.DateType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# The workbook's header row, in order.
SHEET_HEADER = (
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "UnitPrice",
    "CustomerID",
    "Country",
)

# A location names one source row. Row number leads where the columns are used
# as join or sort keys: it is the selective one, and a long sorts by prefix.
LOCATION = ["source_row_number", "sheet_name", "source_file_id"]

RAW_ROWS = _struct(
    ("source_file_id", _S),
    ("sheet_name", _S),
    ("source_row_number", _L),
    ("invoice_no_raw", _S),
    ("invoice_no_source_kind", _S),
    ("stock_code_raw", _S),
    ("description_raw", _S),
    ("quantity_raw", _S),
    ("invoice_date_raw", _S),
    ("unit_price_raw", _S),
    ("customer_id_raw", _S),
    ("country_raw", _S),
    ("loaded_at", _TS),
)

SHEET_ROWS = _struct(
    ("source_file_id", _S),
    ("source_path", _S),
    ("sheet_name", _S),
    ("source_row_number", _L),
    ("cells", T.ArrayType(_S)),
    ("cell_types", T.ArrayType(_S)),
    ("error", _S),
)

# The keys of a manifest.
MANIFEST = _struct(
    ("dataset", _S),
    ("source_url", _S),
    ("expected_sha256", _S),
    ("sheet", _S),
    ("selected_excel_rows", T.ArrayType(_L)),
    ("scope_note", _S),
)
MANIFEST_KEYS = [field.name for field in MANIFEST.fields]

SOURCE_FILES = _struct(
    ("source_file_id", _S),
    ("sha256", _S),
    ("original_file_name", _S),
    ("source_url", _S),
    ("stored_path", _S),
    ("workbook_sheet", _S),
    ("registered_at", _TS),
)

MEMBERS = _struct(
    ("run_id", _S),
    ("source_file_id", _S),
    ("sheet_name", _S),
    ("source_row_number", _L),
)

SCOPES = _struct(
    ("run_id", _S),
    ("source_file_id", _S),
    ("sheet_name", _S),
    ("input_scope_id", _S),
    ("aggregation_rule_id", _S),
    ("transformation_rule_id", _S),
)

# Append-only. A run's state is its newest event; a publication is the event that
# carries ``publish_seq``, so success and publication are one appended row.
RUN_EVENTS = _struct(
    ("run_id", _S),
    ("event_seq", _L),
    ("status", _S),
    ("at", _TS),
    ("source_file_id", _S),
    ("input_path", _S),
    ("error_message", _S),
    ("recovered_at", _TS),
    ("recovery_reason", _S),
    ("recovered_artifact_path", _S),
    ("publish_seq", _L),
)

PUBLICATIONS = _struct(("run_id", _S), ("publish_seq", _L), ("published_at", _TS))

CONSUMER_STATUSES = ["running", "succeeded", "failed", "interrupted"]
PROCESSED = ["accepted", "redelivery"]

PRODUCT_DAY = _struct(
    ("run_id", _S),
    ("source_file_id", _S),
    ("observed_date", _D),
    ("stock_code", _S),
    ("sample_quantity_sum", _L),
    ("observed_row_count", _L),
)

ENVELOPE = _struct(
    ("topic", _S),
    ("partition", _I),
    ("offset", _L),
    ("key", _S),
    ("value", _S),
)

# The field names of events and of delivery plans.
EVENT_FIELDS = ["event_id", "occurred_at", "product_code", "quantity"]
PLAN_FIELDS = ["delivery_id", "event_id", "phase"]

# One row per delivery attempt as the stream wrote it, before the marker decides
# whether and how far the batch counts.
ATTEMPTS = _struct(
    ("topic", _S),
    ("partition", _I),
    ("kafka_offset", _L),
    ("event_id", _S),
    ("payload_sha256", _S),
    ("payload_json", _S),
    ("product_code", _S),
    ("occurred_at", _TS),
    ("observed_date", _D),
    ("quantity", _L),
    ("existing_payload_sha256", _S),
    ("reason", _S),
    ("observed_at", _TS),
    ("run_id", _S),
    ("batch_id", _L),
    ("disposition", _S),
)

MARKERS = _struct(
    ("run_id", _S),
    ("batch_id", _L),
    ("batch_seq", _L),
    ("topic", _S),
    ("partition", _I),
    ("stop_offset", _L),
    ("next_offset", _L),
    ("status", _S),
    ("committed_at", _TS),
    ("cluster_id", _S),
    ("group_id", _S),
)

# Generations of the index of accepted events: batches from low_seq to high_seq.
GENERATIONS = _struct(
    ("generation", _S),
    ("level", _I),
    ("buckets", _I),
    ("events", _L),
    ("low_seq", _L),
    ("high_seq", _L),
)

KNOWN_EVENTS = _struct(
    ("event_id", _S),
    ("topic", _S),
    ("partition", _I),
    ("payload_sha256", _S),
    ("bucket", _I),
)

DISPOSITIONS = _struct(
    ("topic", _S),
    ("partition", _I),
    ("kafka_offset", _L),
    ("event_id", _S),
    ("payload_sha256", _S),
    ("existing_payload_sha256", _S),
    ("disposition", _S),
    ("reason", _S),
)

DAILY_VERSIONS = _struct(
    ("observed_date", _D),
    ("product_code", _S),
    ("signed_quantity_sum", T.DecimalType(38, 0)),
    ("unique_event_count", _L),
    ("version", _L),
)

# One row per part of a version of a document.
DOCUMENT_MANIFEST = _struct(
    ("run_id", _S),
    ("version", _S),
    ("seq", _L),
    ("part", _S),
    ("schema_json", _S),
    ("rows", _L),
)

# Lines of a delivery log; topic, partition and segment are folders.
LOG_LINES = _struct(
    ("offset", _L),
    ("value", _S),
    ("topic", _S),
    ("partition", _I),
    ("segment", _L),
)
