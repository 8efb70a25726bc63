"""Row-set checks that gate a run. Each returns the violations; empty means pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tallyline.errors import ContractViolation
from tallyline.schemas import LOCATION, SHEET_HEADER

def selection_violations(selection: DataFrame) -> DataFrame:
    """Selected row numbers below the first data row, missing, or given twice for one run."""
    keys = ["run_id", "source_file_id", "sheet_name", "source_row_number"]
    counted = selection.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    reason = (
        F.when(F.col("source_row_number").isNull(), "not_a_row_number")
        .when(F.col("source_row_number") < 2, "not_a_data_row")
        .when(F.col("times") > 1, "duplicate")
    )
    return counted.withColumn("reason", reason).filter("reason IS NOT NULL").select(*keys, "times", "reason")


def header_violations(sheet_rows: DataFrame) -> DataFrame:
    """Sheets whose first row is not exactly the eight expected names, in order."""
    expected = F.array(*[F.lit(name) for name in SHEET_HEADER])
    found = F.slice("cells", 1, len(SHEET_HEADER))
    return sheet_rows.filter(
        (F.col("source_row_number") == 1) & ~F.coalesce(found == expected, F.lit(False))
    ).select("source_file_id", "sheet_name", found.alias("found_header"))


def fingerprint_violations(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Files whose bytes are not the ones their manifest promised.

    A file without a manifest, a manifest without a file, and a missing fingerprint on either
    side are violations too.
    """
    differs = ~F.coalesce(F.col("sha256") == F.col("expected_sha256"), F.lit(False))
    return (
        files.select("original_file_name", "sha256")
        .join(manifests.select("original_file_name", "expected_sha256"), "original_file_name", "full_outer")
        .filter(differs)
        .select("original_file_name", "expected_sha256", F.col("sha256").alias("actual_sha256"))
    )


def count_mismatch(members: DataFrame, expected: DataFrame) -> DataFrame:
    """Runs whose membership does not hold the expected number of rows."""
    actual = members.groupBy("run_id").agg(F.count(F.lit(1)).alias("actual_count"))
    return (
        expected.select("run_id", "expected_count")
        .join(actual, "run_id", "full_outer")
        .select(
            "run_id",
            F.coalesce("expected_count", F.lit(0)).cast("bigint").alias("expected_count"),
            F.coalesce("actual_count", F.lit(0)).alias("actual_count"),
        )
        .filter("expected_count <> actual_count")
    )


def typed_violations(typed: DataFrame, members: DataFrame) -> DataFrame:
    """Both typed-row gates in one pass: every run row with its first reason, if any.

    A quantity that is not exactly a BIGINT comes before a missing product, date or price.
    """
    null_field = (
        F.col("stock_code").isNull()
        | F.col("invoice_timestamp").isNull()
        | F.col("unit_price_source_text").isNull()
    )
    reason = F.when(F.col("quantity").isNull(), "quantity_not_lossless").when(null_field, "typed_field_missing")
    flagged = typed.select(*LOCATION, "quantity_source_text", reason.alias("reason")).filter("reason IS NOT NULL")
    return flagged.join(members.select("run_id", *LOCATION), LOCATION)


def lossy_quantities(typed: DataFrame, members: DataFrame) -> DataFrame:
    """Run rows whose quantity text is not exactly one BIGINT value."""
    flagged = typed.filter("quantity IS NULL").select(*LOCATION, "quantity_source_text")
    return flagged.join(members.select("run_id", *LOCATION), LOCATION)


def null_typed(typed: DataFrame, members: DataFrame) -> DataFrame:
    """Run rows without a product, a date or a price text."""
    flagged = typed.filter(
        "stock_code IS NULL OR invoice_timestamp IS NULL OR unit_price_source_text IS NULL"
    ).select(*LOCATION)
    return flagged.join(members.select("run_id", *LOCATION), LOCATION)


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that are null or occur more than once."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    return (
        counted.withColumn("reason", F.when(any_null, "null_key").when(F.col("times") > 1, "duplicate_key"))
        .filter("reason IS NOT NULL")
    )


def domain_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is null or outside the allowed list."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def _all_names(schema: StructType) -> list[str]:
    names: list[str] = []
    for field in schema.fields:
        names.append(field.name)
        inner = getattr(field.dataType, "elementType", field.dataType)
        if isinstance(inner, StructType):
            names.extend(_all_names(inner))
    return names


def assert_no_columns(df: DataFrame, fragments: list[str]) -> DataFrame:
    """Refuse a result whose schema, at any depth, names a forbidden column."""
    found = [n for n in _all_names(df.schema) if any(f in n.lower() for f in fragments)]
    if found:
        raise ContractViolation(f"result exposes: {', '.join(found)}")
    return df


def require_empty(violations: DataFrame, message: str, folder: str | None = None) -> None:
    """Fail when there is a violation; with ``folder``, every one of them is kept there first, as JSON lines.

    The error names the number of violations, the smallest one and the folder.
    """
    if violations.isEmpty():
        return
    if folder is not None:
        violations.write.mode("overwrite").json(folder)
        violations = violations.sparkSession.read.schema(violations.schema).json(folder)
    told = violations.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("*")).alias("first")).first()
    shown = ", ".join(f"{k}={v}" for k, v in told["first"].asDict().items() if v is not None)
    raise ContractViolation(f"{message}: {told['n']} violations, first: {shown}" + (f"; all in {folder}" if folder else ""))
