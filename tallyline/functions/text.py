"""Text rules: blanks, invoice markers, source kinds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The only characters removed before the marker is read.
MARKER_BLANKS = " \t\r\n"

# Unicode white space, plus the four ASCII separators that also count as blank.
_BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def is_blank(text: Column) -> Column:
    """True when nothing but white space is left; null stays null."""
    return text.rlike(_BLANK)


def cancellation_marker(text: Column, kind: Column) -> Column:
    """``true`` / ``false`` / ``unknown`` from the invoice text and its cell kind.

    ``false`` says that no prefix was seen, not that a sale took place.
    """
    seen = F.btrim(text, F.lit(MARKER_BLANKS))
    not_observable = kind.isNull() | kind.isin("missing", "unsupported") | text.isNull()
    return (
        F.when(not_observable | (seen == ""), "unknown")
        .when(F.substring(seen, 1, 1).isin("C", "c"), "true")
        .otherwise("false")
    )


def source_kind(value: Column, cell_type: Column) -> Column:
    """Kind of an invoice cell: missing, text, integer or unsupported.

    ``cell_type`` is what the sheet reader saw: empty, text, integer, float,
    boolean, datetime or error.
    """
    whole = value.try_cast("double") % 1 == 0
    return (
        F.when(value.isNull() | (cell_type == "empty"), "missing")
        .when(cell_type == "text", "text")
        .when(cell_type == "integer", "integer")
        .when((cell_type == "float") & whole, "integer")
        .otherwise("unsupported")
    )


def raw_text(value: Column, cell_type: Column) -> Column:
    """Cell text as landed: null stays null, date-times print with a blank between parts."""
    return F.when(cell_type == "empty", None).when(
        cell_type == "datetime", F.regexp_replace(value, "T", " ")
    ).otherwise(value)


def contains_text(column: Column, wanted: str) -> Column:
    """Case-insensitive literal substring match on trimmed search text."""
    return F.upper(column).contains(wanted.strip().upper())
