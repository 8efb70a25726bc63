"""Exact integers: lossless parsing and sums that never wrap."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Decimal or exponent notation, single underscores between digits. The look-ahead refuses
# texts whose value has a fraction too fine for decimal(38,18): a digit past the 18th place,
# a fraction under a negative exponent, or a shift by more than 18 places.
_NOTATION = (
    r"^\s*[+-]?"
    r"(?![0-9_]*\.[0-9_]{18}[0-9_]*[1-9]|[0-9_]*\.[0-9_]*[1-9][0-9_]*[eE]-|[0-9_.]+[eE]-(?:19|[2-9][0-9]|[0-9]{3,}))"
    r"(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?\s*$"
)


def _from_notation(text: Column) -> Column:
    """BIGINT of a decimal or exponent notation, null when it has a fraction."""
    value = F.replace(text, F.lit("_"), F.lit("")).try_cast("decimal(38,18)")
    return F.when(text.rlike(_NOTATION) & (value % 1 == 0), value.try_cast("bigint"))


def lossless_bigint(text: Column) -> Column:
    """BIGINT value of a text, or null when it is not exactly one.

    ``6``, ``6.0``, ``1e3`` and ``1_000`` are whole numbers; ``1.5``, ``0x10`` and
    anything outside the BIGINT range are not. Plain digits take the direct cast.
    """
    return F.coalesce(text.try_cast("bigint"), _from_notation(text))


def wide_sum(quantity: Column) -> Column:
    """Exact sum of BIGINT values, wider than BIGINT."""
    return F.sum(quantity.cast("decimal(38,0)")).cast("decimal(38,0)")


def checked_sum(quantity: Column) -> Column:
    """Exact sum returned as BIGINT; a total that does not fit fails the job."""
    return wide_sum(quantity).cast("bigint")
