"""Dates and instants. Event dates come from UTC text, never from the session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A full UTC instant with up to six fraction digits.
UTC_INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z\z"

_DATE_LED = r"^\s*[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])"


def invoice_ts(text: Column) -> Column:
    """Zone-free timestamp of an invoice date text, or null.

    A full date is required (a bare year or month is not one); slashes and dashes are both
    accepted; the wall-clock part is kept as it stands.
    """
    return F.when(text.rlike(_DATE_LED), F.translate(text, "/", "-").try_cast("timestamp_ntz"))


def is_utc_instant(text: Column) -> Column:
    """True for the shape of a full UTC instant; the calendar is checked by :func:`utc_instant`."""
    return text.rlike(UTC_INSTANT)


def utc_instant(text: Column) -> Column:
    """Timestamp of a full UTC instant, null for a wrong shape or an impossible date."""
    return F.when(is_utc_instant(text) & ~text.startswith("0000"), text.try_cast("timestamp"))


def utc_date(text: Column) -> Column:
    """UTC calendar day of an instant text ending in Z: its first ten characters."""
    return F.substring(text, 1, 10).try_cast("date")


def display_ts(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with the fraction cut off, for zone-free timestamps and instants."""
    return F.substring(ts.cast("string"), 1, 19)


def completion(completed_at: Column, started_at: Column) -> Column:
    """A run never completes before it started, whatever the clock did."""
    return F.greatest(completed_at, started_at)
