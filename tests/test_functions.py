from decimal import Decimal, InvalidOperation

import duckdb
import pytest
from pyspark.sql import functions as F
from samples import INVOICES, expected_marker

from tallyline.functions.numbers import checked_sum, lossless_bigint, wide_sum
from tallyline.functions.text import cancellation_marker, contains_text, is_blank, source_kind
from tallyline.functions.times import completion, display_ts, invoice_ts, utc_date, utc_instant


def column_of(spark, texts, expr):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("t"))).collect()]


NUMBERS = [
    "6", "+6", "-6", " 6 ", "6.0", "6.", ".0", "0.", "1e3", "1E3", "1e+16", "1e-1", "10e-1", "120e-1", "1_000", "_1",
    "1_", "1__0", "1_0.0", "0x10", "1.5", "abc", "", "  ", "9223372036854775807", "9223372036854775808",
    "-9223372036854775808", "-9223372036854775809", "9223372036854775807.0", "9.223372036854775807e18",
    "922337203685477580.7e1", "6.0000000000000000001", "6.00000000000000000000000", "60000000000000000000e-19",
    "4e-19", "1e18", "1e19", "NaN", "Infinity", "1e", "e5", "1 000", "--1", "1.0e3", "1.5e1", "15e-1", "1e05", "0.0",
    "-0", "-0.0", "٣", "5.e1", "12e0", "0b1", "1f", "1d", "1L", "100e-2", "\t7\n", "100.00000000000000001e-2", None,
]


def exact_integer(text):
    """The rule stated twice over: an exact decimal, and another engine's cast."""
    cast = duckdb.execute("SELECT TRY_CAST(? AS BIGINT)", [text]).fetchone()[0]
    try:
        value = Decimal(text)
        whole = value.is_finite() and value == value.to_integral_value()
        return cast if whole and cast is not None and value == Decimal(cast) else None
    except (InvalidOperation, TypeError):
        return None


def test_lossless_integers_agree_with_exact_decimals(spark):
    assert column_of(spark, NUMBERS, lossless_bigint) == [exact_integer(t) for t in NUMBERS]


def test_wide_sum_passes_bigint_and_checked_sum_refuses(spark):
    top = spark.range(2).select(F.lit(2**63 - 1).alias("q"))
    assert top.agg(wide_sum(F.col("q"))).first()[0] == Decimal(2 * (2**63 - 1))
    with pytest.raises(Exception, match="OVERFLOW"):
        top.agg(checked_sum(F.col("q"))).collect()
    # A total that fits is fine even when partial sums would not be.
    mixed = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,), (-(2**63),), (-5,)], "q bigint")
    assert mixed.agg(checked_sum(F.col("q"))).first()[0] == 2**63 - 7


def test_markers_of_every_text_and_kind(spark):
    texts = [None if x is None else str(x) for x in INVOICES] + ["\u00a0C5", "5C", "880"]
    rows = [(t, k, expected_marker(t, k)) for t in texts for k in ("text", "integer", "missing", "unsupported", None)]
    df = spark.createDataFrame(rows, "t string, k string, want string")
    assert df.filter(~cancellation_marker(F.col("t"), F.col("k")).eqNullSafe(F.col("want"))).collect() == []


def test_source_kind_table(spark):
    cells = [
        (None, "empty", "missing"), ("x", "text", "text"), ("5", "integer", "integer"), ("5.0", "float", "integer"),
        ("5.5", "float", "unsupported"), ("True", "boolean", "unsupported"),
        ("2010-12-01 00:00:00", "datetime", "unsupported"), ("#N/A", "error", "unsupported"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, v string, t string, want string")
    got = rows.orderBy("i").select(source_kind(F.col("v"), F.col("t")).alias("k"), "want").collect()
    assert [r.k for r in got] == [r.want for r in got]


TIMES = [
    "2010-12-01 08:26:00", "2010-12-01 08:26:00.123456", "2010/12/01 08:26:00", "2010-12-01", "2010-12-01T08:26:00",
    "2010", "2010-12", "abc", "", "2010-02-30 00:00:00", "2010-12-01 25:00:00", "2010-12-01 08:26:00Z",
    "2010-12-01 08:26:00+02", "2010-12-01 08:26:00+02:30", " 2010-12-01 08:26:00", "2010-12-01 08:26", "2010-1-2 3:04:05",
]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul"])
def test_invoice_times_do_not_depend_on_the_session_zone(spark, zone):
    want = [
        r[0] for t in TIMES for r in duckdb.execute("SELECT CAST(TRY_CAST(? AS TIMESTAMP) AS VARCHAR)", [t]).fetchall()
    ]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = column_of(spark, TIMES, lambda t: invoice_ts(t).cast("string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def test_utc_instants(spark):
    good = ["2031-04-05T06:07:08Z", "2031-04-05T06:07:08.25Z", "2031-04-05T06:07:08.000009Z"]
    bad = [
        "2031-04-05T06:07:08", "2031-04-05T06:07:08+00:00", "2031-04-05 06:07:08Z", "2031-04-05T06:61:08Z", "2031-13-05T06:07:08Z",
        "2031-02-29T06:07:08Z", "0000-04-05T06:07:08Z", "2031-04-05T06:07Z", "2031-04-05T06:07:08Z ", "2031-04-05T06:07:08.0000001Z", "soon", "",
    ]
    assert column_of(spark, good + bad, lambda t: utc_instant(t).isNotNull()) == [True] * len(good) + [False] * len(bad)
    texts = good
    assert str(column_of(spark, texts[:1], utc_date)[0]) == "2031-04-05"


def test_blank_is_unicode_wide(spark):
    assert column_of(spark, ["", " ", " \t", "\x1c", "a", "​", None], is_blank) == [
        True, True, True, True, False, False, None,
    ]


def test_display_and_completion(spark):
    row = spark.sql("SELECT timestamp'2020-01-01 00:00:00.999' a, timestamp'2020-01-01 01:00:00' b").select(
        display_ts(F.col("a")), completion(F.col("a"), F.col("b")) == F.col("b")
    )
    assert tuple(row.first()) == ("2020-01-01 00:00:00", True)


def test_product_search_is_literal_and_trimmed(spark):
    assert column_of(spark, ["ab%c", "abxc", "AB%C"], lambda t: contains_text(t, " b%C ")) == [True, False, True]
