import pytest
from pyspark.sql import functions as F

from tallyline.errors import ContractViolation
from tallyline.operators import events as evt

GOOD = '{"event_id":"e1","occurred_at":"2026-09-22T10:00:00Z","product_code":"W-1","quantity":3}'
REASONS = [
    (GOOD, None),
    (' { "quantity" : 3, "product_code":"W-1","occurred_at":"2026-09-22T10:00:00Z","event_id":"e1" } ', None),
    (GOOD.replace("3}", "-0}"), None),
    (GOOD.replace('"e1"', '"e\\u0031"'), None),
    (GOOD.replace("3}", "9223372036854775807}"), None),
    (GOOD.replace("3}", "-9223372036854775808}"), None),
    (GOOD.replace('"quantity":3', '"quantity":9,"quantity":3'), None),
    (GOOD.replace("3}", "9223372036854775808}"), "quantity_out_of_range"),
    (GOOD.replace("3}", "-9223372036854775809}"), "quantity_out_of_range"),
    (GOOD.replace("3}", "3.0}"), "quantity_not_integer"),
    (GOOD.replace("3}", "3e0}"), "quantity_not_integer"),
    (GOOD.replace("3}", "true}"), "quantity_not_integer"),
    (GOOD.replace("3}", '"3"}'), "quantity_not_integer"),
    (GOOD.replace("3}", "null}"), "quantity_not_integer"),
    (GOOD.replace(',"quantity":3', ""), "wrong_fields"),
    (GOOD.replace("}", ',"x":1}'), "wrong_fields"),
    (GOOD.replace('"e1"', '"  "'), "blank_event_id"),
    (GOOD.replace('"e1"', "7"), "blank_event_id"),
    (GOOD.replace('"e1"', "null"), "blank_event_id"),
    (GOOD.replace('"W-1"', '""'), "blank_product_code"),
    (GOOD.replace("T10:00:00Z", "Z"), "occurred_at_not_utc_instant"),
    (GOOD.replace("00Z", "00"), "occurred_at_not_utc_instant"),
    (GOOD.replace("T10", "T25"), "occurred_at_impossible"),
    (GOOD.replace("09-22", "02-30"), "occurred_at_impossible"),
    ("[" + GOOD + "]", "not_an_object"),
    ("3", "not_an_object"),
    ("", "malformed_json"),
    (GOOD + " x", "malformed_json"),
    (GOOD + "{}", "malformed_json"),
    (GOOD + ',"end":1', "malformed_json"),
    (GOOD + ',"v":' + GOOD, "malformed_json"),
    (GOOD + ',"end":"0"},{"v":' + GOOD, "malformed_json"),
    (GOOD[:-1], "malformed_json"),
    ("{'event_id':1}", "malformed_json"),
    (GOOD.replace("3}", "03}"), "malformed_json"),
    (GOOD.replace("3}", "+3}"), "malformed_json"),
    (GOOD.replace("3}", "NaN}"), "malformed_json"),
]


def decode(spark, values, dtype="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, value {dtype}")
    return evt.decode_events(rows).orderBy("i").collect()


def test_every_rule_of_the_event_contract(spark):
    got = decode(spark, [text for text, _ in REASONS])
    assert [(r.value, r.reason) for r in got] == REASONS


def test_bytes_that_are_not_utf8(spark):
    got = decode(spark, [GOOD.encode(), b"\xff" + GOOD.encode()], "binary")
    assert [r.reason for r in got] == [None, "not_utf8"]


def test_same_content_same_hash_whatever_the_text(spark):
    first, second, third, escaped, *_ = decode(spark, [text for text, _ in REASONS])
    assert first.payload_sha256 == second.payload_sha256 == escaped.payload_sha256
    assert third.payload_sha256 != first.payload_sha256
    assert first.payload_json == GOOD
    assert str(first.observed_date) == "2026-09-22"
    wide = decode(spark, [REASONS[6][0]])[0]
    assert wide.quantity == 3 and wide.payload_sha256 == first.payload_sha256


def test_non_ascii_is_kept(spark):
    text = GOOD.replace("W-1", "상품-é")
    (row,) = decode(spark, [text])
    assert row.reason is None and row.payload_json == text


def test_utc_day_does_not_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
    try:
        rows = spark.createDataFrame([(GOOD.replace("T10", "T23"),)], "value string")
        row = evt.decode_events(rows).select(F.col("observed_date").cast("string"), F.unix_seconds("occurred_at")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == ("2026-09-22", 1790118000)


def test_fixture_and_plan_rules(spark):
    events = spark.createDataFrame(
        [("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")], "event_id string, payload_sha256 string"
    )
    got = {r.event_id: r.reason for r in evt.event_fixture_violations(events).collect()}
    assert got == {"a": "repeated", "b": "conflicting_content"}
    plan = spark.createDataFrame(
        [("d1", "initial", "a"), ("d1", "late", "b"), ("d2", "", "c"), ("d3", "late", "z")],
        "delivery_id string, phase string, event_id string",
    )
    found = sorted((r.delivery_id, r.reason) for r in evt.plan_violations(plan, events).collect())
    assert found == [("d1", "delivery_id_repeats"), ("d2", "field_missing"), ("d3", "unknown_event")]


@pytest.mark.parametrize("phase, want", [("initial", 1), ("late", 2)])
def test_plan_repeats_events(spark, phase, want):
    events = spark.createDataFrame([("a", "{}", "x")], "event_id string, payload_json string, payload_sha256 string")
    plan = spark.createDataFrame(
        [("1", "initial", "a"), ("2", "late", "a"), ("3", "late", "a")],
        "delivery_id string, phase string, event_id string",
    )
    assert evt.plan_deliveries(events, plan, phase).count() == want
    with pytest.raises(ContractViolation, match="'never'"):
        evt.plan_deliveries(events, plan, "never")
