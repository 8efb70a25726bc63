"""Event payloads: strict decoding, canonical content, plans of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.errors import ContractViolation
from tallyline.functions import strict_json as sj
from tallyline.functions.identity import canonical_json, payload_hash
from tallyline.functions.numbers import wide_sum
from tallyline.functions.text import is_blank
from tallyline.functions.times import is_utc_instant, utc_date, utc_instant
from tallyline.schemas import EVENT_FIELDS, PLAN_FIELDS

# Type of a payload with exactly the four fields, each of the right JSON type.
_WELL_TYPED = "OBJECT<event_id: STRING, occurred_at: STRING, product_code: STRING, quantity: BIGINT>"
# What makes a canonical string differ from its own characters.
_ESCAPED = r"[\\\x00-\x1f]"
_WIDE_INTEGER = r"^DECIMAL\((?:19|[2-9][0-9]),0\)$"


def decode_events(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Add the decoded fields, canonical content and a ``reason``; null reason is valid.

    A repeated key keeps its last value in every session: the setting that says so is made here.

    A payload is one JSON object in UTF-8 with exactly the four event fields. Invalid
    payloads keep their row so that a gate can list them. Producers write canonical text:
    cut at its quotes and put together again it is the same text, which proves shape and
    types at once. Every other text goes through the strict parse. Every column stays in
    the JVM.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = sj.utf8_text(F.col(value_col), df.schema[value_col].dataType)
    _text, _doc, plain = F.col("_text"), F.col("_doc"), F.col("_plain")
    # One-element inlines: a later filter can not be pushed below them, which would repeat
    # the work once per mention of its result.
    cut = df.withColumn("_text", text).select("*", _once(F.split(_text, '"').alias("_cut")))
    last = F.get("_cut", F.lit(14))
    pieces = cut.select(
        "*",
        _once(
            F.get("_cut", F.lit(3)).alias("_id"),
            F.get("_cut", F.lit(7)).alias("_at"),
            F.get("_cut", F.lit(11)).alias("_code"),
            F.substring(last, F.lit(2), F.length(last) - 2).try_cast("bigint").alias("_number"),
        ),
    ).drop("_cut")
    rejoined = F.concat(
        F.lit('{"event_id":"'), "_id", F.lit('","occurred_at":"'), "_at", F.lit('","product_code":"'), "_code",
        F.lit('","quantity":'), F.col("_number").cast("string"), F.lit("}"),
    )
    same = F.coalesce((rejoined == _text) & ~_text.rlike(_ESCAPED), F.lit(False))
    looked_at = pieces.select("*", _once(same.alias("_plain")))
    opened = looked_at.select("*", _once(F.when(~plain, sj.parsed(_text)).alias("_doc")))

    def part(piece: str, name: str, dtype: str):
        return F.when(plain, F.col(piece)).otherwise(sj.field(_doc, name, dtype))

    fields = opened.select(
        "*",
        _once(
            F.when(plain, F.lit(_WELL_TYPED)).when(sj.is_whole(_doc, _text), sj.body_type(_doc)).alias("_type"),
            part("_id", "event_id", "string").alias("event_id"),
            part("_at", "occurred_at", "string").alias("occurred_text"),
            part("_code", "product_code", "string").alias("product_code"),
            part("_number", "quantity", "bigint").alias("_quantity"),
        ),
    )
    judged = fields.select(
        "*", _once(_reason(df, value_col).alias("reason"), utc_instant(F.col("occurred_text")).alias("_instant"))
    )
    valid = F.col("reason").isNull()
    rebuilt = canonical_json(F.col("event_id"), F.col("occurred_text"), F.col("product_code"), F.col("_quantity"))
    return judged.select(
        *df.columns,
        "event_id",
        "product_code",
        "occurred_text",
        F.when(valid, F.col("_quantity")).alias("quantity"),
        "reason",
        F.when(valid, F.when(plain, _text).otherwise(rebuilt)).alias("payload_json"),
        F.when(valid, F.col("_instant")).alias("occurred_at"),
        F.when(valid, utc_date(F.col("occurred_text"))).alias("observed_date"),
    ).withColumn("payload_sha256", payload_hash(F.col("payload_json")))


def _reason(df: DataFrame, value_col: str):
    """First broken rule of the event contract, in the order the rules are stated."""
    doc, type_name, occurred = F.col("_doc"), F.col("_type"), F.col("occurred_text")
    ill_typed = type_name != _WELL_TYPED
    names = F.sort_array(F.array(*[F.lit(name) for name in EVENT_FIELDS]))
    same_names = F.sort_array(sj.body_keys(doc)) == names
    quantity_type = sj.field_type(doc, "quantity")

    def not_text(name: str):
        return ill_typed & F.coalesce(sj.field_type(doc, name) != "STRING", F.lit(True))

    return (
        F.when(F.col("_text").isNull() & F.col(value_col).isNotNull(), "not_utf8")
        .when(type_name.isNull(), "malformed_json")
        .when(ill_typed & ~type_name.startswith("OBJECT"), "not_an_object")
        .when(ill_typed & ~same_names, "wrong_fields")
        .when(is_blank(F.col("event_id")) | not_text("event_id"), "blank_event_id")
        .when(is_blank(F.col("product_code")) | not_text("product_code"), "blank_product_code")
        .when(~is_utc_instant(occurred) | not_text("occurred_at"), "occurred_at_not_utc_instant")
        .when(ill_typed & quantity_type.rlike(_WIDE_INTEGER), "quantity_out_of_range")
        .when(ill_typed & (quantity_type != "BIGINT"), "quantity_not_integer")
        .when(utc_instant(occurred).isNull(), "occurred_at_impossible")
    )


def _once(*columns):
    """Generate the columns in one place, so that their expressions are not copied around."""
    return F.inline(F.array(F.struct(*columns)))


def invalid_events(decoded: DataFrame) -> DataFrame:
    """Payloads that fail the event contract."""
    return decoded.filter("reason IS NOT NULL")


def event_fixture_violations(events: DataFrame) -> DataFrame:
    """Event ids given more than once: with other content a conflict, else a repeat."""
    counted = events.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("times"),
        (F.min("payload_sha256") != F.max("payload_sha256")).alias("_differs"),
    )
    return counted.filter("times > 1").select(
        "event_id", "times", F.when(F.col("_differs"), "conflicting_content").otherwise("repeated").alias("reason")
    )


def plan_violations(plan: DataFrame, events: DataFrame) -> DataFrame:
    """Plan rows with a missing field, a repeated delivery id or an unknown event."""
    missing = F.lit(False)
    for name in PLAN_FIELDS:
        missing = missing | F.coalesce(F.col(name) == "", F.lit(True))
    incomplete = plan.filter(missing).select("delivery_id", F.lit("field_missing").alias("reason"))
    repeated = (
        plan.groupBy("delivery_id")
        .agg(F.count(F.lit(1)).alias("times"))
        .filter("times > 1 AND delivery_id <> ''")
        .select("delivery_id", F.lit("delivery_id_repeats").alias("reason"))
    )
    unknown = (
        plan.filter("event_id <> ''")
        .join(events.select("event_id"), "event_id", "left_anti")
        .select("delivery_id", F.lit("unknown_event").alias("reason"))
    )
    return incomplete.unionByName(repeated).unionByName(unknown)


def plan_deliveries(events: DataFrame, plan: DataFrame, phase: str) -> DataFrame:
    """Payloads of one phase of a plan; the same event may be delivered many times. A phase without deliveries is refused."""
    own = plan.filter(F.col("phase") == phase)
    if own.isEmpty():
        raise ContractViolation(f"the plan has no delivery in phase {phase!r}")
    return own.join(
        events.select("event_id", "payload_json", "payload_sha256"), "event_id"
    )


def batch_product_day(events: DataFrame) -> DataFrame:
    """Totals straight from unique raw events: text instant to UTC day, exact sum, count."""
    day = F.to_date(F.substring("occurred_at", 1, 10)).alias("observed_date")
    return events.groupBy(day, "product_code").agg(
        wide_sum(F.col("quantity").cast("bigint")).alias("signed_quantity_sum"),
        F.count(F.lit(1)).alias("unique_event_count"),
    )


def dedup_product_day(deliveries: DataFrame) -> DataFrame:
    """Totals over deliveries that may repeat: each event id counts once.

    Ids that arrived with different content are refused beforehand by
    :func:`event_fixture_violations`; here the content of an id is one row.
    """
    unique = deliveries.groupBy("event_id").agg(
        F.min(F.struct("observed_date", "product_code", "quantity")).alias("e")
    )
    return unique.groupBy("e.observed_date", "e.product_code").agg(
        wide_sum(F.col("e.quantity")).alias("signed_quantity_sum"),
        F.count(F.lit(1)).alias("unique_event_count"),
    )


def event_collisions(deliveries: DataFrame) -> DataFrame:
    """Event ids whose deliveries carry more than one content."""
    return (
        deliveries.groupBy("event_id")
        .agg(F.min("payload_sha256").alias("lowest"), F.max("payload_sha256").alias("highest"))
        .filter("lowest <> highest")
        .select("event_id")
    )
