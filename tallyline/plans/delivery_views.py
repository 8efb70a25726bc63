"""The events table read as an at-least-once delivery log.

The table numbers its events from 0 without gaps; that number is an event's place, however
many files the table has. Events are dealt to four stream partitions by place; in each, every
tenth event is delivered a second time right after the first. Offsets follow from the place,
so they are contiguous without any ordering pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.operators.events import decode_events

TOPIC = "events"
PARTITIONS = 4
CONFLICTS_SINCE = "2024-01-25 00:00:00"


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark.read.parquet(f"{sf_dir}/events.parquet"))


def located(events: DataFrame) -> DataFrame:
    """Events with their zero-based place in the log; works on streams as well."""
    return events.select("*", F.col("event_id").cast("bigint").alias("place"))


def _occurred_at() -> Column:
    """UTC instant text. One in thirteen events belongs to the day before."""
    shifted = F.when(F.col("event_id") % 13 == 5, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    return F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _quantity() -> Column:
    units = F.floor("value").cast("bigint")
    return F.when(F.col("event_type") == "error", -units).otherwise(units)


def source_events(events: DataFrame) -> DataFrame:
    """The four event fields of every table row, next to its place."""
    return events.select(
        "place",
        "ts",
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        _occurred_at().alias("occurred_at"),
        F.col("event_type").alias("product_code"),
        _quantity().alias("quantity"),
    )


def _payload(quantity: Column, reordered: bool) -> Column:
    """Payload text, canonical or with other key order and blanks."""
    part = {
        "event_id": F.concat(F.lit('"'), F.col("event_id"), F.lit('"')),
        "occurred_at": F.concat(F.lit('"'), F.col("occurred_at"), F.lit('"')),
        "product_code": F.concat(F.lit('"'), F.col("product_code"), F.lit('"')),
        "quantity": quantity.cast("string"),
    }
    names = list(part)
    gap, sep = "", ","
    if reordered:
        names, gap, sep = names[::-1], " ", " , "
    pieces: list[Column] = []
    for i, name in enumerate(names):
        pieces += [F.lit(("{" if i == 0 else sep) + f'"{name}":{gap}'), part[name]]
    return F.concat(*pieces, F.lit("}"))


def deliveries(events: DataFrame, with_conflicts: bool = False) -> DataFrame:
    """Envelope rows (topic, partition, kafka_offset, value) of the whole log.

    With conflicts, second deliveries of events from the last days carry another quantity.
    """
    base = source_events(events).withColumn("slot", F.floor(F.col("place") / PARTITIONS))
    block, turn = F.floor(F.col("slot") / 10), F.col("slot") % 10
    first_offset = block * 11 + turn + F.when(turn > 0, 1).otherwise(0)
    late = F.col("ts") >= F.lit(CONFLICTS_SINCE).cast("timestamp_ntz")
    second_quantity = F.col("quantity")
    if with_conflicts:
        second_quantity = F.when(late, F.col("quantity") + 1000).otherwise(F.col("quantity"))
    first = F.struct(first_offset.alias("kafka_offset"), _payload(F.col("quantity"), False).alias("value"))
    second = F.struct((block * 11 + 1).alias("kafka_offset"), _payload(second_quantity, True).alias("value"))
    copies = F.when(turn == 0, F.array(first, second)).otherwise(F.array(first))
    return base.select(
        F.lit(TOPIC).alias("topic"),
        (F.col("place") % PARTITIONS).cast("int").alias("partition"),
        F.explode(copies).alias("d"),
    ).select("topic", "partition", "d.kafka_offset", "d.value")


def decoded_deliveries(spark: SparkSession, sf_dir: str, with_conflicts: bool = False) -> DataFrame:
    return decode_events(deliveries(events_table(spark, sf_dir), with_conflicts)).drop("value", "occurred_text")


def once_each(events: DataFrame) -> DataFrame:
    """Payloads of every event, once; works on streams as well."""
    return source_events(events).select(_payload(F.col("quantity"), False).alias("value"))


def unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, decoded, as a fixture file would hold them."""
    return decode_events(once_each(events_table(spark, sf_dir))).drop("value", "occurred_text")


def odd_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a payload, most of them broken in one of the ways the contract names."""
    events = source_events(events_table(spark, sf_dir))
    good = _payload(F.col("quantity"), False)
    way = F.col("place") % 20
    head = F.concat(
        F.lit('{"event_id":"'), F.col("event_id"), F.lit('","occurred_at":"'), F.col("occurred_at"),
        F.lit('","product_code":"'), F.col("product_code"), F.lit('"'),
    )
    value = (
        F.when(way == 1, F.concat(head, F.lit(',"quantity":3.0}')))
        .when(way == 2, F.concat(head, F.lit(',"quantity":true}')))
        .when(way == 3, F.concat(head, F.lit(',"quantity":"3"}')))
        .when(way == 4, F.concat(head, F.lit(',"quantity":9223372036854775808}')))
        .when(way == 5, F.concat(head, F.lit("}")))
        .when(way == 6, F.concat(head, F.lit(',"quantity":3,"extra":1}')))
        .when(way == 7, F.concat(good, F.lit(" x")))
        .when(way == 8, F.concat(F.lit("["), good, F.lit("]")))
        .when(way == 9, F.regexp_replace(good, '"evt-[0-9]+"', '" "'))
        .when(way == 10, F.regexp_replace(good, '"product_code":"[a-z]+"', '"product_code":""'))
        .when(way == 11, F.regexp_replace(good, "T[0-9]{2}:", "T25:"))
        .when(way == 12, F.regexp_replace(good, 'Z"', '"'))
        .when(way == 13, F.regexp_replace(good, "T[0-9:.]+Z", "Z"))
        .when(way == 14, F.concat(F.lit(" "), good, F.lit("\n")))
        .when(way == 15, F.concat(head, F.lit(',"quantity":-9223372036854775808}')))
        .when(way == 16, F.concat(good, F.lit(',"end":1')))
        .otherwise(good)
    )
    return events.select("place", F.col("event_id").alias("source_event_id"), value.alias("value"))
