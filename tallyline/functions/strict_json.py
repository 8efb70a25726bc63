"""Strict JSON objects from untrusted text, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType, DataType


def utf8_text(value: Column, dtype: DataType) -> Column:
    """Text of a payload, null when its bytes are not UTF-8."""
    text = value.cast("string") if isinstance(dtype, BinaryType) else value
    return F.try_validate_utf8(text)


def parsed(text: Column) -> Column:
    """Variant ``{v: <text>, end: <digest of text>}``, null when that is not one JSON object.

    The parser alone would ignore what follows the first value. In the wrapper, following
    text breaks the syntax, adds a key (repeats count, so exactly two must remain) or leaves
    the end mark, which no text can hold of itself, to someone else; see :func:`is_whole`.
    """
    whole = F.concat(F.lit('{"v":'), text, F.lit(',"end":"'), F.md5(text.cast("binary")), F.lit('"}'))
    return F.when(F.size(F.json_object_keys(whole)) == 2, F.try_parse_json(whole))


def is_whole(document: Column, text: Column) -> Column:
    """True when the wrapper's end mark is the one of this text."""
    return F.try_variant_get(document, "$.end", "string") == F.md5(text.cast("binary"))


def field(document: Column, name: str, dtype: str) -> Column:
    return F.try_variant_get(document, f"$.v.{name}", dtype)


def field_type(document: Column, name: str) -> Column:
    """Type name as the parser saw it: BIGINT, DECIMAL(p,s), DOUBLE, STRING, BOOLEAN, ..."""
    return F.schema_of_variant(F.try_variant_get(document, f"$.v.{name}", "variant"))


def body_type(document: Column) -> Column:
    return F.schema_of_variant(F.try_variant_get(document, "$.v", "variant"))


def body_keys(document: Column) -> Column:
    """Distinct field names of the object, null when the body is not an object."""
    return F.map_keys(F.try_variant_get(document, "$.v", "map<string,variant>"))
