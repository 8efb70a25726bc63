"""Content fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def sha256_id(content: Column) -> Column:
    """``sha256:`` + hex digest of text or bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def payload_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def canonical_json(event_id: Column, occurred_at: Column, product_code: Column, quantity: Column) -> Column:
    """Compact JSON with the four event fields in name order."""
    return F.to_json(
        F.struct(
            event_id.alias("event_id"),
            occurred_at.alias("occurred_at"),
            product_code.alias("product_code"),
            quantity.alias("quantity"),
        )
    )


def rule_fingerprint(rule_text: str) -> str:
    """Fingerprint of a versioned rule text, known before any job runs."""
    return "sha256:" + hashlib.sha256(rule_text.strip().encode("utf-8")).hexdigest()


def rule_id(rule_text: str) -> Column:
    return F.lit(rule_fingerprint(rule_text))
