"""Secrets in texts: fixed patterns and a sliding-window entropy, as column expressions.

Candidate strings are long runs of token characters. A window moves over each one a character
at a time; the count of the character that enters and of the one that leaves change the sum of
c * log2(c), from which the window's Shannon entropy follows. Windows at or above the
threshold of the string's character class mark a span, unless an allow-list knows the string.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The patterns of the three base kinds and the lengths they need.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Character classes by increasing size: what a string of the class consists of, its alphabet, and the bits
# a window must reach. A class above the first also needs a letter and a digit. Digits alone are no secret.
CLASSES = [
    ("hex", r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.7),
]
# Whole strings that look random and are known not to be secrets: UUIDs, paths, runs of words joined by dashes or underscores.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?(?:[A-Za-z]+[0-9]{0,4}/)+[A-Za-z]*[0-9]{0,4}$",
    r"^(?:[A-Za-z]+|[0-9]{1,4})(?:[-_](?:[A-Za-z]+|[0-9]{1,4}))+$",
]
# What shows that a part of a high-entropy span is made up. A span is no secret if its other parts, between separators, have
# fewer characters than a window, so a key joined to such a word is still found.
MADE_UP = r"(?i)(?:example|sample|placeholder|xxxxxx|0123456789|abcdefgh)"
SEPARATORS = "[/=_-]+"
KINDS = ["assign", "access", "hex", "entropy"]


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points, end exclusive.

    What lies between the matches has the same boundaries, so lengths add up to positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda hit, gap: F.struct(hit.alias("hit"), F.length(gap).alias("gap")))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, value: STRING>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(found)).alias("found"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def _found(text: Column, likely: Column, pattern: str) -> Column:
    """``located`` where a cheap test says that there may be a match."""
    return F.when(likely, located(text, pattern)).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, value: STRING>>)"))


def _spans(found: Column, kind: str, keep=None) -> Column:
    kept = F.filter(found, keep) if keep else found
    return F.transform(
        kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def _bits(count: Column) -> Column:
    """c * log2(c) for the counts 0 to WINDOW, looked up."""
    known = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    return F.element_at(known, count + 1)


def high_windows(value: Column, alphabet: str, threshold: float) -> Column:
    """(first, last) start of the windows of ``value`` whose entropy reaches ``threshold``; first is null if none does."""
    places = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(alphabet), ch))
    counts = F.array_repeat(F.lit(0), len(alphabet) + 1)
    start = F.struct(counts.alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    most = WINDOW * (math.log2(WINDOW) - threshold) + 1e-9

    def step(places: Column, acc: Column, i: Column) -> Column:
        comes = F.element_at(places, i)
        goes = F.when(i > WINDOW, F.element_at(places, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(-1))
        before = F.element_at(acc["counts"], comes + 1)
        added = acc["sum"] - _bits(before) + F.when(goes == comes, _bits(before)).otherwise(_bits(F.least(before + 1, F.lit(WINDOW))))
        old = F.element_at(acc["counts"], F.greatest(goes, F.lit(0)) + 1)
        total = F.when((goes < 0) | (goes == comes), added).otherwise(added - _bits(old) + _bits(F.greatest(old - 1, F.lit(0))))
        counted = F.transform(acc["counts"], lambda c, k: c + F.when(k == comes, 1).otherwise(0) - F.when(k == goes, 1).otherwise(0))
        high = (i >= WINDOW) & (total <= most)
        return F.struct(
            counted.alias("counts"),
            total.alias("sum"),
            F.when(high, F.coalesce(acc["first"], i - WINDOW)).otherwise(acc["first"]).alias("first"),
            F.when(high, i - WINDOW).otherwise(acc["last"]).alias("last"),
        )

    def run(own: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(value)), start, lambda acc, i: step(own, acc, i), lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))
        )

    # A one-element array binds the places once instead of once per window.
    return F.element_at(F.transform(F.array(places), run), 1)


def _entropy_spans(text: Column) -> Column:
    """Spans of high windows in the candidates that no allow-list entry matches, but for made-up ones."""
    candidates = F.filter(
        _found(text, text.rlike(CANDIDATE), CANDIDATE),
        lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & ~F.greatest(*[x["value"].rlike(p) for p in ALLOWED]),
    )

    def windows(x: Column) -> Column:
        chosen = F.lit(None).cast("struct<first: int, last: int>")
        for _, shape, alphabet, threshold in reversed(CLASSES):
            chosen = F.when(x["value"].rlike(shape), high_windows(x["value"], alphabet, threshold)).otherwise(chosen)
        return F.struct(x["start"].alias("start"), x["value"].alias("value"), chosen.alias("w"))

    def real(x: Column) -> Column:
        span = x["value"].substr(x["w"]["first"] + 1, x["w"]["last"] - x["w"]["first"] + WINDOW)
        others = F.filter(F.split(span, SEPARATORS), lambda part: ~part.rlike(MADE_UP))
        return x["w"]["first"].isNotNull() & (~span.rlike(MADE_UP) | (F.length(F.array_join(others, "")) >= WINDOW))

    high = F.filter(F.transform(candidates, windows), real)
    return F.transform(
        high,
        lambda x: F.struct(
            (x["start"] + x["w"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("rank"),
            (x["start"] + x["w"]["last"] + WINDOW).alias("end"), F.lit("entropy").alias("kind"),
        ),
    )


def _shown(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and added (entropy spans outside them) of every whole text.

    Spans are (start, rank, end, kind) in code points, end exclusive. A null or empty text has no
    spans. Every input row gives one row, repeated and null ids included; other columns are
    ignored. An entropy span inside a base span of the same text is not repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    long_value = lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= ASSIGN_VALUE
    base = F.concat(
        _spans(_found(text, text.contains("=") | text.contains(":"), ASSIGN), "assign", long_value),
        _spans(_found(text, text.contains("AKIA"), ACCESS), "access"),
        _spans(_found(text, text.rlike(HEX), HEX), "hex"),
    )
    outside = F.filter("added", lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])))
    found = rows.select("doc_id", base.alias("base"), _entropy_spans(text).alias("added"))
    return found.select("doc_id", "base", outside.alias("added"))


def secrets_found(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, the digest of the base spans, and all spans as text."""
    found = secret_spans(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
