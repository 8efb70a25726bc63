"""Cheapest repair of conversations by weighted interval parsing.

A conversation is a row of symbols, one per turn: its role's initial, whether it is cut short, and
whether it has to go. The grammar's nonterminals (p, q) stand for what leads the turn order from
state p to state q, so all rules are (p, q) -> (p, r) (r, q) or (p, q) -> one edited turn, which is
Chomsky's normal form, closed under inserted turns on both sides. A span's cells hold the least
(cost, audit) of each nonterminal, and longer spans are combined of shorter ones, bottom-up by
length. Conversations are cut into segments first, so spans of one conversation are parsed in
several tasks and only cells meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import written

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
# Turn order as an automaton: an optional system turn, then pairs of user and assistant.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPTED = range(4), (0, 3)
# What the repaired turns may be called.
ROLES = {"u": "user", "a": "assistant"}
# Turns in a segment, and spans whose cells a worker remembers.
SEGMENT = 1024
REMEMBERED = 100_000
BLANK = r"[\x20\x09-\x0D]"

Cells = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cells, right: Cells) -> Cells:
    """The least (cost, audit) of every nonterminal over two adjoining spans.

    Equal costs are decided by the audits. Audits of one cell and cost have as many letters, since
    each has one for every turn of the span and as many insertions as the cost leaves, so the
    least of a span is made of the least of its halves, wherever it is cut.
    """
    found: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            more = right.get((r, q))
            if more is not None:
                made = (cost + more[0], audit + more[1])
                if (p, q) not in found or made < found[p, q]:
                    found[p, q] = made
    return found


def _closure() -> Cells:
    """What insertions alone can do."""
    found: Cells = {(p, p): (0, "") for p in STATES}
    once: Cells = found | {(p, q): (INSERT, "I") for (p, role), q in STEPS.items() if role in ROLES}
    while True:
        more = combined(found, once)
        if more == found:
            return found
        found = more


INSERTED = _closure()


def edited(symbol: str) -> Cells:
    """The cells of one turn: "-" has to go, a capital is cut short."""
    found: Cells = {(p, p): (DELETE, "D") for p in STATES}
    if symbol != "-":
        extra = CUT_SHORT if symbol.isupper() else 0
        for role, cost, letter in [("u", REROLE, "R"), ("a", REROLE, "R"), (symbol.lower(), KEEP, "K")]:
            for p in STATES:
                if (p, role) in STEPS:
                    made = (cost + extra, letter)
                    key = (p, STEPS[p, role])
                    found[key] = min(found.get(key, made), made)
    return combined(combined(INSERTED, found), INSERTED)


_SPANS: dict[str, Cells] = {}


def parsed(symbols: str) -> Cells:
    """The cells of a span, by doubling the length of its parts; short spans are remembered."""
    spans = []
    for symbol in symbols:
        if symbol not in _SPANS:
            _SPANS[symbol] = edited(symbol)
        spans.append((symbol, _SPANS[symbol]))
    while len(spans) > 1:
        wider = []
        for k in range(0, len(spans) - 1, 2):
            (a, left), (b, right) = spans[k], spans[k + 1]
            cells = _SPANS.get(a + b)
            if cells is None:
                cells = combined(left, right)
                if len(a + b) <= 32:
                    if len(_SPANS) > REMEMBERED:
                        _SPANS.clear()
                    _SPANS[a + b] = cells
            wider.append((a + b, cells))
        spans = wider + spans[len(spans) - len(spans) % 2 :]
    return spans[0][1] if spans else {(p, p): INSERTED[p, p] for p in STATES}


def least(cells: Cells) -> tuple[int, str]:
    """The cheapest repair of a whole conversation."""
    return min(cells[0, q] for q in ACCEPTED if (0, q) in cells)


def placed(audit: str) -> list[tuple[str, str | None]]:
    """(edit, new role initial) of every letter; the initial is null for a deletion and for a kept system turn."""
    has_system = sum(letter != "D" for letter in audit) % 2 == 1
    out: list[tuple[str, str | None]] = []
    state = 0
    for letter in audit:
        if letter == "D":
            out.append((letter, None))
        elif state == 0 and has_system:
            out.append((letter, None))
            state = 1
        else:
            role = "a" if state == 2 else "u"
            state = STEPS[state, role]
            out.append((letter, role))
    return out


# --- damage and faults -----------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the checksum of ``conv_id:turn`` tells; nulls are one blank there.

    Of twenty remainders 0 drops a turn, 1 empties its text, 2 removes its ends of sentences, 3
    repeats it and 4 makes it the user's.
    """
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"], F.lit(" ")).alias("role"), F.coalesce(conversations["text"], F.lit(" ")).alias("text"),
    )
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(named.cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1))
    return rows.filter(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of the text), number and ``fault`` (blank, duplicate, truncated or null) of ``numbered`` rows.

    Turns are in the order of turn (nulls first), role, digest and number. The first of equal
    turns is found by a grouped minimum, so repeats of one turn do not meet in a task.
    """
    text = F.col("text")
    kind = F.when(~text.rlike(BLANK.replace("[", "[^")), "blank").when(~text.rlike(rf"[.!?]{BLANK}*\z"), "truncated")
    slim = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "number", kind.alias("kind"))
    slim = written(slim, "turns")
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "number")).alias("first")).select(F.col("first.number").alias("number"), F.lit(True).alias("is_first"))
    fault = F.when(F.col("kind") == "blank", "blank").when(F.col("is_first").isNull(), "duplicate").otherwise(F.col("kind"))
    return slim.join(first, "number", "left").select("conv_id", "turn", "role", "digest", "number", fault.alias("fault"))


# --- segments and their cells -----------------------------------------------------

_COUNTED = ["blank", "duplicate", "truncated"]
_SEGMENT = pa.schema(
    [("conv_id", pa.int64()), ("task", pa.int64()), ("place", pa.int64()), ("symbols", pa.string()), ("numbers", pa.list_(pa.int64()))]
    + [(name, pa.int64()) for name in (*_COUNTED, "illegal", "low", "high", "turns")]
    + [("first", pa.string()), ("last", pa.string())]
)
_SEGMENT_DDL = (
    "conv_id long, task long, place long, symbols string, numbers array<long>, "
    + ", ".join(f"{name} long" for name in (*_COUNTED, "illegal", "low", "high", "turns"))
    + ", first string, last string"
)
_LEGAL = {"su", "ua", "au"}


class _Segment:
    """Turns of one conversation that lie next to each other in one task."""

    def __init__(self, conv_id: int | None, task: int, place: int):
        self.row = dict.fromkeys(_SEGMENT.names)
        self.row |= {"conv_id": conv_id, "task": task, "place": place, "numbers": [], "illegal": 0, "turns": 0} | dict.fromkeys(_COUNTED, 0)
        self.symbols: list[str] = []

    def add(self, turn: int | None, initial: str, number: int, fault: str | None) -> None:
        row = self.row
        if self.symbols:
            row["illegal"] += row["last"] + initial not in _LEGAL
        else:
            row["first"] = initial
        row["last"] = initial
        if turn is not None:
            row["turns"] += row["high"] != turn
            row["low"] = turn if row["low"] is None else row["low"]
            row["high"] = turn
        if fault:
            row[fault] += 1
        symbol = initial if initial in ("s", "u", "a") else "x"
        self.symbols.append("-" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)
        row["numbers"].append(number)

    def done(self) -> dict:
        return self.row | {"symbols": "".join(self.symbols)}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of rows that are ordered by conversation."""
    task, place, open_segment, done = TaskContext.get().partitionId(), 0, None, []
    for batch in batches:
        for conv_id, turn, initial, number, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "number", "fault"))):
            if open_segment is None or open_segment.row["conv_id"] != conv_id or len(open_segment.symbols) == SEGMENT:
                if open_segment is not None:
                    done.append(open_segment.done())
                open_segment, place = _Segment(conv_id, task, place), place + 1
            open_segment.add(turn, initial, number, fault)
        if done:
            yield _batch(done, _SEGMENT)
            done = []
    if open_segment is not None:
        yield _batch([open_segment.done()], _SEGMENT)


def segments_of(faults: DataFrame) -> DataFrame:
    """Segments in turn order: a range of conversations and turns per task, so a long conversation spans several."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "number"]
    rows = faults.select("conv_id", "turn", "role", "digest", "number", "fault", F.substring("role", 1, 1).alias("initial"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, _SEGMENT_DDL)


_EDIT = pa.schema(
    [("conv_id", pa.int64()), ("number", pa.int64()), ("at", pa.int64()), ("kept", pa.bool_())]
    + [(name, pa.string()) for name in ("role", "before", "after")]
    + [(name, pa.int64()) for name in ("gaps", *_COUNTED, "illegal", "cost")]
    + [("audit", pa.string())]
)
_EDIT_DDL = (
    "conv_id long, number long, at long, kept boolean, role string, before string, after string, "
    + ", ".join(f"{name} long" for name in ("gaps", *_COUNTED, "illegal", "cost"))
    + ", audit string"
)


def _joined(a: dict, b: dict) -> dict:
    """Two adjoining spans as one: counts add up, but for what happens where they meet."""
    out = {name: a[name] + b[name] for name in (*_COUNTED, "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in _LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {
        "cells": combined(a["cells"], b["cells"]), "first": a["first"], "last": b["last"], "length": a["length"] + b["length"],
        "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"],
    }


def _edits(conv_id: int | None, spans: list[dict], numbers: list[int]) -> Iterator[dict]:
    """The conversation's own row, without a number, and one of every turn."""
    # Spans of about equal length are joined first.
    while len(spans) > 1:
        spans = [_joined(*spans[k : k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    span = spans[0]
    cost, audit = least(span["cells"])
    gaps = 0 if span["low"] is None else span["high"] - span["low"] + 1 - span["turns"]
    none = dict.fromkeys(_EDIT.names)
    yield none | {name: span[name] for name in (*_COUNTED, "illegal")} | {"conv_id": conv_id, "gaps": gaps, "cost": cost, "audit": audit}
    row, at, before = None, 0, []
    for letter, role in placed(audit):
        if letter == "I":
            before.append(f"{ROLES[role]}:")
            continue
        if row is not None:
            yield row
        row = none | {"conv_id": conv_id, "number": numbers[at], "at": at, "kept": letter != "D", "before": "\n".join(before) if before else None}
        row["role"] = ROLES[role] if letter == "R" else None
        at, before = at + 1, []
    yield row | {"after": "\n".join(before) if before else None}


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of segments that are ordered by conversation, task and place."""
    spans, numbers, conv_id, out = [], [], None, []
    for batch in batches:
        for segment in batch.to_pylist():
            if spans and segment["conv_id"] != conv_id:
                out.extend(_edits(conv_id, spans, numbers))
                spans, numbers = [], []
                if len(out) > 10_000:
                    yield _batch(out, _EDIT)
                    out = []
            conv_id = segment["conv_id"]
            numbers.extend(segment["numbers"])
            spans.append(segment | {"cells": parsed(segment["symbols"]), "length": len(segment["symbols"])})
    if spans:
        out.extend(_edits(conv_id, spans, numbers))
    if out:
        yield _batch(out, _EDIT)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's lines, which stream by in order; only the digest's state is kept."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv_id, state, out = None, None, []
    for batch in batches:
        for own, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if state is not None and own == conv_id:
                state.update(b"\n")
            else:
                if state is not None:
                    out.append({"conv_id": conv_id, "repaired_sha256": state.hexdigest()})
                conv_id, state = own, hashlib.sha256()
            state.update(lines.encode())
        if out:
            yield _batch(out, schema)
            out = []
    if state is not None:
        yield _batch([{"conv_id": conv_id, "repaired_sha256": state.hexdigest()}], schema)


# --- the operator ------------------------------------------------------------------


def numbered(rows: DataFrame) -> DataFrame:
    """Turns written with a number each, by which their edits find them again."""
    return written(rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("number")), "numbered")


def edits_of(rows: DataFrame) -> DataFrame:
    """Of ``numbered`` turns: a row per turn, with its edit, and one per conversation without a number, with counts, cost and audit."""
    segments = segments_of(written(with_faults(rows), "faults"))
    together = written(segments, "segments").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "task", "place")
    return written(together.mapInArrow(_repair, _EDIT_DDL), "edits")


def repaired_lines(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, at and lines (``role:text``, insertions included) of the repaired conversations."""
    changed = edits.filter("number IS NOT NULL AND (kept OR before IS NOT NULL OR after IS NOT NULL)")
    changed = changed.select("number", "at", "kept", F.col("role").alias("new_role"), "before", "after")
    own = F.when(F.col("kept"), F.concat(F.coalesce("new_role", "role"), F.lit(":"), F.col("text")))
    return rows.join(changed, "number").select("conv_id", "at", F.concat_ws("\n", "before", own, "after").alias("lines"))


def repairs(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, gaps, counts of faults, illegal, cost, audit and repaired_sha256 of every conversation.

    Null roles and texts are one blank; a null conv_id is a conversation of its own. Null turns
    come first, and equal turns are ordered by role and text. Repeated rows are duplicates of the
    first. Texts of any length only count by their ends; an empty one is blank. Extra columns are
    ignored. A conversation that lost all its rows has zeros, an empty audit and the digest of
    nothing; no rows give no rows. A conversation's digest is one value, so its lines pass through one task,
    which holds one batch of them at a time.
    """
    rows = numbered(damaged(conversations) if damage else conversations.select("conv_id", "turn", _blank_if_null("role"), _blank_if_null("text")))
    edits = edits_of(rows)
    lines = repaired_lines(rows, edits).repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "at")
    digests = lines.mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "_of")
    counts = ["gaps", *_COUNTED, "illegal", "cost"]
    told = edits.filter("number IS NULL").select(F.col("conv_id").alias("_conv"), *counts, "audit")
    known = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    met = known.join(told, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return met.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def _blank_if_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(" ")).alias(name)
