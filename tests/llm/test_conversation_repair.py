"""Repairs against a plain search over all edits, and the whole operator against plain code."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallyline.llm import conversation_repair as cr
from tallyline.llm.conversation_repair import combined, edited, least, parsed, placed, repairs

SCHEMA = "conv_id long, turn long, role string, text string, number int, fault string"
RIGHT = re.compile(r"(s?(ua)+)?")


def plain_repair(symbols):
    """Least (cost, audit, roles) by extending the repairs of the turns before, insertions included, told apart by what the rest depends on."""
    def key(roles):
        return roles if len(roles) < 2 else roles[0] + "~" + roles[-1] if roles[0] == "s" else "~" + roles[-1]

    found = {"": (0, "", "")}

    def put(table, cost, audit, roles):
        k = key(roles)
        if re.fullmatch("s?(ua)*u?", roles) and (k not in table or (cost, audit) < table[k][:2]):
            table[k] = (cost, audit, roles)

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for cost, audit, roles in list(out.values()):
                for role in "ua":
                    put(out, cost + 5, audit + "I", roles + role)
        return out

    for symbol in symbols:
        after: dict = {}
        for cost, audit, roles in inserted(found).values():
            put(after, cost + 2, audit + "D", roles)
            if symbol != "-":
                extra = 5 if symbol.isupper() else 0
                put(after, cost + extra, audit + "K", roles + symbol.lower())
                for role in "ua":
                    put(after, cost + 1 + extra, audit + "R", roles + role)
        found = after
    return min(v for v in inserted(found).values() if RIGHT.fullmatch(v[2]))


def symbols_of(rng, n):
    return "".join(rng.choice("-suaxSUAX" if rng.random() < 0.5 else "ua") for _ in range(n))


def test_least_repairs_match_a_plain_search():
    rng = random.Random(1)
    cases = ["".join(c) for n in range(4) for c in itertools.product("-suaxSUAX", repeat=n)] + [symbols_of(rng, rng.randrange(4, 40)) for _ in range(400)]
    for symbols in cases:
        cost, audit, roles = plain_repair(symbols)
        assert least(parsed(symbols)) == (cost, audit), symbols
        told = placed(audit)
        assert "".join(role or "s" for edit, role in told if edit != "D") == roles
        assert [e for e, _ in told] == list(audit)


def test_any_way_to_split_a_span_gives_the_same_cells():
    rng = random.Random(2)
    for _ in range(40):
        symbols = symbols_of(rng, 9)
        chart = {(i, i + 1): edited(c) for i, c in enumerate(symbols)}
        for length in range(2, len(symbols) + 1):
            for i in range(len(symbols) - length + 1):
                every = [combined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
                assert all(cells == every[0] for cells in every)
                chart[i, i + length] = every[0]
        assert parsed(symbols) == chart[0, len(symbols)]


def plain_rows(rows, damage):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_repairs(rows, damage=True):
    damaged = plain_rows(rows, damage)
    got = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        if not own:
            got.append((conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        seen, counts, symbols = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, ""
        for _, _, role, text in own:
            core = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            s = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "-" if fault in ("blank", "duplicate") else s.upper() if fault else s
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, roles = plain_repair(symbols)
        lines, left, roles = [], list(own), list(roles)
        for letter in audit:
            row = left.pop(0) if letter != "I" else None
            if letter != "D":
                role = {"u": "user", "a": "assistant", "s": None}[roles.pop(0)]
                lines.append(f"{row[2]}:{row[3]}" if letter == "K" else f"{role}:{row[3] if row else ''}")
        got.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(got, key=str)


def sample():
    rng = random.Random(9)
    texts = ["Yes.", "No!", "what?", "cut off", "", " \t", None, "Good.\n", "e.g. this", "é."]
    roles = ["user", "assistant", "system", "tool", None, "", "unknown"]
    rows = []
    for conv in range(120):
        order = ["system", "user", "assistant"] if conv % 3 else ["user", "assistant"]
        for turn in range(rng.randrange(1, 14)):
            role = order[min(turn, len(order) - 2 + (turn - len(order)) % 2)] if rng.random() < 0.8 else rng.choice(roles)
            rows.append((conv if conv % 40 else None, turn + (turn > 5) * 2 if rng.random() < 0.95 else None, role, f"{rng.choice(texts) or ''}{turn}." if rng.random() < 0.6 else rng.choice(texts)))
    rows += rows[5:9] + [(500, 1, "user", "long " * 200_000 + "end."), (501, None, "user", None), (501, None, "user", None)]
    drop = next(k for k in range(10**4) if zlib.crc32(f"900:{k}".encode()) % 20 == 0)
    return rows + [(900, drop, "user", "gone.")]


def spread(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(6)


@pytest.mark.parametrize("segment", [1024, 3])
@pytest.mark.parametrize("damage", [True, False])
def test_repairs_match_plain_code(spark, monkeypatch, segment, damage):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rows = sample()
    got = repairs(spread(spark, rows), damage)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_repairs(rows, damage)


def test_a_conversation_of_a_third_of_all_rows(spark):
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"turn {k % 1500}.") for k in range(4000)] + [(100 + k, 0, "user", "Hi.") for k in range(8000)]
    assert sorted(map(tuple, repairs(spread(spark, rows)).collect()), key=str) == plain_repairs(rows)
    assert repairs(spread(spark, rows).limit(0)).count() == 0
