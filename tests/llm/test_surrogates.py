"""Surrogates against plain code: finding, canonical form, distinctness, coreference, and the size of the plan."""

import ipaddress
import random
import re as plain

import pytest
import regex
from pyspark.sql import functions as F

from tallyline.llm import surrogates
from tallyline.llm.surrogates import ENTITY, FEMALE, MALE, replaced

JAVA = regex.compile(plain.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), ENTITY).replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
NAMES = ["Smith", "Baker", "Miller", "Anna", "John", "Иванов", "Παππάς"]


def sample(rng):
    octets = [rng.randrange(256) for _ in range(4)]
    groups = [rng.choice([0, 0, rng.randrange(1, 65536)]) for _ in range(8)]
    groups[rng.randrange(8)] = 0x20A1
    address = ipaddress.IPv6Address(int("".join(f"{g:04x}" for g in groups), 16))
    digits = [str(rng.randrange(10)) for _ in range(16)]
    return rng.choice([
        f"user{rng.randrange(40)}@mail{rng.randrange(4)}.example.org", f"User{rng.randrange(40)}@Mail{rng.randrange(4)}.Example.ORG",
        ".".join(map(str, octets)), str(address), address.exploded, str(address).upper(),
        f"+44 20 7946 {rng.randrange(10**4):04d}", f"+4420 7946 {rng.randrange(10**4):04d}", f"({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}",
        "4" + "".join(digits[1:]), " ".join("4" + "".join(digits[1:4]) if k == 0 else "".join(digits[4 * k : 4 * k + 4]) for k in range(4)),
        f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        f"{rng.choice(FEMALE + MALE)} {rng.choice(NAMES)} {rng.choice(NAMES)}", f"Dr. {rng.choice(NAMES).upper()}",
    ])


def entities(mention):
    """The (kind, canonical value) pairs of a mention, told by plain code."""
    if "@" in mention:
        return [("email", mention.lower())]
    try:
        address = ipaddress.ip_address(mention)
        return [("ip", str(address.exploded))]
    except ValueError:
        pass
    if regex.match(r"[0-9+(]", mention):
        digits = plain.sub(r"\D", "", mention)
        kind = "ssn" if plain.fullmatch(r"\d{3}-\d{2}-\d{4}", mention) else "card" if len(digits) == 16 else "phone"
        return [(kind, digits)]
    title, *names = mention.split(" ")
    title = title.rstrip(".")
    gender = "f" if title in FEMALE else "m" if title in MALE else ""
    last = len(names) - 1
    return [("family" + (gender if ord(n[0]) > 0x300 else "") if i == last else "given" + gender, n.lower()) for i, n in enumerate(names)]


def test_brute_force_on_a_thousand_texts(spark):
    rng = random.Random(5)
    texts = []
    for k in range(1000):
        words = [f"word{rng.randrange(50)}x" for _ in range(rng.randrange(1, 30))]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), sample(rng) + ",")
        texts.append(" ".join(words))
    texts[7] = " ".join(["filler"] * 30_000 + ["a.b@c.example.org"] + ["filler"] * 30_000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = {r.doc_id: r for r in replaced(df, "key").collect()}
    assert sorted(new) == list(range(1000))
    forms: dict = {}
    for k, text in enumerate(texts):
        found = [m[0] for m in JAVA.finditer(text)]
        gaps = JAVA.split(text)
        assert len(new[k].surrogate_kinds) == len(found), (text, new[k])
        # Whatever lies between the mentions stays, in its order.
        at, cut = 0, []
        for gap in gaps:
            here = new[k].text.index(gap, at) if gap else at
            cut.append((here, here + len(gap)))
            at = here + len(gap)
        assert cut[0][0] == 0 and new[k].text.endswith(gaps[-1])
        made = [m[0] for m in JAVA.finditer(new[k].text)]
        assert len(made) == len(found), (text, new[k].text)
        for before, after in zip(found, made):
            assert before != after
            if not before[0].isalpha() or "@" in before or ":" in before:
                assert plain.sub(r"[0-9a-z]+", "0", before.lower()) == plain.sub(r"[0-9a-z]+", "0", after.lower())
            for old, fresh in zip(entities(before), entities(after), strict=True):
                assert forms.setdefault(old, fresh) == fresh
    for kind in {kind for kind, _ in forms}:
        mine = {old: fresh for old, fresh in forms.items() if old[0] == kind}
        assert len({fresh[1] for fresh in mine.values()}) == len(mine), kind
        assert not {fresh[1] for fresh in mine.values()} & {old[1] for old in forms}


def test_one_mention_in_very_many_rows(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("mail a@b.example.org "), F.col("id"))).otherwise("x").alias("text"))
    got = replaced(rows, "key")
    new = got.filter("size(surrogate_kinds) = 1").selectExpr("split(text, ' ')[1] AS mail").distinct().collect()
    assert len(new) == 1 and got.count() == 20_000


@pytest.mark.parametrize("step", ["whole", "canonical", "rendered", "drawn"])
def test_plans_stay_small(spark, step):
    df = spark.createDataFrame([(1, "a@b.example.org and ::1")], "doc_id long, text string")
    mentions = spark.createDataFrame([("::1", "ipv6", ["x"], 1)], "mention string, kind string, new array<string>, n long")
    made = {
        "whole": lambda: replaced(df, "key"),
        "canonical": lambda: surrogates.with_parts(mentions),
        "rendered": lambda: surrogates.with_replacement(mentions),
        "drawn": lambda: mentions.select(surrogates.surrogate("key", F.col("kind"), F.col("mention"), F.lit(0))),
    }[step]()
    assert len(made._jdf.queryExecution().optimizedPlan().toString()) < 100_000
