"""Personal data replaced by keyed surrogates, as column expressions, joins and groupings.

Entities are found by patterns, brought to a canonical form, and every different one gets one
surrogate of its kind and shape for the whole corpus, so mentions of one entity stay mentions
of one entity. Surrogates that two entities share, or that are an entity of the corpus, are
drawn again until none is left. Each mention is rendered in its own format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import joined_by_share, written

# Draws before the job gives up; more can only be needed if a kind's values are nearly used up.
MAX_DRAWS = 64

# Titles by gender, as people write them.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Г-жа", "Κυρία"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Г-н", "Κύριος"]
EITHER = ["Dr", "Prof"]

# Letters of the scripts that surrogates are written in.
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщыэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
# Syllables names are built of, sixteen a script, and the endings of given names by gender and of family names.
SYLLABLES = {
    "latin": "ba be bo da de do ka ko la le lo ma mi na ra to".split(),
    "cyrillic": "ба бе бо да де до ка ко ла ле ло ма ми на ра то".split(),
    "greek": "βα βε βο δα δε δο κα κο λα λε λο μα μι να ρα το".split(),
}
ENDINGS = {
    "latin": {"given_female": "lia", "given_male": "rin", "given": "ri", "family_female": "nsen", "family_male": "nsen", "family": "nsen"},
    "cyrillic": {"given_female": "лия", "given_male": "рин", "given": "ри", "family_female": "нова", "family_male": "нов", "family": "нко"},
    "greek": {"given_female": "λία", "given_male": "ρης", "given": "ρι", "family_female": "νου", "family_male": "νος", "family": "νου"},
}

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"
# With an IPv4 address as its end, whole, and with "::" for groups of zeros; all hold a digit, so that names such as ``a::b`` stay.
_MIXED = [rf"(?:{_GROUP}:){{6}}", rf"::(?:{_GROUP}:){{0,5}}", *[rf"(?:{_GROUP}:){{1,{k}}}:(?:{_GROUP}:){{0,{5 - k}}}" for k in range(1, 6)]]
_SHORT = [*[rf"(?:{_GROUP}:){{1,{k}}}(?::{_GROUP}){{1,{7 - k}}}" for k in range(1, 7)], rf":(?::{_GROUP}){{1,7}}", rf"(?:{_GROUP}:){{1,7}}:"]
IPV6 = (
    r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f]{0,4}:)(?=[0-9A-Fa-f:]*[0-9])"
    rf"(?:(?:{'|'.join(_MIXED)})(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])|(?:{_GROUP}:){{7}}{_GROUP}|{'|'.join(_SHORT)})(?![\p{{L}}\p{{N}}:])"
)
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{1,7}|(?:[0-9]{4}-){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])"
# Between the groups of a telephone number: one blank, dot, dash or slash, or parentheses.
_GAP = r"[ \x{A0}\x{2009}\x{202F}.\x{2010}-\x{2013}/-]"
_AHEAD = r"(?<![\p{L}\p{N}+]|[\p{L}\p{N}][.,:/_-])"
PHONE = "|".join(
    f"(?:{p})(?![\\p{{L}}\\p{{N}}])"
    for p in (
        rf"(?<![\p{{L}}\p{{N}}+])\+[0-9](?:(?:{_GAP}?\(|\){_GAP}?|{_GAP})?[0-9]){{7,14}}",
        r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-]?[0-9]{4}",
        # National: a leading zero and no date, or ten digits.
        rf"{_AHEAD}(?![0-9]{{2}}[./-][0-9]{{2}}[./-](?:19|20)[0-9]{{2}}(?![0-9]))0[0-9](?:{_GAP}?[0-9]){{7,10}}",
        rf"{_AHEAD}[2-9][0-9]{{4}}{_GAP}?[0-9]{{5}}",
    )
)
_NAME = r"\p{Lu}[\p{L}'’-]+"
PERSON = rf"(?<!\p{{L}})(?:{'|'.join(FEMALE + MALE + EITHER)})\.?\x20{_NAME}(?:\x20{_NAME})?"
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, IPV6, IPV4, IBAN, SSN, CARD, PHONE, PERSON))
# What every entity holds; tested first, as most texts hold none of it.
_HINT = rf"@|[0-9]{{3}}|[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]|::|[0-9]{_GAP}[0-9]|(?:{'|'.join(FEMALE + MALE + EITHER)})\.?\x20\p{{Lu}}"


def kind_of(entity: Column) -> Column:
    """The kind of a matched entity."""

    def whole(pattern: str) -> Column:
        return entity.rlike(f"^(?:{pattern})$")

    return (
        F.when(entity.contains("@"), "email")
        .when(whole(IPV6), "ipv6")
        .when(whole(IPV4), "ipv4")
        .when(whole(IBAN), "iban")
        .when(whole(SSN), "ssn")
        .when(whole(CARD), "card")
        .when(entity.rlike("^[0-9+(]"), "phone")
        .otherwise("person")
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _hexed(entity: Column) -> Column:
    """An IPv6 mention in small letters, an IPv4 address at its end as two groups of four digits."""
    low = F.lower(entity)
    octets = F.transform(F.split(F.substring_index(low, ":", -1), r"\."), lambda o: F.lpad(F.lower(F.hex(o.try_cast("int"))), 2, "0"))
    tail = F.concat(F.array_join(F.slice(octets, 1, 2), ""), F.lit(":"), F.array_join(F.slice(octets, 3, 2), ""))
    return F.when(low.contains("."), F.concat(F.regexp_replace(low, "[^:]*$", ""), tail)).otherwise(low)


def _groups(side: Column) -> Column:
    return F.filter(F.split(side, ":"), lambda g: g != "")


def with_address(mentions: DataFrame) -> DataFrame:
    """Adds the parts of an IPv6 mention: ``hexed``, and the groups ``before`` and ``behind`` the "::", all of them before if there is none.

    Each is a column of its own, so that what uses it several times does not repeat its expression.
    """
    hexed = F.col("hexed")
    behind = F.when(hexed.contains("::"), F.substring_index(hexed, "::", -1)).otherwise("")
    return mentions.withColumn("hexed", F.when(F.col("kind") == "ipv6", _hexed(F.col("mention")))).withColumns(
        {"before": _groups(F.substring_index(hexed, "::", 1)), "behind": _groups(behind)}
    )


def with_parts(mentions: DataFrame) -> DataFrame:
    """Adds ``parts``, the (kind, canonical value) pairs a mention refers to: one, or each name of a person."""
    mention, kind, words = F.col("mention"), F.col("kind"), F.col("words")
    title = F.rtrim(F.element_at(words, 1), F.lit("."))
    gender = F.when(title.isin(FEMALE), "_female").when(title.isin(MALE), "_male").otherwise("")
    before, behind = F.col("before"), F.col("behind")
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(before) - F.size(behind), F.lit(0)))
    # All eight groups with four digits each, so that every way to write an address is one value.
    address = F.array_join(F.transform(F.concat(before, zeros, behind), lambda g: F.lpad(g, 4, "0")), ":")
    value = (
        F.when(kind == "ipv6", address).when(kind.isin("email", "ipv4"), F.lower(mention))
        .otherwise(F.regexp_replace(F.upper(mention), "[^A-Z0-9]", ""))
    )
    names = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    persons = F.transform(
        F.col("names"),
        lambda name, i: F.struct(
            # Latin family names have one form, so a name is the same person's with and without a title that tells the gender.
            F.when(i < F.size("names") - 1, F.concat(F.lit("given"), F.col("gender")))
            .otherwise(F.concat(F.lit("family"), F.when(_script(name) == "latin", "").otherwise(F.col("gender"))))
            .alias("kind"),
            F.lower(name).alias("value"),
        ),
    )
    parted = with_address(mentions).withColumn("words", F.split(mention, " ")).withColumns({"names": names, "gender": gender, "value": value})
    parts = F.when(kind == "person", persons).otherwise(F.array(F.struct(kind.alias("kind"), F.col("value").alias("value"))))
    return parted.select(*mentions.columns, parts.alias("parts"))


def _stream(key: str, kind: Column, value: Column, draw: Column) -> Column:
    """128 hexadecimal digits that only holders of the key can tell."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, value, draw.cast("string"), F.sha2(F.concat(F.lit(key), value), 256)), 512)


def _number(stream: Column, i: Column, modulus: int) -> Column:
    """The i-th pseudo-random number below ``modulus``; streams of 32 numbers repeat with a shift, so long values stay mixed."""
    at = (F.pmod(i, F.lit(32)) * 4) + 1
    turn = F.floor(i / 32).cast("int") * 7
    return F.pmod(F.conv(stream.substr(at, F.lit(4)), 16, 10).cast("int") + turn, F.lit(modulus))


def _redrawn(text: Column, stream: Column) -> Column:
    """Each letter and digit replaced by one of its script and kind; other characters stay."""

    def one(ch: Column, i: Column) -> Column:
        def pick(letters: str) -> Column:
            return F.lit(letters).substr(_number(stream, i, len(letters)) + 1, F.lit(1))

        return (
            F.when(ch.rlike("[0-9]"), pick("0123456789"))
            .when(ch.rlike(r"\p{IsCyrillic}"), pick(CYRILLIC))
            .when(ch.rlike(r"\p{IsGreek}"), pick(GREEK))
            .when(ch.rlike(r"\p{L}"), pick(LATIN))
            .otherwise(ch)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string."""
    ordered = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(ordered, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _name(stream: Column, kind: Column, value: Column, draw: Column) -> Column:
    """A name of the value's script with the ending of its kind; later draws are longer."""
    script, found = _script(value), None
    count = F.least(F.lit(4) + F.floor(draw / 2).cast("int"), F.lit(16))
    for name, syllables in SYLLABLES.items():
        known = F.array(*[F.lit(s) for s in syllables])
        stem = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.element_at(known, _number(stream, i, 16) + 1)), "")
        ending = F.element_at(F.create_map(*[F.lit(x) for pair in ENDINGS[name].items() for x in pair]), kind)
        made = F.concat(stem, ending)
        found = F.when(script == name, made) if found is None else found.when(script == name, made)
    return found


def surrogate(key: str, kind: Column, value: Column, draw: Column) -> Column:
    """The canonical surrogate of a canonical value in a given draw."""
    # The forms of a name share the stem: kinds are keyed without their gender.
    stream = _stream(key, F.substring_index(kind, "_", 1), value, draw)
    mailbox, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    inner, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.substring_index(domain, ".", -1)
    mail = F.concat(
        _redrawn(mailbox, stream), F.lit("@"), _redrawn(inner, _stream(key, F.lit("domain"), domain, F.floor(draw / 8))), F.lit("."), top
    )  # the mailbox is drawn anew first, so that mentions of one domain keep one domain
    ipv4 = F.array_join(
        F.transform(F.split(value, r"\."), lambda o, i: F.when((i == 0) & o.isin("10", "127"), o).otherwise((_number(stream, i, 254) + 1).cast("string"))), "."
    )
    # Groups of zeros stay, so that a mention can leave them out.
    ipv6 = F.array_join(
        F.transform(
            F.split(value, ":"),
            lambda g, i: F.when((g == "0000") & value.rlike("[1-9a-f]"), g).otherwise(F.lower(F.hex(_number(stream, i, 0xF000) + 0x1000))),
        ),
        ":",
    )
    redrawn = _redrawn(F.lower(value), stream)
    iban = F.concat(value.substr(1, 2), F.upper(_redrawn(F.lower(value.substr(F.lit(3), F.length(value))), stream)))
    # A number that passes the Luhn test is replaced by one that does.
    body = redrawn.substr(F.lit(1), F.length(value) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    card = F.when(_luhn(value) == 0, F.concat(body, check.cast("string"))).otherwise(redrawn)
    return (
        F.when(kind == "email", mail).when(kind == "ipv4", ipv4).when(kind == "ipv6", ipv6).when(kind == "iban", iban)
        .when(kind == "card", card).when(kind.isin("phone", "ssn"), redrawn).otherwise(_name(stream, kind, value, draw))
    )


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two of a kind share a surrogate, and none is a value of the corpus."""
    known = written(entities.select("kind", "value").distinct(), "entities")
    taken = known.select("kind", F.col("value").alias("surrogate"))
    pending, done = known.withColumn("draw", F.lit(0)), None
    for _ in range(MAX_DRAWS):
        drawn = written(pending.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("value"), F.col("draw"))), "draws")
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        settled = written(first.select("kind", "value", "surrogate"), "surrogates")
        done = settled if done is None else done.unionByName(settled)
        left = drawn.join(settled, ["kind", "value"], "left_anti").select("kind", "value", (F.col("draw") + 1).alias("draw"))
        if left.isEmpty():
            return done
        pending = written(left, "redraws")
        taken = taken.unionByName(settled.select("kind", "surrogate"))
    raise RuntimeError("surrogates of some kind are used up")


def with_replacement(mentions: DataFrame) -> DataFrame:
    """Adds ``replacement``, a mention's surrogates ``new`` written in the mention's own format."""
    mention, kind, new, first, marks = (F.col(c) for c in ("mention", "kind", "new", "first", "marks"))
    bound = with_address(mentions).withColumns({"first": F.element_at(new, 1), "marks": F.split(mention, ""), "words": F.split(mention, " ")})
    # Letters and digits of the surrogate go where the mention has letters and digits.
    filled = F.array_join(
        F.transform(
            marks,
            lambda ch, i: F.when(
                ch.rlike("[A-Za-z0-9]"), first.substr(F.length(F.regexp_replace(mention.substr(F.lit(1), i + 1), "[^A-Za-z0-9]", "")), F.lit(1))
            ).otherwise(ch),
        ),
        "",
    )
    cased = F.array_join(
        F.transform(marks, lambda ch, i: F.when(ch.rlike(r"\p{Lu}"), F.upper(first.substr(i + 1, F.lit(1)))).otherwise(first.substr(i + 1, F.lit(1)))), ""
    )
    words = F.col("words")
    person = F.concat_ws(
        " ",
        F.element_at(words, 1),
        F.array_join(
            F.zip_with(new, F.slice(words, 2, F.size(new)), lambda n, w: F.when(w == F.upper(w), F.upper(n)).otherwise(F.initcap(n))), " "
        ),
    )

    def written_as(side: Column, skipped: Column) -> Column:
        groups = F.split(first, ":")
        return F.array_join(F.transform(side, lambda g, i: F.when(g.rlike("^0+$"), g).otherwise(F.get(groups, i + skipped))), ":")

    # An IPv6 address keeps its "::" and zeros, its kind of ending and its case.
    address = F.concat(
        written_as(F.col("before"), F.lit(0)),
        F.when(F.col("hexed").contains("::"), "::").otherwise(""),
        written_as(F.col("behind"), F.lit(8) - F.size("behind")),
    )
    tail = F.right(F.col("address"), F.lit(9))
    octets = [F.conv(tail.substr(at, 2), 16, 10) for at in (1, 3, 6, 8)]
    mixed = F.concat(F.col("address").substr(F.lit(1), F.length("address") - 9), F.concat_ws(".", *octets))
    shaped = (
        bound.withColumn("address", F.when(kind == "ipv6", address))
        .withColumn("address", F.when(mention.contains("."), mixed).otherwise(F.col("address")))
        .withColumn("address", F.when(mention.rlike("[A-F]") & ~mention.rlike("[a-f]"), F.upper("address")).otherwise(F.col("address")))
    )
    replacement = F.when(kind == "person", person).when(kind == "email", cased).when(kind == "ipv6", F.col("address")).when(kind == "ipv4", first).otherwise(filled)
    return shaped.select(*mentions.columns, replacement.alias("replacement"))


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """(mention, n, kind, replacement) for distinct mentions and how often each occurs.

    Every step is written, so a mention's kind, canonical value, surrogates and new text are each
    worked out once, and no expression holds another one several times.
    """
    kinds = written(mentions.withColumn("kind", kind_of(F.col("mention"))), "mention-kinds")
    parts = written(with_parts(kinds).select("mention", F.posexplode("parts").alias("place", "part")).select("mention", "place", "part.*"), "mention-parts")
    found = distinct_surrogates(parts.select("kind", "value"), key)
    new = (
        parts.join(found, ["kind", "value"])
        .groupBy("mention")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "surrogate"))), lambda x: x["surrogate"]).alias("new"))
    )
    return written(with_replacement(written(kinds.join(new, "mention"), "new-mentions")).select("mention", "n", "kind", "replacement"), "replacements")


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """The documents with all their columns, personal data in ``text`` replaced, and ``surrogate_kinds`` (kinds, one per mention).

    Whole texts are read, and matched once: the mentions are written next to the documents. Null
    and empty texts stay as they are. Every input row gives one row, whatever its id. Equal
    entities get equal surrogates in all documents, different ones different surrogates; without
    any entity the texts do not change. An existing column named surrogate_kinds is replaced.
    """
    columns = [c for c in docs.columns if c != "surrogate_kinds"]
    text = docs["text"]
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    scanned = written(
        docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), found.alias("mentions"), F.monotonically_increasing_id().alias("row_number")), "scanned"
    )
    hit = F.coalesce(F.size("mentions") > 0, F.lit(False))
    with_any = scanned.filter(hit)
    places = with_any.select("row_number", F.posexplode("mentions").alias("place", "mention"))
    # A mention may be in a large share of all texts: it is counted before it is joined.
    known = replacements(places.groupBy("mention").agg(F.count("*").alias("n")), key)
    new = (
        joined_by_share(places, known, ["mention"])
        .groupBy("row_number")
        .agg(F.array_sort(F.collect_list(F.struct("place", "replacement", "kind"))).alias("new"))
    )
    pieces = with_any.withColumn("gaps", F.split(F.col("row.text"), ENTITY, -1)).join(new, "row_number")
    whole = F.concat(
        F.array_join(F.zip_with("new", F.slice("gaps", 1, F.size("new")), lambda n, g: F.concat(g, n["replacement"])), ""), F.element_at(F.col("gaps"), -1)
    )
    changed = pieces.select(
        *[whole.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns],
        F.transform("new", lambda n: n["kind"]).alias("surrogate_kinds"),
    )
    unchanged = scanned.filter(~hit).select(*[F.col("row").getField(c).alias(c) for c in columns], F.array().cast("array<string>").alias("surrogate_kinds"))
    return changed.unionByName(unchanged)
