"""Benchmark decontamination: rare words find candidates, local alignment scores them.

A copy matches all but e of an item's n words, in order, whatever is inserted between them. So of
any e + m of its words at least m are matched. The rarest e + m words of the item, by their number
in the corpus, are its seeds; a place where m of them meet is a candidate, which loses no copy.
The text around it is aligned with the item by Smith-Waterman.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyline.llm.common import raw_texts, slices, table, written

MIN_SIMILARITY = 0.8
# Seeds that must meet: more of them leave fewer chance candidates, and none costs a copy.
MEETING = 4
# Bytes of item texts that are sent to all tasks at once; more items are handled in as many blocks.
BLOCK_BYTES = 4 << 20
# Cells of alignment tables, or seed hits, held at once.
AT_ONCE = 1 << 20
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
# First and last code points of the blocks of scripts written without blanks between words.
UNSPACED = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007),
    (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F),
    (0xAA80, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFD),
]
_UNSPACED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "]")
_COUNT = pa.schema([("word", pa.int64()), ("times", pa.int64())])
_PASSAGE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item", pa.int32()), ("start_word", pa.int64()), ("passage", pa.string())])
_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("item", pa.int32()), ("score", pa.int64()), ("matched_words", pa.int64()),
     ("similarity", pa.float64()), ("start_word", pa.int64())]
)


@lru_cache(1 << 16)
def _part(ch: str) -> str:
    """What a character beyond ASCII is to words: ``own`` word, ``mark``, ``in`` a word, ``none``, or a blank."""
    category = unicodedata.category(ch)
    if category[0] == "M":
        return "mark"
    if category[0] in "LN":
        return "own" if category[0] == "L" and _UNSPACED.match(ch) else "in"
    # Joiners, soft hyphens and marks of direction are no part of the text; the zero-width space separates.
    return "none" if category == "Cf" and ch != "\u200b" else " "


def words_of(text: bytes | str) -> list[bytes]:
    """Lower-cased words: runs of letters, marks and digits; in scripts without blanks each letter with its marks."""
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    text = text.lower()
    if not text.isascii():
        own = []
        for ch in set(text):
            if ch > "\x7f":
                part = _part(ch)
                if part == " ":
                    text = text.replace(ch, " ")
                elif part == "none":
                    text = text.replace(ch, "")
                elif part == "own":
                    own.append(ch)
        if own:
            marks = "".join(ch for ch in set(text) if ch > "\x7f" and _part(ch) == "mark")
            text = re.sub(f"([{''.join(own)}]{f'[{marks}]*' if marks else ''})", r" \1 ", text)
    return text.encode("utf-8", "replace").translate(_KEEP).split()


class Items:
    """A block of benchmark items as numbers: the words of each."""

    def __init__(self, texts: list[str]):
        self.vocabulary: dict[bytes, int] = {}
        self.words = [
            np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)], np.int64) for t in texts
        ]
        self.lengths = np.array([len(w) for w in self.words], np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Words as numbers, -1 for those of no item."""
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def edits(n: int) -> int:
    """Words of an item of n words that a copy need not match."""
    return int(n * (1 - MIN_SIMILARITY) + 1e-9)


def _word_counts(items: Items):
    """How often each word of the items occurs, summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(items.vocabulary), np.int64)
        for batch in slices(batches):
            for text in raw_texts(batch):
                found = items.numbers(words_of(text))
                counts += np.bincount(found[found >= 0], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield table(_COUNT, word=some, times=counts[some])

    return run


class Seeds:
    """The rarest words of each item, and how many of them a copy must match."""

    def __init__(self, items: Items, times: np.ndarray):
        word, item, place, need = [], [], [], []
        for i, words in enumerate(items.words):
            e = edits(len(words))
            rarest = np.argsort(times[words], kind="stable")[: e + MEETING]
            word.append(words[rarest])
            item.append(np.full(len(rarest), i, np.int64))
            place.append(rarest)
            need.append(len(rarest) - e)
        self.need, self.lengths = np.array(need, np.int64), items.lengths
        words = np.concatenate(word)
        order = np.argsort(words, kind="stable")
        self.item, self.place = np.concatenate(item)[order], np.concatenate(place)[order]
        # Seeds of each word; the last entry is that of words of no item.
        self.count = np.r_[np.bincount(words, minlength=len(items.vocabulary)), 0]
        self.first = np.cumsum(self.count) - self.count

    def windows(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item, start, end) of the word ranges that may hold a copy.

        Up to each of its words, the best alignment adds no more words than it matches, so it lies
        within twice the item's words before and behind a seed.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        # Texts lie so far apart that no window meets two.
        starts = np.cumsum(lengths + 4 * int(self.lengths.max())) - lengths
        numbers = np.concatenate(texts)
        k = self.count[numbers]
        at = np.repeat(np.arange(len(numbers)), k)
        seed = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k) + self.first[numbers[at]]
        text = np.repeat(np.arange(len(texts)), lengths)[at]
        pos = at - (np.cumsum(lengths) - lengths)[text] + starts[text]
        item, place = self.item[seed], self.place[seed]
        order = np.lexsort((pos, item))
        text, pos, item, place = text[order], pos[order], item[order], place[order]
        # The last of the seeds that must meet, counted from each hit.
        last = np.arange(len(pos)) + self.need[item] - 1
        inside = np.minimum(last, len(pos) - 1)
        meets = np.flatnonzero((last < len(pos)) & (item[inside] == item) & (pos[inside] - pos < 2 * self.lengths[item]))
        change = np.zeros(len(pos) + 1, np.int64)
        np.add.at(change, meets, 1)
        np.add.at(change, last[meets] + 1, -1)
        kept = np.flatnonzero(np.cumsum(change[:-1]))
        text, item, start = text[kept], item[kept], pos[kept] - 2 * place[kept]
        order = np.lexsort((start, item))
        text, item, start = text[order], item[order], start[order]
        width = 2 * self.lengths[item] - 1
        new = np.r_[True, (item[1:] != item[:-1]) | (start[1:] > start[:-1] + width[1:])] if len(item) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(new)] - 1 if len(head) else head
        low = np.maximum(start[head] - starts[text[head]], 0)
        high = np.minimum(start[tail] + width[tail] - starts[text[head]], lengths[text[head]])
        return list(zip(text[head].tolist(), item[head].tolist(), low.tolist(), high.tolist()))


def _candidates(items: Items, seeds: Seeds):
    def passages(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for t, item, start, end in seeds.windows([numbers for *_, numbers in held]) if held else []:
            doc_id, key, words, _ = held[t]
            rows.append((doc_id, key, item, start, b" ".join(words[start:end]).decode("utf-8", "replace")))
        return table(_PASSAGE, **dict(zip(_PASSAGE.names, map(list, zip(*rows))) if rows else {n: [] for n in _PASSAGE.names}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held, hits = [], 0
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), raw_texts(batch)):
                words = words_of(text)
                numbers = items.numbers(words)
                own = int(seeds.count[numbers].sum())
                if own:
                    held.append((doc_id, key, words, numbers))
                    hits += own
                if hits > AT_ONCE:
                    yield passages(held)
                    held, hits = [], 0
            yield passages(held)

    return run


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over words: best local score, words matched on that path, and where it ends in the passage.

    A match gives 1, a replaced, added or missing word costs 1. All pairs advance together, one
    item word at a time; a cell holds score and matches in one number, so ties go to more matches.
    """
    unit = 1 << 24
    width, height, n = max(map(len, passages)), max(map(len, items)), len(items)
    text, pattern = np.full((n, width), -1, np.int64), np.full((n, height), -2, np.int64)
    for k in range(n):
        text[k, : len(passages[k])] = passages[k]
        pattern[k, : len(items[k])] = items[k]
    steps = np.arange(1, width + 1) * unit
    row = np.zeros((n, width + 1), np.int64)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(height):
        same = text == pattern[:, i : i + 1]
        real = pattern[:, i : i + 1] >= -1
        here = np.maximum(row[:, :-1] + np.where(same, unit + 1, -unit), row[:, 1:] - unit)
        here = np.maximum(here, 0)
        here = np.maximum.accumulate(here + steps, axis=1) - steps
        here = np.where(real, here, 0)
        top = here.argmax(axis=1)
        value = here[np.arange(n), top]
        end = np.where(value > best, top + 1, end)
        best = np.maximum(best, value)
        row[:, 1:] = here
    return best // unit, best % unit, end


def _score(items: Items):
    def scored(rows: list[tuple], texts: list[np.ndarray]) -> pa.RecordBatch:
        own = [items.words[r[2]] for r in rows]
        score, matched, end = align(texts, own)
        similarity = matched / np.array([len(w) for w in own])
        keep = np.flatnonzero(similarity >= MIN_SIMILARITY - 1e-9)
        return table(
            _SCORED, doc_id=[rows[k][0] for k in keep], text_key=[rows[k][1] for k in keep], item=[rows[k][2] for k in keep],
            score=score[keep], matched_words=matched[keep], similarity=similarity[keep],
            start_word=[max(rows[k][3], rows[k][3] + int(end[k]) - len(own[k])) for k in keep],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "passage"):
            rows = list(zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text_key", "item", "start_word"))))
            texts = [items.numbers(t.split()) for t in raw_texts(batch, "passage")]
            order = sorted(range(len(rows)), key=lambda k: (len(items.words[rows[k][2]]), len(texts[k])))
            held: list[int] = []
            for k in order:
                held.append(k)
                if len(held) * (len(texts[k]) + 1) > AT_ONCE or k == order[-1]:
                    yield scored([rows[j] for j in held], [texts[j] for j in held])
                    held = []

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """Benchmark items in blocks of bounded size, whatever their number."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        yield keyed.filter(F.col("block") == k).select("item_id", "text").collect()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, similarity, score, matched_words, start_word) per document and item it holds a copy of.

    A copy is a passage whose best local alignment with the item matches at least
    MIN_SIMILARITY of the item's words; matched_words, score and start_word describe the best one.
    ``text_key`` is the xxhash64 of the text, so documents with null or repeated ids can be told
    apart. Whole texts are read, wherever the passage lies. Null and empty texts and items hold
    nothing; repeated rows give one result; other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").filter("text IS NOT NULL")
    found = []
    for block in _blocks(benchmark):
        block = [row for row in block if words_of(row.text)]
        if not block:
            continue
        items = Items([row.text for row in block])
        counts = texts.select("text").mapInArrow(_word_counts(items), "word long, times long")
        times = np.zeros(len(items.vocabulary), np.int64)
        for row in counts.groupBy("word").agg(F.sum("times").alias("times")).collect():
            times[row.word] = row.times
        seeds = Seeds(items, times)
        passages = written(
            texts.mapInArrow(_candidates(items, seeds), "doc_id long, text_key long, item int, start_word long, passage string"), "passages"
        )
        scored = passages.repartition(F.xxhash64("doc_id", "text_key", "item", "start_word")).mapInArrow(
            _score(items), "doc_id long, text_key long, item int, score long, matched_words long, similarity double, start_word long"
        )
        ids = spark.createDataFrame([(k, row.item_id) for k, row in enumerate(block)], "item int, item_id long")
        best = F.max_by(F.struct("similarity", "score", "matched_words", "start_word"), F.struct("similarity", "score", -F.col("start_word")))
        found.append(
            scored.join(ids, "item").groupBy("doc_id", "text_key", "item_id").agg(best.alias("b")).select("doc_id", "text_key", "item_id", "b.*")
        )
    if not found:
        return spark.createDataFrame(
            [], "doc_id long, text_key long, item_id long, similarity double, score long, matched_words long, start_word long"
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no copy of a benchmark item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_key"))
    return docs.join(bad, same, "left_anti")
