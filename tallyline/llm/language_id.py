"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled sample knows every string that occurs in the
sample. A text is parsed greedily into the longest strings that do: the better the language
fits, the fewer phrases. Phrases times the logarithm of the sample's length, over the text's
length, estimate the cross-entropy; the smallest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import id_and_text, slices, table

# The labelled sample: at most SAMPLE_ROWS whole texts per language, chosen by hashed id among those of at most
# SAMPLE_TEXT characters; a language that has only longer ones is learned from its shortest.
SAMPLE_ROWS = 64
SAMPLE_TEXT = 2_000
# Texts are parsed in stretches of so many characters at once, and the stretches then fitted together.
STRETCH = 512
# Pairs of a stretch and a language that advance together.
WIDTH = 16_384
# Rounds in which all stretches are fitted to the one before them; later ones wait for it.
ROUNDS = 4
UNDETERMINED = "und"
_PREDICTION = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def transitions(symbols: list[int]) -> list[dict[int, int]]:
    """The smallest automaton of all substrings: next state by symbol for each state."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = twin
                    p = link[p]
        last = new
    return step


class Edges:
    """Transitions of automata in one row, each state's symbols laid over those of others so that no two meet.

    A place holds state and target of the transition whose symbol leads there from the state's
    base, so one look tells a transition or that there is none. Size goes with the number of
    transitions, not with the alphabet.
    """

    def __init__(self, steps: list[list[dict[int, int]]], n_symbols: int):
        bases, rows, states, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
        for step in steps:
            base, row = _overlaid(step, n_symbols)
            used = row >= 0
            rows.append(np.where(used, ((row >> 32) + states << 32) | ((row & 0xFFFFFFFF) + states), -1))
            bases.append(base + places)
            states, places = states + len(step), places + len(row)
        self.base, self.row = np.concatenate(bases).astype(np.int32), np.concatenate(rows)

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + self.row.nbytes

    def next(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state each symbol leads to, -1 where none."""
        found = self.row[self.base[states] + symbols]
        return np.where(found >> 32 == states, found & 0xFFFFFFFF, -1)


def _overlaid(step: list[dict[int, int]], n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Base of each state, and the row of (state, target); states of many symbols are placed first, those of one fill the gaps."""
    n_edges = sum(map(len, step))
    base, row = np.zeros(len(step), np.int64), np.full(2 * n_edges + 2 * n_symbols + 256, -1, np.int64)
    low = 0
    for state in sorted((k for k, own in enumerate(step) if len(own) > 1), key=lambda k: -len(step[k])):
        own, at = np.fromiter(step[state], np.int64, len(step[state])), low
        while True:
            taken = (row[at + own[:, None] + np.arange(128)] >= 0).any(axis=0)
            if not taken.all():
                at += int(taken.argmin())
                break
            at += 128
            if at + n_symbols + 128 > len(row):
                row = np.r_[row, np.full(len(row), -1, np.int64)]
        base[state] = at
        row[at + own] = state << 32 | np.fromiter(step[state].values(), np.int64, len(own))
        # Where nearly every place is taken is not looked at again.
        while low + 1024 < at and (row[low : low + 256] >= 0).mean() > 0.9:
            low += 256
    single = [k for k, own in enumerate(step) if len(own) == 1]
    symbols = np.array([next(iter(step[k])) for k in single], np.int64)
    if len(single) + 2 * n_symbols > int((row < 0).sum()):
        row = np.r_[row, np.full(len(single) + 2 * n_symbols, -1, np.int64)]
    free = np.flatnonzero(row < 0)
    free = free[free >= n_symbols][: len(single)]
    base[single] = free - symbols
    row[free] = np.array(single, np.int64) << 32 | np.array([next(iter(step[k].values())) for k in single], np.int64)
    # Every base can be looked behind for any symbol.
    return base, np.r_[row[: int(max(np.flatnonzero(row >= 0), default=0)) + 1], np.full(n_symbols, -1, np.int64)]


class Languages:
    """Automata of all languages, fitted to a sample of whole texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        texts = [" ".join(t.lower() for t in samples[name]) for name in self.names]
        known = sorted(set().union(*(t.encode("utf-32-le", "replace").decode("utf-32-le") for t in texts)))
        # Every character of any sample has its number; one number stands for those of none.
        self.n_symbols = len(known) + 1
        self.symbol = np.full(0x110000, len(known), np.int32)
        self.symbol[[ord(ch) for ch in known]] = np.arange(len(known))
        steps = [transitions(self.numbers(t).tolist()) for t in texts]
        self.roots = np.cumsum([0, *map(len, steps)])[:-1].tolist()
        self.edges = Edges(steps, self.n_symbols)
        self.bits = np.array([np.log2(max(2, len(t))) for t in texts])

    def numbers(self, text: str) -> np.ndarray:
        """A text's symbols."""
        return self.symbol[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each lower-cased text (row) under each language (column), by a greedy parse of the whole text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        symbols = self.numbers("".join(texts))
        starts = np.cumsum(lengths) - lengths
        stretches = -(-lengths // STRETCH)
        text = np.repeat(np.arange(len(texts)), stretches)
        part = np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        start = starts[text] + part * STRETCH
        size = np.minimum(STRETCH, lengths[text] - part * STRETCH)
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        left = None
        width = max(16, WIDTH // max(1, len(self.names)))
        for at in range(0, len(text), width):
            own = slice(at, at + width)
            entry = start[at] + np.zeros(len(self.names), np.int64) if part[at] == 0 else left
            found, left = self._parse(symbols, start[own], size[own], (starts + lengths)[text[own]], part[own] == 0, entry)
            np.add.at(counts, text[own], found)
        return counts

    def _parse(
        self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, text_end: np.ndarray, first: np.ndarray, entry: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that start in each of some consecutive stretches, under each language, and where the last stretch is left.

        Each stretch is first parsed as if a phrase started with it. The true parse enters it where
        the one before is left, and runs on its own only until both start a phrase at one place; from there on
        they are the same. ``entry`` is where the first stretch is entered.
        """
        begins, leaves = self._alone(symbols, start, size, text_end)
        behind = begins[:, ::-1].cumsum(axis=1, dtype=np.int16)[:, ::-1]
        end = start + size
        counts, exits = behind[:, 0].astype(np.int64), leaves.copy()
        entries = np.where(first[:, None], start[:, None], 0) + np.zeros((1, len(self.names)), np.int64)
        entries[0] = entry
        parsed_from = np.repeat(start[:, None], len(self.names), axis=1)
        true = np.repeat(first[:, None], len(self.names), axis=1)
        true[0] = True
        rounds = 0
        while True:
            follows = np.flatnonzero(~first)
            follows = follows[follows > 0]
            entries[follows] = exits[follows - 1]
            due = entries != parsed_from
            if not due.any():
                return counts, exits[-1]
            if rounds >= ROUNDS:
                # Only stretches whose predecessor is final.
                for k in follows:
                    true[k] = true[k - 1] & ~due[k - 1]
                due &= true
            s, language = np.nonzero(due)
            counts[s, language], exits[s, language] = self._joined(
                symbols, entries[s, language], language, s, start, end[s], text_end[s], begins, behind, leaves[s, language]
            )
            parsed_from[s, language] = entries[s, language]
            rounds += 1

    def _alone(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin in stretches (stretch, place, language) parsed from their starts, and where the last phrases end."""
        order = np.argsort(-size, kind="stable")
        roots = np.array(self.roots, np.int64)[None, :]
        state = np.repeat(roots, len(start), axis=0)
        begins = np.zeros((int(size.max()), len(start), len(self.names)), bool)
        sorted_start = start[order]
        active = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1), side="right")
        for k, n in enumerate(active.tolist()):
            here = symbols[sorted_start[:n] + k]
            at = state[:n]
            # A phrase ends before a character that does not continue it, and behind an unseen one, which is a phrase by itself.
            to = self.edges.next(at, here[:, None])
            new = (to < 0) | (at == roots)
            begins[k, :n] = new
            again = self.edges.next(roots, here[:, None])
            state[:n] = np.where(new, np.where(again >= 0, again, roots), to)
        leaves = np.empty((len(start), len(self.names)), np.int64)
        ends, language = np.repeat((start + size)[order], len(self.names)), np.tile(np.arange(len(self.names)), len(start))
        leaves[order] = self._run_on(symbols, ends, state.ravel(), language, np.repeat(text_end[order], len(self.names))).reshape(len(start), -1)
        back = np.argsort(order)
        return begins.transpose(1, 0, 2)[back], leaves

    def _run_on(self, symbols: np.ndarray, at: np.ndarray, state: np.ndarray, language: np.ndarray, text_end: np.ndarray) -> np.ndarray:
        """Where the phrases that are in a state at a place end."""
        at, roots, left = at.copy(), np.array(self.roots, np.int64)[language], np.flatnonzero(at < text_end)
        state = state.copy()
        while len(left):
            to = self.edges.next(state[left], symbols[at[left]])
            goes = (to >= 0) & (state[left] != roots[left])
            left, to = left[goes], to[goes]
            state[left] = to
            at[left] += 1
            left = left[at[left] < text_end[left]]
        return at

    def _joined(self, symbols, at, language, s, start, end, text_end, begins, behind, leaves) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and exits of stretches ``s`` entered at ``at``: own phrases up to a place where one begins anyway, or to the stretch's end."""
        at, counts, exits = at.copy(), np.zeros(len(s), np.int64), np.empty(len(s), np.int64)
        roots = np.array(self.roots, np.int64)[language]
        left = np.arange(len(s))
        while len(left):
            # All in ``left`` are where a phrase begins.
            out = at[left] >= end[left]
            exits[left[out]] = at[left[out]]
            left = left[~out]
            place = at[left] - start[s[left]]
            met = begins[s[left], place, language[left]]
            same = left[met]
            counts[same] += behind[s[same], place[met], language[same]]
            exits[same] = leaves[same]
            left = left[~met]
            counts[left] += 1
            to = self.edges.next(roots[left], symbols[at[left]])
            state = np.where(to >= 0, to, roots[left])
            at[left] = self._run_on(symbols, at[left] + 1, state, language[left], text_end[left])
        return counts, exits

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text with a letter, UNDETERMINED and 0 for the others."""
        names = [UNDETERMINED] * len(texts)
        scores = np.zeros(len(texts))
        with_letters = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))]
        if not self.names or not with_letters:
            return names, scores
        lower = [texts[k].lower() for k in with_letters]
        entropy = self.phrases(lower) * self.bits / np.array([len(t) for t in lower])[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        # The share of the winner when each language weighs by how much shorter its parse is.
        weight = np.exp2(-8 * (entropy / least[:, None] - 1))
        scores[with_letters] = 1 / weight.sum(axis=1)
        for k, b in zip(with_letters, best.tolist()):
            names[k] = self.names[b]
        return names, scores


def held_out() -> Column:
    """Whether a document may not be learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> Languages:
    """Learn from the sample: rows are chosen by hashed id and the text's length, texts are read for the chosen ones only.

    At most SAMPLE_ROWS + 1 ids and SAMPLE_ROWS texts per language reach the driver.
    """
    learnable = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    key, length = F.xxhash64(F.col("doc_id")), F.length("text")
    named = learnable.select(F.col("lang").cast("string").alias("lang"), key.alias("key"), F.col("doc_id").cast("long").alias("id"), length.alias("length"))
    short = named.filter(F.col("length") <= SAMPLE_TEXT).groupBy("lang", F.pmod("key", F.lit(SAMPLE_ROWS)).alias("lot"))
    chosen = short.agg(F.min(F.struct("key", "id")).alias("s")).select("lang", "s.id")
    shortest = named.groupBy("lang").agg(F.min(F.struct("length", "key", "id")).alias("s")).select("lang", "s.id")
    ids: dict[str, set[int]] = {}
    for row in chosen.collect():
        ids.setdefault(row.lang, set()).add(row.id)
    for row in shortest.collect():
        ids.setdefault(row.lang, {row.id})
    samples: dict[str, list[str]] = {}
    if ids:
        wanted = sorted(set().union(*ids.values()))
        rows = learnable.filter(F.col("doc_id").isin(wanted)).groupBy(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"))
        # Of rows that repeat an id the shortest text counts, then the least.
        for row in sorted(rows.agg(F.min(F.struct(length.alias("length"), "text")).alias("s")).select("id", "lang", "s.text").collect(), key=lambda r: (r.lang, r.id)):
            if row.id in ids[row.lang]:
                samples.setdefault(row.lang, []).append(row.text)
    return Languages(samples)


def predict(docs: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    A null text or one without a letter gives UNDETERMINED with score 0, as does every text when
    nothing could be learned. Every input row gives one row; a null doc_id counts as not held
    out. Ties between languages go to the first by name. Only the text decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield table(_PREDICTION, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=names, score=scores)

    rows = id_and_text(docs).withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Fit on the labelled documents that are not held out, and predict all."""
    return predict(docs, fit(docs))


def with_language(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose language could be told; those rejected have no letter or no text."""
    languages = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch])):
                names, _ = shared.value.predict([t or "" for t in part.column("text").to_pylist()])
                yield part.filter(pa.array([n != UNDETERMINED for n in names]))

    return docs.mapInArrow(run, schema)
