"""Whole texts to token ids with a public byte-level BPE tokenizer, fast enough for a scan."""

from __future__ import annotations

import json
import os
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Pieces kept per Python worker before the table starts anew, none if one is longer than LONGEST_KEPT; bounds its memory, changes no result.
KEPT_PIECES = 350_000
LONGEST_KEPT = 65_536
END_ID = 2
# The pattern that byte-level BPE cuts texts by, and how its vocabulary shows bytes:
# printable Latin-1 characters as themselves, the others as the characters from 256 on, in order.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# A line end before white space, which is any character that some reader takes for it.
_LINE_AND_BLANK = r"\n[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_AS_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
# Letters in every version of Unicode: a word of them is one piece, and so are stops behind it. Other words are cut by the pattern.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481]"
_ONE_PIECE = f"^ ?{_LETTERS}+$"
_TWO_PIECES = f"^(?P<word> ?{_LETTERS}+)(?P<stops>[.,;:!?]+)$"
# The character of each byte; byte 0 parts pieces and occurs in none.
BYTES_AS_SHOWN = np.arange(256, dtype="<u4")
BYTES_AS_SHOWN[[b for b in range(256) if b not in _AS_SHOWN]] = 256 + np.arange(256 - len(_AS_SHOWN))
BYTES_AS_SHOWN[0] = 0
# New words that are looked at together.
_LOT = 4096


class _Words(dict):
    """Numbers words as they are first asked for and remembers which are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class _Ids:
    """Id lists by number, kept as one flat array."""

    def __init__(self):
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def of(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered lists one after another, and the end of each."""
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        shift = self.starts[index] - (ends - lengths)
        return self.flat[np.arange(int(lengths.sum())) + np.repeat(shift, lengths)], ends


class Encoder:
    """Ids of texts by the tokenizers library, each different piece encoded once.

    The byte-level pattern starts a new piece at every blank that follows a non-blank and
    precedes a non-blank, so a text cut there encodes to the concatenated ids of its words; a
    word is cut into pieces by the same pattern, and the tokenizer's own model encodes each
    different piece. A line end before a non-blank is a piece of its own. Texts with doubled, leading
    or trailing blanks, words with other white space or a special token inside, and other kinds
    of tokenizers go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        kind = told["pre_tokenizer"] or {}
        self.by_words = (
            kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not told["normalizer"]
        )
        self.special = [t["content"] for t in told["added_tokens"]]
        self._reset()

    def _reset(self) -> None:
        self.pieces, self.piece_ids, self.longest = _Words(), _Ids(), 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of pieces, new ones included; those behind a byte 0 are words for the whole tokenizer."""
        found = np.array(itemgetter(*pieces)(self.pieces) if len(pieces) > 1 else [self.pieces[w] for w in pieces], np.int64)
        new, self.pieces.new = self.pieces.new, []
        if new:
            self.longest = max(self.longest, max(map(len, new)))
            ids: list[list[int]] = [self._ids(p[1:]) if p[0] == "\0" else [] for p in new] if any(p[0] == "\0" for p in new) else [[]] * len(new)
            own = [k for k, p in enumerate(new) if p[0] != "\0"]
            if own:
                data = "\0".join([new[k] for k in own] if len(own) < len(new) else new).encode()
                shown = BYTES_AS_SHOWN[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le").split("\0")
                told = [[token.id for token in self.tokenizer.model.tokenize(piece)] for piece in shown]
                if len(own) == len(new):
                    ids = told
                else:
                    for k, found_ids in zip(own, told):
                        ids[k] = found_ids
            self._add(ids)
        return found

    def _add(self, ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.piece_ids.add(np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths)

    def _plain(self, words: list[str]) -> np.ndarray:
        """Which words are one run of non-blanks behind at most one blank; mostly all are, which is told at once."""
        joined = "\n" + "\n".join(words)
        runs = joined.split()
        all_plain = len(runs) == len(words) and joined.replace("\n ", "\n") == "\n" + "\n".join(runs)
        if all_plain and "\0" not in joined and not any(special in joined for special in self.special):
            return np.ones(len(words), bool)
        return np.array([self._is_plain(word) for word in words], bool)

    def _is_plain(self, word: str) -> bool:
        parts = word.split()
        return len(parts) == 1 and word in (parts[0], " " + parts[0]) and "\0" not in word and not any(special in word for special in self.special)

    def _cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Pieces of words one after another, and how many each has, by the pattern."""
        plain = np.concatenate([self._plain(words[k : k + _LOT]) for k in range(0, len(words), _LOT)]) if words else np.zeros(0, bool)
        counts = np.ones(len(words), np.int64)
        own = [word for word, ok in zip(words, plain) if ok]
        cut = _PATTERN.findall("\n".join(own)) if own else []
        pieces, edges = [piece for piece in cut if piece != "\n"], np.array([piece == "\n" for piece in cut], bool)
        if own:
            word = np.cumsum(edges)[~edges]
            counts[plain] = np.bincount(word, minlength=len(own))
        if plain.all():
            return pieces, counts
        out, left = [], iter(pieces)
        for word, ok, n in zip(words, plain, counts.tolist()):
            out.extend([next(left) for _ in range(n)] if ok else ["\0" + word])
        return out, counts

    def _pieces_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of words one after another, and how many each has; most are told by their letters, without Python."""
        single = pc.match_substring_regex(words, _ONE_PIECE).to_numpy(zero_copy_only=False)
        parted = pc.extract_regex(words, _TWO_PIECES)
        double = parted.is_valid().to_numpy(zero_copy_only=False) & ~single
        if any(special.replace(" ", "").isalpha() for special in self.special):
            # A special token of letters alone may be inside any word.
            single, double = np.zeros(len(words), bool), np.zeros(len(words), bool)
        rest = ~(single | double)
        parted = parted.filter(pa.array(double))
        plain = pa.concat_arrays([words.filter(pa.array(single)), parted.field("word"), parted.field("stops")]).dictionary_encode()
        cut, cut_counts = self._cut(words.filter(pa.array(rest)).to_pylist())
        numbers = self._numbers(plain.dictionary.to_pylist())[plain.indices.to_numpy(zero_copy_only=False)]
        cut_numbers = self._numbers(cut)
        counts = np.where(double, 2, 1)
        counts[rest] = cut_counts
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        ns, nd = int(single.sum()), int(double.sum())
        out[starts[single]] = numbers[:ns]
        out[starts[double]] = numbers[ns : ns + nd]
        out[starts[double] + 1] = numbers[ns + nd :]
        out[np.repeat(rest, counts)] = cut_numbers
        return out, counts

    def encode(self, texts: list[str] | pa.Array, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has; ``end`` appends END_ID to each."""
        if len(self.pieces) > KEPT_PIECES:
            self._reset()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        filled = pc.greater(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        cut = filled & self._can_be_cut(column)
        # Words are told apart where the column lies; Python sees each different piece once.
        lists = pc.split_pattern(self._marked(column.filter(pa.array(cut))), "\0")
        words = pc.list_flatten(lists).dictionary_encode()
        pieces, pieces_each = self._pieces_of(words.dictionary)
        # A word's own ids, for the words of this call, and those of texts that are not cut.
        of_pieces, ends = self.piece_ids.of(pieces)
        lengths = np.diff(np.r_[0, ends][np.r_[0, np.cumsum(pieces_each)]])
        known = _Ids()
        known.add(of_pieces, lengths)
        whole = [self._ids(text) for text in column.filter(pa.array(filled & ~cut)).to_pylist()]
        known.add(np.fromiter(chain.from_iterable(whole), np.int32), np.array([len(x) for x in whole], np.int64))
        counts = filled.astype(np.int64)
        counts[cut] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        index = np.empty(int(counts.sum()), np.int64)
        by_word = np.repeat(cut, counts)
        index[by_word] = words.indices.to_numpy(zero_copy_only=False)
        index[~by_word] = len(lengths) + np.arange(len(whole))
        ids, ends = known.of(index)
        edges = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        if self.longest > LONGEST_KEPT:
            # Very long pieces, as of texts without blanks, are not kept.
            self._reset()
        if end:
            ids = np.insert(ids, edges[1:], END_ID)
            edges = edges + np.arange(len(edges))
        return ids, np.diff(edges)

    def _can_be_cut(self, column: pa.Array) -> np.ndarray:
        """Texts without doubled, leading or trailing blanks, and without the mark."""
        if not self.by_words:
            return np.zeros(len(column), bool)
        whole = [
            pc.match_substring(column, "  "), pc.match_substring(column, "\0"), pc.starts_with(column, " "), pc.starts_with(column, "\n"),
            pc.ends_with(column, " "),
        ]
        return ~np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in whole])

    @staticmethod
    def _marked(column: pa.Array) -> pa.Array:
        """A mark before every blank, and around line ends where each is a piece of its own."""
        marked = pc.replace_substring(column, " ", "\0 ")
        lines = pc.and_(pc.invert(pc.ends_with(column, "\n")), pc.invert(pc.match_substring_regex(column, _LINE_AND_BLANK)))
        return pc.if_else(lines, pc.replace_substring(marked, "\n", "\0\n\0"), marked)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
