"""The operators once more, the plain way: one text or pair at a time, in memory."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log2

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

TOKENIZER_PATH = public_tokenizers.path("byte_bpe_50k.json")
_TOKENIZER = Tokenizer.from_file(TOKENIZER_PATH)


def token_ids(text):
    return [*_TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def crc32(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows):
    """[(doc_id, fingerprint, component)] of (doc_id, text) rows, sorted as text."""
    prints = [fingerprint(text) for _, text in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = components(len(rows), links)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root[k]] = min(least.get(root[k], doc_id), doc_id)
    return sorted(((doc_id, f"{prints[k]:016x}", least.get(root[k])) for k, (doc_id, _) in enumerate(rows)), key=str)


def smith_waterman(passage, item):
    """(score, matched words) of the best local alignment, ties to more matches."""
    row, best = [(0, 0)] * (len(passage) + 1), (0, 0)
    for w in item:
        new = [(0, 0)]
        for j, p in enumerate(passage):
            s, m = row[j]
            diagonal = (s + 1, m + 1) if p == w else (s - 1, m)
            up, left = row[j + 1], new[j]
            cell = max(diagonal, (up[0] - 1, up[1]), (left[0] - 1, left[1]), (0, 0))
            new.append(cell)
        row = new
        best = max(best, *row)
    return best


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def entropy_spans(text, window, candidate, classes, allowed, made_up, separators):
    found = []
    for m in re.finditer(candidate, text or ""):
        value = m[0]
        if not re.search("[0-9]", value) or not re.search("[A-Za-z]", value) or any(re.search(p, value) for p in allowed):
            continue
        threshold = next(t for _, shape, _, t in classes if re.search(shape, value))
        high = []
        for i in range(len(value) - window + 1):
            counts = Counter(value[i : i + window]).values()
            if -sum(c / window * log2(c / window) for c in counts) >= threshold - 1e-9 / window:
                high.append(i)
        span = value[high[0] : high[-1] + window] if high else ""
        others = "".join(p for p in re.split(separators, span) if not re.search(made_up, p))
        if high and (not re.search(made_up, span) or len(others) >= window):
            found.append((m.start() + high[0], 3, m.start() + high[-1] + window, "entropy"))
    return found


def cosine_links(rows, least=0.93):
    """[(vec_id, n_links, component)] of (vec_id, vector, label) rows."""
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for i, (_, v, lv) in enumerate(rows):
        for j in range(i):
            _, w, lw = rows[j]
            if usable(v, lv) and usable(w, lw) and lv == lw and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    links.append((i, j))
    root, degree = components(len(rows), links), Counter(k for pair in links for k in pair)
    least_id = {}
    for k, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least_id[root[k]] = min(least_id.get(root[k], vec_id), vec_id)
    return sorted(((vec_id, degree[k], least_id.get(root[k])) for k, (vec_id, _, _) in enumerate(rows)), key=str)
