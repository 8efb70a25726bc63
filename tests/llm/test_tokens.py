import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from reference import TOKENIZER_PATH, crc32, token_ids

from tallyline.llm import packing
from tallyline.llm.token_files import read_token_files, token_index, write_token_files
from tallyline.llm.tokens import Encoder

ODD = [
    "", " ", " a", "a ", "a  b", "a\nb c", "a \n b\n\n c\t", "a\n\tb", "x\t\t\ny z\n", "a\r\nb", "a\x00b c\nd", "é  b", "don't 're", "　y",
    "<|endoftext|> x<|endoftext|>\ny", "   z", "12a 3,4", "😀 🧑‍🚀x", "[]{}!!  ?", "\n", "word " * 50 + "end",
]


def encoded(texts):
    ids, lengths = Encoder(TOKENIZER_PATH).encode(texts)
    return [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]


def test_odd_texts_encode_as_the_tokenizer_does():
    assert encoded(ODD) == [token_ids(t) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r ab.,'9é<|>\x00", max_size=30), min_size=1, max_size=5))
def test_any_text_encodes_as_the_tokenizer_does(texts):
    assert encoded(texts) == [token_ids(t) for t in texts]


ROWS = [(3, "b c", "x"), (1, None, "x"), (None, "n", "x"), (2, "long " * 3000, "x"), (3, "b c", "x"), (7, "", "x"), (5, "a\nb", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, part string")


def test_token_files_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    write_token_files(docs, path, TOKENIZER_PATH)
    want, at = [], 0
    for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = token_ids(text)
        want.append((doc_id, at, len(ids), crc32(ids)))
        at += len(ids)
    got = [tuple(r) for r in token_index(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    one = read_token_files(spark, path).filter("doc_id = 5")
    assert one.first().token_ids == token_ids("a\nb")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in one._jdf.queryExecution().toString()


def test_no_documents(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    write_token_files(docs.limit(0), path, TOKENIZER_PATH)
    assert token_index(spark, path).count() == 0
    assert packing.pack(docs.limit(0), TOKENIZER_PATH).count() == 0


def test_packing_holds_every_token_once(spark, docs):
    rows = packing.pack(docs.unionByName(docs), TOKENIZER_PATH, 64).collect()
    sequences, pieces = {}, []
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.append((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    want = []
    for doc_id, text, _ in ROWS * 2:
        ids = token_ids(text)
        want += [(doc_id, k, s, n, crc32(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
    assert sorted(pieces, key=str) == sorted(want, key=str)


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 24))
def test_fullest_is_the_best_subset_sum(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    used = packing.fullest(counts, room)
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
    assert all(n <= counts[k] for k, n in used.items())


def test_plan_is_near_the_lower_bound_and_small():
    counts = {int(k): int(n) for k, n in enumerate(np.random.default_rng(0).integers(0, 10**6, 1025)) if k and n}
    kinds = packing.plan(counts, 1024)
    left = dict(counts)
    for times, used in kinds:
        assert sum(k * n for k, n in used.items()) <= 1024
        for k, n in used.items():
            left[k] -= n * times
    assert not any(left.values())
    bound = -(-sum(k * n for k, n in counts.items()) // 1024)
    assert sum(times for times, _ in kinds) <= bound * 1.005 and len(kinds) < 20_000


def test_packing_encodes_little_text_at_once(monkeypatch):
    seen = []

    class Seen:
        def encode(self, texts):
            seen.append(sum(len(t) for t in texts.to_pylist()))
            return np.zeros(len(texts), np.int32), np.ones(len(texts), np.int64)

    monkeypatch.setattr(packing, "encoder", lambda path: Seen())
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array(["x" * 100_000] * 80)], names=["doc_id", "text"])
    found = list(packing._cut_pieces("", 1024)(iter([batch])))
    assert sum(b.num_rows for b in found) == 80 and sum(seen) == 8_000_000 and max(seen) <= (1 << 20) + 100_000
