"""The pipeline stage by stage against plain code, over the smallest tables and some odd documents."""

import re

import pytest
from pyspark.sql import functions as F
from reference import crc32, simhash_groups, smith_waterman, token_ids

import corpus_pipeline
from tallyline.llm.decontamination import MIN_SIMILARITY, words_of

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = [(9001, None), (9002, ""), (9003, "12 %%"), (9004, f"before {item.upper()} after"), (9005, "Mail a.b@c.example.org or 10.1.2.3 please")]
    made = spark.createDataFrame([(i, t, None, "odd", len(t or "")) for i, t in odd], real.schema)
    return real.unionByName(made)


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_order_and_columns(spark, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "pii_surrogates", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_language_stage_rejects_only_texts_without_a_letter(spark, docs):
    kept = texts(STAGES["language_id"](spark, docs, SF))
    assert kept == sorted((r.doc_id, r.text) for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text))


def test_dedup_stage_keeps_one_of_each_group(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted({component for _, _, component in simhash_groups(rows)})
    assert [i for i, _ in texts(STAGES["simhash_dedup"](spark, docs, SF))] == want


def test_decontamination_stage(spark, docs):
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = docs.filter("n_chars < 1500")
    want = [
        r.doc_id for r in short.collect()
        if not any(smith_waterman(words_of(r.text or ""), w)[1] >= MIN_SIMILARITY * len(w) for w in items)
    ]
    got = [i for i, _ in texts(STAGES["decontamination"](spark, short, SF))]
    assert got == sorted(want) and 9004 not in got


def test_surrogate_stage_changes_personal_data_only(spark, docs):
    before, after = dict(texts(docs)), dict(texts(STAGES["pii_surrogates"](spark, docs, SF)))
    assert before.keys() == after.keys()
    personal = re.compile(r"[\w.+-]+@[\w-]+\.\w[\w.]*\w|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+\d \(\d{3}\) \d{3}-\d{4}")
    for k, text in before.items():
        found = personal.findall(text or "")
        assert not any(x in after[k] for x in found)
        assert bool(found) == (text != after[k])


def test_run_packs_what_the_stages_leave(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    left = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
    want = {r.doc_id: token_ids(r.text) for r in left.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(want) and len(want) < table.count()
    for r in rows:
        assert crc32(want[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024


def test_every_query_reads_whole_tables(spark):
    import __spark_entry__ as entry

    names = {name.split("_")[0] for name in entry.queries() if name.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
    assert entry.queries()["op4_secret_scan"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").select(F.count("*")).first()[0]
