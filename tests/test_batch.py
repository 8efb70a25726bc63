import copy
import json

import duckdb
import pytest
from oracle_compare import TABLES, connect, difference
from pyspark.sql import functions as F
from samples import CELLS, FILE, SHEET, expected_marker, line, raw, selection, write_workbook

from tallyline.errors import ContractViolation, ResultNotFound
from tallyline.operators import compare as cmp
from tallyline.operators import contracts as chk
from tallyline.operators import landing as land
from tallyline.operators import product_day as pday
from tallyline.operators import publish as pub
from tallyline.operators.reconcile import reconcile
from tallyline.operators.scope import row_diff, scope_ids
from tallyline.operators.typed import typed_lines
from tallyline.plans import batch_run as br
from tallyline.plans import catalog
from tallyline.plans.catalog import QUERIES
from tallyline.plans.compare_run import compare_published
from tallyline.plans.oracles import ORACLES
from tallyline.sources.files import (
    binary_files, fingerprint_files, jsonl_violations, manifest_selection, manifest_violations, read_jsonl, read_manifests,
)
from tallyline.sources.workbook import raw_sheet_rows, scan_workbooks, workbook_errors


@pytest.fixture()
def store(spark, tmp_path):
    return br.Store(spark, str(tmp_path / "store"))


def run(store, run_id, numbers, cells=CELLS, **more):
    return br.run_batch(
        store, run_id, raw(store.spark, numbers, cells), selection(store.spark, numbers), input_path="in", **more
    )


def totals(df):
    return {r.stock_code: (r.sample_quantity_sum, r.observed_row_count) for r in df.collect()}


def states(store):
    return {r.run_id: r.status for r in pub.run_state(store.run_events).collect()}


def test_same_input_twice_lands_once_and_counts_repeated_rows(store):
    numbers = [31, 32, 34, 37, 38, 75]
    run(store, "r1", numbers)
    run(store, "r2", numbers)
    day = totals(br.current_days(store))
    assert day["TEA"] == (8, 2) and day["6001"] == (9, 1) and day["BACK"] == (-5, 1)
    assert store.landed.count() == 6
    rows = store.contributions().filter("run_id = 'r2' AND stock_code = 'TEA'")
    assert sorted(r.source_row_number for r in rows.collect()) == [31, 38]
    assert br.current_days(store).first().run_id == "r2"
    chk.assert_no_columns(br.current_days(store), ["customer"])
    chk.assert_no_columns(store.contributions(), ["customer"])
    assert states(store) == {"r1": "succeeded", "r2": "succeeded"}


def test_zero_is_present_and_absent_is_absent(store):
    run(store, "r1", [31, 41, 75])
    day = totals(br.current_days(store))
    assert day["NONE-SOLD"] == (0, 1) and "OTHER" not in day


@pytest.mark.parametrize("cell, value", [(3, "1.5"), (3, None), (1, None), (5, None), (4, "2010")])
def test_refused_rows_leave_the_last_good_result(store, cell, value):
    run(store, "good", [31, 32])
    cells = copy.deepcopy(CELLS)
    cells[31][cell] = value
    with pytest.raises(ContractViolation, match="source_row_number=31"):
        run(store, "bad", [31], cells)
    assert br.current_days(store).first().run_id == "good"
    assert states(store)["bad"] == "failed"
    with pytest.raises(ResultNotFound):
        br.published_days(store, "bad")


@pytest.mark.parametrize("numbers, message", [([], "nothing"), ([1, 31], "not_a_data_row"), ([31, 31], "duplicate")])
def test_bad_selections_are_refused(store, numbers, message):
    with pytest.raises(ContractViolation, match=message):
        br.run_batch(store, "r", raw(store.spark, [31]), selection(store.spark, numbers), input_path="in")


def test_missing_selected_rows_are_named(store):
    with pytest.raises(ContractViolation, match="source_row_number=32"):
        br.run_batch(store, "r", raw(store.spark, [31]), selection(store.spark, [31, 32]), input_path="in")


def test_failure_after_the_result_was_written_is_not_published(store, monkeypatch):
    run(store, "good", [31, 32])
    real = br.Store.log

    def boom(self, run_id, status, *args, **more):
        if status == "succeeded":
            raise RuntimeError("lost")
        real(self, run_id, status, *args, **more)

    monkeypatch.setattr(br.Store, "log", boom)
    with pytest.raises(RuntimeError, match="lost"):
        run(store, "half", [32])
    monkeypatch.setattr(br.Store, "log", real)
    assert br.current_days(store).first().run_id == "good"
    orphans = pub.orphan_results(store.days, pub.publications(store.run_events))
    assert [r.run_id for r in orphans.collect()] == ["half"]


def test_a_run_id_is_used_once(store):
    run(store, "r", [31, 32])
    before = totals(br.published_days(store, "r"))
    with pytest.raises(ContractViolation, match="taken"):
        run(store, "r", [31, 32])
    assert totals(br.published_days(store, "r")) == before and store.members.count() == 2
    cells = copy.deepcopy(CELLS)
    cells[34][3] = "x"
    with pytest.raises(ContractViolation):
        run(store, "f", [34], cells)
    with pytest.raises(ContractViolation, match="taken"):
        run(store, "f", [34])


def test_every_violation_is_kept(store):
    cells = {n: line(1, "K", f"{n}.5") for n in range(2, 302)}
    with pytest.raises(ContractViolation, match="300 violations"):
        run(store, "bad", list(cells), cells)
    kept = store.spark.read.json(f"{store.root}/violations")
    assert kept.filter("run_id = 'bad' AND gate = 'typed'").count() == 300


def test_a_changed_file_under_the_same_name_is_refused(store):
    run(store, "a", [31, 32])
    cells = copy.deepcopy(CELLS)
    cells[31][3] = 100
    with pytest.raises(ContractViolation, match="differently"):
        run(store, "b", [31, 32], cells)
    assert br.current_days(store).first().run_id == "a"


def test_files_and_manifests_are_gated_closed(store):
    spark = store.spark
    files = spark.sql("SELECT 'a' original_file_name, 'x' sha256 UNION ALL SELECT 'b', 'y' UNION ALL SELECT 'c', NULL")
    manifests = spark.sql("SELECT 'a' original_file_name, 'x' expected_sha256 UNION ALL SELECT 'c', NULL UNION ALL SELECT 'd', 'z'")
    assert sorted(r.original_file_name for r in chk.fingerprint_violations(files, manifests).collect()) == ["b", "c", "d"]
    with pytest.raises(ContractViolation, match="both or neither"):
        run(store, "r", [31], files=files)


def test_groups_are_one_row_over_many_files(store):
    spark = store.spark
    both = raw(spark, [31, 32]).unionByName(raw(spark, [31, 38], file="sha256:second"))
    for run_id, rows in (("one", [31, 32]), ("two", [31])):
        chosen = selection(spark, rows).unionByName(selection(spark, [31, 38], "sha256:second"))
        br.run_batch(store, run_id, both, chosen, input_path="in")
    groups = {r.stock_code: r for r in compare_published(store, "one", "two").groups.collect()}
    assert (groups["TEA"].base_sample_quantity_sum, groups["TEA"].base_observed_row_count, groups["TEA"].changed) == (12, 3, False)
    assert groups["6001"].current_state == "not_present"


def test_scopes_and_comparison_of_selections(store):
    run(store, "a", [31, 32])
    run(store, "b", [32])
    br.run_batch(store, "c", raw(store.spark, [31, 32]), selection(store.spark, [32, 31]), input_path="in")
    ids = {r.run_id: r.input_scope_id for r in store.scopes.collect()}
    assert ids["a"] == ids["c"] != ids["b"]
    assert (store.landed.count(), store.members.count()) == (2, 5)
    found = compare_published(store, "a", "b")
    basis = found.basis.first()
    assert basis.code == "selection_scope_changed" and basis.selection_scope_changed
    assert [(r.change, r.source_row_number) for r in found.selected_rows.collect()] == [("removed", 31)]
    group = found.groups.filter("stock_code = 'TEA'").first()
    assert (group.base_sample_quantity_sum, group.current_state, group.changed) == (4, "not_present", True)
    assert group.removed_row_count == 1
    assert [tuple(r)[3:] for r in found.locations.collect()] == [(FILE, SHEET, 31)]
    assert compare_published(store, "a", "c").basis.first().code == "same_input_scope_and_rule"
    assert not compare_published(store, "a", "c").groups.filter("changed").count()
    listed = pub.published_list(pub.publications(store.run_events), pub.run_state(store.run_events), store.scopes)
    assert [(r.run_id, r.is_current) for r in listed.collect()] == [("c", True), ("b", False), ("a", False)]
    pair = pub.default_pair(listed).first()
    assert (pair.base_run_id, pair.current_run_id) == ("b", "c")


def test_comparison_mirrors(store):
    run(store, "a", [31, 32, 34])
    run(store, "b", [32, 37, 38])
    there, back = compare_published(store, "a", "b"), compare_published(store, "b", "a")
    flip = {"added": "removed", "removed": "added"}
    assert sorted((flip[r[0]], *r[1:]) for r in there.locations.collect()) == sorted(map(tuple, back.locations.collect()))


def test_other_file_or_rule_or_unrecorded_rule(spark):
    columns = "source_file_id string, sheet_name string, input_scope_id string, aggregation_rule_id string, transformation_rule_id string"
    base = spark.createDataFrame([("f", "s", "i", "a", "t")], columns)

    def against(*row):
        return cmp.compare_basis(base, spark.createDataFrame([row], columns))

    other = against("g", "s", "j", "b", "t").first()
    assert other.code == "source_sheet_or_rule_changed" and other.source_file_changed and other.aggregation_rule_changed
    assert against("f", "s", "i", "a", "u").first().transformation_rule_changed
    older = against("f", "s", "i", "a", None)
    assert older.first().transformation_rule_changed and older.first().transformation_rule_unrecorded
    assert cmp.basis_reasons(older).first().changed_criteria == [
        "transformation rule (an older result recorded none)"
    ]
    both = cmp.compare_basis(
        base.withColumn("transformation_rule_id", F.lit(None).cast("string")),
        base.withColumn("transformation_rule_id", F.lit(None).cast("string")),
    )
    row = both.first()
    assert (row.code, row.transformation_rule_changed) == ("source_sheet_or_rule_changed", False)
    assert cmp.basis_reasons(both).first().changed_criteria == ["transformation rule not recorded"]


def test_recovery_closes_dead_runs_and_links_what_they_wrote(store):
    spark = store.spark
    run(store, "good", [31, 32])
    store.log("dead", "running", br._now())
    store.log("alive", "running", br._now())
    half = store.days.withColumn("run_id", F.lit("dead"))
    half.write.mode("append").partitionBy("run_id").parquet(f"{store.root}/product_days")
    dead = spark.createDataFrame([("dead",)], "run_id string")
    assert br.recover(store, dead) == ["dead"]
    runs = {r.run_id: r for r in pub.run_label(pub.run_state(store.run_events)).collect()}
    assert (runs["dead"].status, runs["dead"].run_label) == ("failed", "recovered")
    assert runs["dead"].recovered_artifact_path.endswith("run_id=dead")
    assert runs["alive"].status == "running"
    assert br.recover(store, dead) == []
    assert br.current_days(store).first().run_id == "good"


def test_running_run_with_publication_needs_a_person(spark):
    runs = spark.sql("SELECT 'x' run_id, 'running' status, timestamp'2020-01-01' started_at")
    pubs = spark.sql("SELECT 'x' run_id, 1L publish_seq, timestamp'2020-01-01' published_at")
    assert pub.recovery_candidates(runs, pubs, runs).first().verdict == "manual_review"
    assert pub.recover_runs(runs, pubs, runs, F.current_timestamp(), "why").count() == 0


def test_no_result_and_double_claims_are_told_apart(store):
    with pytest.raises(ResultNotFound):
        br.current_days(store)
    runs = store.spark.sql("SELECT id run_id, 'succeeded' status, now() completed_at FROM VALUES ('x'), ('y') t(id)")
    pubs = store.spark.sql("SELECT id run_id, 7L publish_seq, now() published_at FROM VALUES ('x'), ('y') t(id)")
    assert pub.current_publication(pubs, runs).count() == 2


def test_landing_is_first_write_wins(spark):
    first = raw(spark, [31, 32])
    changed = copy.deepcopy(CELLS)
    changed[31][3] = 99
    second = raw(spark, [31, 34], changed)
    new = land.land_rows(first, second.unionByName(second))
    assert [r.source_row_number for r in new.collect()] == [34]
    landed = first.unionByName(new)
    assert land.land_rows(landed, second).count() == 0


def test_landing_deals_large_tables_into_sized_tasks(spark, monkeypatch):
    monkeypatch.setattr(land, "FEW_ROWS", 20, raising=False)
    monkeypatch.setattr(land, "TASK_ROWS", 10, raising=False)
    rows = spark.range(100).selectExpr("'f' AS source_file_id", "'s' AS sheet_name", "id AS source_row_number", "timestamp'2020-01-01' AS loaded_at")
    got = land.land_rows(rows.filter("source_row_number < 60"), rows.unionByName(rows))
    assert sorted(r.source_row_number for r in got.collect()) == list(range(60, 100))
    assert got.rdd.getNumPartitions() == 26
    few = land.land_rows(rows.filter("source_row_number < 20"), rows.unionByName(rows))
    assert sorted(r.source_row_number for r in few.collect()) == list(range(20, 100))


def test_landing_counts_rows_without_a_month(spark, tmp_path):
    for table in TABLES:
        (tmp_path / f"{table}.parquet").symlink_to(f"/root/testdata/sf0.001/{table}.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    con, lines = duckdb.connect(), "/root/testdata/sf0.001/lineitem.parquet"
    without = "SELECT * REPLACE (CASE WHEN l_orderkey % 7 > 0 THEN l_shipdate END AS l_shipdate)"
    con.execute(f"COPY ({without} FROM '{lines}') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    found = QUERIES["land_idempotent"](spark, str(tmp_path))
    assert difference(found, connect(str(tmp_path)), ORACLES["land_idempotent"]) is None


def test_backfill_fills_but_never_overwrites(spark):
    older = raw(spark, [31, 50]).withColumn(
        "invoice_no_source_kind", F.when(F.col("source_row_number") == 50, F.lit("kept"))
    )
    got = land.backfill_kind(older, raw(spark, [31, 50])).orderBy("source_row_number").collect()
    assert [r.invoice_no_source_kind for r in got] == ["integer", "kept"]


def test_markers_of_landed_rows(spark):
    rows = {r.source_row_number: r for r in typed_lines(raw(spark, list(CELLS))).collect()}
    for n, cells in CELLS.items():
        text = None if cells[0] is None else str(cells[0])
        assert rows[n].invoice_no == text
        assert rows[n].source_cancellation_marker == expected_marker(text, rows[n].invoice_no_source_kind)


def test_pages_hold_every_row_in_order(spark):
    members = land.select_rows(selection(spark, list(CELLS)), None, "r")
    long = pday.contributions(typed_lines(raw(spark, list(CELLS))), members)
    pages = pday.nested_contributions(long.withColumn("stock_code", F.lit("one")), page_rows=4).collect()
    assert max(len(p.contributing_rows) for p in pages) <= 4
    listed = [r.source_row_number for p in sorted(pages, key=lambda p: p.page) for r in p.contributing_rows]
    assert listed == sorted(CELLS)


def test_scope_id_ignores_order_and_repeats_across_slices(spark):
    far = [2, 3, 70_000, 5_000_000_000, 2**40]
    a = land.select_rows(selection(spark, far), None, "a")
    b = land.select_rows(selection(spark, far[::-1] + far), None, "b")
    c = land.select_rows(selection(spark, far[:-1]), None, "c")
    ids = {r.run_id: (r.input_scope_id, r.selected_row_count) for r in scope_ids(a.unionByName(b).unionByName(c)).collect()}
    assert ids["a"] == ids["b"] and ids["a"][1] == 5 and ids["c"][0] != ids["a"][0]


def test_row_diff_is_empty_for_other_files(spark):
    a = land.select_rows(selection(spark, [31]), None, "a")
    b = land.select_rows(selection(spark, [32], "sha256:other"), None, "b")
    assert row_diff(a.unionByName(b), "a", "b").count() == 0


def test_reconcile_counts_repeats(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    right = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted(map(tuple, reconcile(left, right, ["x"]).collect())) == [("left_only", 1, 1), ("right_only", 1, 3)]


def test_data_state_never_turns_absent_into_zero(spark):
    runs = spark.sql("SELECT * FROM VALUES ('a','succeeded'),('b','failed'),('c','succeeded') t(run_id,status)").withColumn(
        "completed_at", F.current_timestamp()
    )
    pubs = spark.sql("SELECT * FROM VALUES ('a',1L),('b',2L),('c',3L) t(run_id,publish_seq)").withColumn(
        "published_at", F.current_timestamp()
    )
    results = spark.sql("SELECT 'a' run_id")
    asked = spark.sql("SELECT * FROM VALUES ('a'),('b'),('c'),(' '),('z') t(run_id)")
    got = {r.run_id: r.data_state for r in pub.data_state(asked, pubs, runs, results).collect()}
    assert got == {"a": "available", "b": "not_found", "c": "read_error", " ": "invalid_request", "z": "not_found"}


def test_workbooks_end_to_end(spark, tmp_path, store):
    folder = tmp_path / "books"
    folder.mkdir()
    book = write_workbook(folder / "one.xlsx", list(CELLS))
    (folder / "two.xlsx").write_bytes(b"not a workbook")
    write_workbook(folder / "three.xlsx", [31], header=[*"ABCDEFGH"])
    write_workbook(folder / "four.xlsx", [31], sheet="Elsewhere")
    rows = scan_workbooks(spark, str(folder), SHEET)
    assert {r.source_path.rsplit("/")[-1] for r in workbook_errors(rows).collect()} == {"two.xlsx", "four.xlsx"}
    assert chk.header_violations(rows).count() == 1
    with pytest.raises(Exception, match="workbook not readable"):
        raw_sheet_rows(rows).collect()

    only = scan_workbooks(spark, str(book), SHEET)
    landed = raw_sheet_rows(only)
    got = {r.source_row_number: r for r in landed.collect()}
    assert sorted(got) == list(range(2, 76))  # rows left out by the file read as empty rows
    want = {r.source_row_number: r for r in raw(spark, list(CELLS)).collect()}
    text = [c for c in landed.columns if c not in ("source_file_id", "loaded_at")]
    assert all(got[n][c] == want[n][c] for n in CELLS for c in text)

    files = fingerprint_files(binary_files(spark, str(book)))
    digest = files.first().sha256
    manifest = {
        "dataset": "own rows", "source_url": "none", "expected_sha256": digest, "sheet": SHEET,
        "selected_excel_rows": [31, 38, 75], "scope_note": "listed rows only",
    }
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    (tmp_path / "n.json").write_text(json.dumps({k: v for k, v in manifest.items() if k != "sheet"}))
    manifests = read_manifests(spark, str(tmp_path / "*.json"))
    assert [tuple(r) for r in manifest_violations(manifests).collect()] == [("n.json", ["sheet"])]
    good = manifests.filter("manifest_file = 'm.json'").withColumn("original_file_name", F.lit("one.xlsx"))
    chosen = manifest_selection(good).withColumn("source_file_id", F.lit(f"sha256:{digest}"))
    br.run_batch(store, "w", landed, chosen, input_path=str(book), files=files, manifests=good, sheet_rows=only)
    assert totals(br.current_days(store)) == {"TEA": (8, 2), "BACK": (-5, 1)}
    about = good.withColumn("source_file_id", F.lit(f"sha256:{digest}")).select("source_file_id", "dataset", "source_url", "scope_note")
    br.export_result(store, "w", about, str(tmp_path / "out"))
    header = spark.read.json(str(tmp_path / "out/header")).first()
    assert header.source.selected_row_count == 3 and header.result_state == "complete_for_selected_rows"
    assert spark.read.json(str(tmp_path / "out/products")).count() == 2

    with pytest.raises(ContractViolation, match="fingerprint"):
        altered = good.withColumn("expected_sha256", F.lit("0"))
        br.run_batch(store, "v", landed, chosen, input_path="x", files=files, manifests=altered)
    assert store.scopes.filter("run_id = 'v'").count() == 0


def test_price_text_is_kept(spark, store):
    cells = {31: line(1, "K", 1, price=0.987654)}
    run(store, "r", [31], cells)
    assert store.contributions().first().unit_price_source_text == "0.987654"


def test_jsonl_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"a":1}\n\n  \n[1]\n{"a":1} x\n{"b":{}}\n')
    lines = read_jsonl(spark, str(tmp_path / "e.jsonl"))
    assert lines.count() == 4
    assert sorted(r.line for r in jsonl_violations(lines).collect()) == ["[1]", '{"a":1} x']


def test_totals_of_pages_are_those_of_their_rows(spark):
    big = 2**63 - 1
    made = [("r", "f", "2010-01-01", "A", "s", n, q) for n, q in ((1, big), (2, big), (70_000, -big), (70_001, -5), (140_000, 3))]
    made += [("r", "f", "2010-01-01", code, "s", 9, 1) for code in ("B", None)]
    schema = "run_id string, source_file_id string, observed_date string, stock_code string, sheet_name string, source_row_number long, quantity long"
    long = spark.createDataFrame(made, schema).repartition(3)
    pages = pday.page_totals(long)
    counts = {(r.stock_code, r.page): r.page_row_count for r in pages.collect()}
    assert counts == {("A", 0): 2, ("A", 1): 2, ("A", 2): 1, ("B", 0): 1, (None, 0): 1}
    assert sorted(map(str, pday.days_of_pages(pages).collect())) == sorted(map(str, pday.days_of(long).collect()))


def test_rows_meet_their_membership_once(spark):
    """What the query reads twice was kept before; its plan does not go back to the table."""
    files = QUERIES["result_products"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/pages-" in f for f in files)


def test_a_document_is_written_from_lines_that_were_kept(spark, monkeypatch):
    read = []
    monkeypatch.setattr(catalog, "commit_document", lambda path, key, parts: read.extend(parts["products"].inputFiles()))
    monkeypatch.setattr(catalog, "read_document", lambda spark, path, key: {"products": spark.read.parquet("/root/testdata/sf0.001/nation.parquet").limit(0)})
    with pytest.raises(Exception, match="data_state"):
        catalog.committed_products(spark, "/root/testdata/sf0.001")
    assert read and all("/lines-" in f for f in read)


def test_groups_compared_from_rows_are_those_of_days(spark):
    schema = "run_id string, source_file_id string, observed_date string, stock_code string, sheet_name string, source_row_number long, quantity long"
    base = [("a", "f", "d1", "A", "s", 1, 5), ("a", "f", "d1", "A", "s", 2, -5), ("a", "f", "d1", "B", "s", 3, 1), ("a", "f", "d2", "C", "s", 4, 7), ("a", "f", "d2", "D", "s", 8, 2)]
    now = [("b", "f", "d1", "A", "s", 1, 5), ("b", "g", "d1", "A", "s", 2, -5), ("b", "f", "d2", "C", "s", 4, 8), ("b", "f", "d2", "D", "s", 8, 2), ("b", "f", "d3", "E", "s", 9, None)]
    base, now = (spark.createDataFrame(made, schema).repartition(2) for made in (base, now))
    want = cmp.compare_groups(pday.days_of(base), pday.days_of(now), cmp.location_diff(base, now))
    found = cmp.compare_rows(base, now)
    assert found.schema.names == want.schema.names and found.dtypes == want.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    plan = QUERIES["compare_groups"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
