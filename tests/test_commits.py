"""Documents that appear whole, numbers that writers claim, and scans that stop."""

import threading
import zipfile

import pytest
from pyspark.sql import functions as F
from samples import CELLS, SHEET, write_workbook

from tallyline.errors import ResultNotFound, ResultReadError
from tallyline.operators.landing import last_selected
from tallyline.plans import batch_run as br
from tallyline.sources import documents
from tallyline.sources.documents import commit_document, read_document, versions_of
from tallyline.sources.storage import claim_next
from tallyline.sources.workbook import raw_sheet_rows, read_workbooks, scan_workbooks, workbook_errors


def parts(spark, n):
    lines = spark.range(n).select(F.col("id").alias("line"), F.lit("r").alias("run_id"), F.array(F.struct(F.col("id").alias("row"))).alias("rows"))
    return {"products": lines, "header": lines.groupBy("run_id").agg(F.count("*").alias("lines"))}


def test_readers_see_the_old_or_the_new_document(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    with pytest.raises(ResultNotFound):
        read_document(spark, path, "r")
    commit_document(path, "r", parts(spark, 3))
    before = read_document(spark, path, "r")
    broken = parts(spark, 9)
    broken["header"] = broken["header"].withColumn("lines", F.when(F.col("lines") > 0, F.raise_error(F.lit("task lost"))).cast("long"))
    with pytest.raises(Exception, match="task lost"):
        commit_document(path, "r", broken)
    with monkeypatch.context() as patch:
        patch.setattr(documents, "append_rows", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            commit_document(path, "r", parts(spark, 7))
    assert len(versions_of(spark, path, "r")) == 1 and spark.read.json(f"{path}/products").count() == 3
    commit_document(path, "r", parts(spark, 5))
    assert before["products"].count() == 3, "who looked the old version up can still read it"
    found = read_document(spark, path, "r")
    assert found["products"].count() == 5 and found["header"].first().lines == 5
    assert found["products"].orderBy("line").first().rows[0].row == 0
    commit_document(path, "other", parts(spark, 1))
    commit_document(path, "r", parts(spark, 6))
    assert read_document(spark, path, "r")["products"].count() == 6 and read_document(spark, path, "other")["products"].count() == 1
    assert spark.read.json(f"{path}/products/run_id=r").count() == 5 + 6


def test_a_document_with_missing_rows_is_refused(spark, tmp_path):
    path = tmp_path / "out"
    version = commit_document(str(path), "r", parts(spark, 4))
    for file in (path / "products" / "run_id=r" / f"version={version}").glob("part-*"):
        file.write_text("")
    for file in (path / "products" / "run_id=r" / f"version={version}").glob(".*.crc"):
        file.unlink()
    with pytest.raises(ResultReadError, match="products"):
        read_document(spark, str(path), "r")


def test_writers_at_the_same_time_get_different_numbers(spark, tmp_path):
    taken, folder = [], str(tmp_path / "claims")

    def write():
        for _ in range(10):
            taken.append(claim_next(spark, folder, 4))

    threads = [threading.Thread(target=write) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(set(taken)) == 40 and min(taken) == 5


def test_two_stores_never_publish_under_one_number(spark, tmp_path, monkeypatch):
    one, other = br.Store(spark, str(tmp_path / "store")), br.Store(spark, str(tmp_path / "store"))
    one.log("a", "running", br._now())
    other.log("b", "running", br._now())
    stale = spark.createDataFrame(one.run_events.collect(), one.run_events.schema)
    # Both look before either writes.
    monkeypatch.setattr(br.Store, "run_events", property(lambda self: stale))
    one.log("a", "succeeded", br._now())
    other.log("b", "succeeded", br._now())
    monkeypatch.undo()
    events = one.run_events.collect()
    assert len({e.event_seq for e in events}) == 4
    assert len({e.publish_seq for e in events if e.publish_seq}) == 2


def test_a_scan_stops_behind_the_last_selected_row(spark, tmp_path):
    good = write_workbook(tmp_path / "one.xlsx", list(CELLS))
    numbers = sorted(CELLS)
    whole = scan_workbooks(spark, str(good), SHEET)
    file_id = whole.first().source_file_id
    selection = spark.createDataFrame([(file_id, SHEET, n) for n in numbers[:2]], "source_file_id string, sheet_name string, source_row_number long")
    short = scan_workbooks(spark, str(good), SHEET, last_selected(selection))
    assert short.agg(F.max("source_row_number")).first()[0] == numbers[1] < whole.agg(F.max("source_row_number")).first()[0]
    kept = short.columns
    assert sorted(map(str, whole.filter(F.col("source_row_number") <= numbers[1]).select(kept).collect())) == sorted(map(str, short.collect()))
    # A file that breaks behind the last selected row is never read that far.
    torn = torn_copy(good, tmp_path / "torn.xlsx", numbers[-1])
    torn_id = scan_workbooks(spark, str(torn), SHEET).first().source_file_id
    assert workbook_errors(scan_workbooks(spark, str(torn), SHEET)).count() == 1
    chosen = selection.withColumn("source_file_id", F.lit(torn_id))
    found = scan_workbooks(spark, str(torn), SHEET, last_selected(chosen))
    assert workbook_errors(found).count() == 0 and raw_sheet_rows(found).count() == numbers[1] - 1
    assert scan_workbooks(spark, str(good), SHEET, last_selected(chosen)).count() == 1


def torn_copy(good, torn, number):
    """The workbook with its sheet broken off inside a row."""
    with zipfile.ZipFile(good) as book, zipfile.ZipFile(torn, "w") as copy:
        for name in book.namelist():
            text = book.read(name).decode()
            if name.endswith("sheet1.xml"):
                at = text.index(f'<row r="{number}"')
                text = text[:at] + '<row r="' + text[at : at + 9] + "<" * 100_000
            copy.writestr(name, text)
    return torn


def test_a_filter_ends_the_parsing_of_the_workbook_source(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    good = write_workbook(folder / "one.xlsx", list(CELLS))
    write_workbook(folder / "two.xlsx", list(CELLS)[:2], sheet="Elsewhere")
    (folder / "notes.txt").write_text("no workbook")
    numbers = sorted(CELLS)
    shown = ["source_file_id", "sheet_name", "source_row_number", "cells", "cell_types"]
    whole = scan_workbooks(spark, str(good), SHEET).select(shown)
    assert sorted(map(str, read_workbooks(spark, str(good), SHEET).select(shown).collect())) == sorted(map(str, whole.collect()))
    every = read_workbooks(spark, str(folder))
    assert {r.sheet_name for r in every.select("sheet_name").distinct().collect()} == {SHEET, "Elsewhere"}
    torn = torn_copy(good, tmp_path / "torn.xlsx", numbers[-1])
    rows = read_workbooks(spark, str(torn), SHEET)
    with pytest.raises(Exception, match="ParseError"):
        rows.collect()
    for wanted in (F.col("source_row_number") <= numbers[1], F.col("source_row_number") < numbers[1] + 1):
        assert sorted(map(str, rows.filter(wanted).select("source_row_number", "cells").collect())) == sorted(
            map(str, whole.filter(wanted).select("source_row_number", "cells").collect())
        )
    assert rows.filter(F.col("source_row_number") == numbers[0]).count() == 1
    with pytest.raises(Exception, match="sheet not found"):
        read_workbooks(spark, str(good), "None").collect()
