"""Workbook sheets as rows. A sheet has at most 1,048,576 rows, and a task reads one file."""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tallyline.functions.identity import sha256_id
from tallyline.functions.text import raw_text, source_kind
from tallyline.schemas import RAW_ROWS, SHEET_HEADER, SHEET_ROWS
from tallyline.sources.files import binary_files
from tallyline.sources.storage import qualified

BATCH_ROWS = 8_192
WIDTH = len(SHEET_HEADER)
# Built-in number formats that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_DAY_ZERO = dt.datetime(1899, 12, 30)


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node, name: str):
    return [child for child in node if _name(child.tag) == name]


def _text_of(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _name(t.tag) == "t")


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _sheet_path(book: zipfile.ZipFile, sheet: str) -> str | None:
    """Path of the sheet's part, through the workbook's relations."""
    targets = {r.get("Id"): r.get("Target") for r in _part(book, "xl/_rels/workbook.xml.rels")}
    for node in _part(book, "xl/workbook.xml").iter():
        if _name(node.tag) == "sheet" and node.get("name") == sheet:
            key = next(v for k, v in node.attrib.items() if _name(k) == "id")
            target = targets[key]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return None


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles whose number format shows a date."""
    root = _part(book, "xl/styles.xml")
    if root is None:
        return set()
    own = {
        int(n.get("numFmtId"))
        for n in root.iter()
        if _name(n.tag) == "numFmt" and re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode").lower()))
    }
    formats = [xf for group in _children(root, "cellXfs") for xf in group]
    return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _cell(node, shared: list[str], dates: set[int]) -> tuple[str | None, str]:
    """Value text and type of one cell, as a reader of cached values sees it."""
    kind = node.get("t", "n")
    if kind == "inlineStr":
        return _text_of(node), "text"
    value = next((v.text for v in _children(node, "v")), None)
    if value is None:
        return None, "empty"
    if kind == "s":
        return shared[int(value)], "text"
    if kind == "str":
        return value, "text"
    if kind == "b":
        return str(value == "1"), "boolean"
    if kind == "e":
        return value, "error"
    if kind == "d":
        return value, "datetime"
    if int(node.get("s", 0)) in dates:
        moment = _DAY_ZERO + dt.timedelta(milliseconds=round(float(value) * 86_400_000))
        return moment.isoformat(sep=" "), "datetime"
    if re.search("[.eE]", value):
        return str(float(value)), "float"
    return str(int(value)), "integer"


def _rows(content: bytes, sheet: str) -> Iterator[tuple[int, list, list]]:
    """Row number, cell texts and cell types; rows the file leaves out come as empty ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path = _sheet_path(book, sheet)
        if path is None:
            raise LookupError(f"sheet not found: {sheet}")
        strings = _part(book, "xl/sharedStrings.xml")
        shared = [_text_of(item) for item in strings] if strings is not None else []
        dates, last = _date_styles(book), 0
        with book.open(path) as part:
            for _, node in ElementTree.iterparse(part):
                if _name(node.tag) != "row":
                    continue
                number = int(node.get("r", last + 1))
                for gap in range(last + 1, number):
                    yield gap, [None] * WIDTH, ["empty"] * WIDTH
                cells, types = [None] * WIDTH, ["empty"] * WIDTH
                for at, cell in enumerate(_children(node, "c")):
                    letters = re.match("[A-Z]+", cell.get("r", ""))
                    column = _column(letters.group()) if letters else at
                    if column < WIDTH:
                        cells[column], types[column] = _cell(cell, shared, dates)
                yield number, cells, types
                last = number
                node.clear()


def _column(letters: str) -> int:
    index = 0
    for letter in letters:
        index = index * 26 + ord(letter) - 64
    return index - 1


def scan_workbooks(spark: SparkSession, path: str, sheet: str, last_rows: DataFrame | None = None) -> DataFrame:
    """Every row of the named sheet in every workbook, first eight columns.

    With ``last_rows`` (source_file_id, sheet_name, last_row, as landing's ``last_selected`` gives them)
    a workbook is parsed up to its last selected row only, one that nothing is selected of up to
    its header; what lies behind is never looked at. A workbook that can not be read that far, or has no such sheet, gives
    one row with ``error``.
    """
    columns, stopped = SHEET_ROWS.fieldNames(), last_rows is not None
    stops = last_rows.filter(F.col("sheet_name") == sheet).select("source_file_id", "last_row") if stopped else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch.itertuples(index=False):
                out: list[tuple] = []
                try:
                    for number, cells, types in _rows(file.content, sheet):
                        if stopped and number > file.last_row:
                            break
                        out.append((file.source_file_id, file.path, sheet, number, cells, types, None))
                        if len(out) == BATCH_ROWS:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                except Exception as exc:  # any broken part makes the whole workbook unreadable
                    out.append((file.source_file_id, file.path, sheet, None, None, None, f"{type(exc).__name__}: {exc}"))
                if out:
                    yield pd.DataFrame(out, columns=columns)

    files = binary_files(spark, path, "*.xlsx").select(
        sha256_id(F.col("content")).alias("source_file_id"), "path", "content"
    )
    if stops is not None:
        files = files.join(stops, "source_file_id", "left").withColumn("last_row", F.coalesce("last_row", F.lit(1)))
    return files.mapInPandas(read, SHEET_ROWS)


def workbook_errors(sheet_rows: DataFrame) -> DataFrame:
    return sheet_rows.filter("error IS NOT NULL").select("source_path", "sheet_name", "error")


def raw_sheet_rows(sheet_rows: DataFrame) -> DataFrame:
    """Data rows (from row 2) in the landing schema, text as read.

    A workbook that could not be read to its end fails the job: its first rows alone are no source.
    """
    broken = F.raise_error(F.concat(F.lit("workbook not readable: "), "source_path", F.lit(", "), "error"))
    data = sheet_rows.filter(F.when(F.col("error").isNotNull(), broken.cast("boolean")).otherwise(F.col("source_row_number") >= 2))

    def cell(index: int):
        return raw_text(F.get("cells", F.lit(index)), F.get("cell_types", F.lit(index)))

    kind = source_kind(F.get("cells", F.lit(0)), F.get("cell_types", F.lit(0)))
    return data.select(
        "source_file_id",
        "sheet_name",
        "source_row_number",
        cell(0).alias("invoice_no_raw"),
        kind.alias("invoice_no_source_kind"),
        cell(1).alias("stock_code_raw"),
        cell(2).alias("description_raw"),
        cell(3).alias("quantity_raw"),
        cell(4).alias("invoice_date_raw"),
        cell(5).alias("unit_price_raw"),
        cell(6).alias("customer_id_raw"),
        cell(7).alias("country_raw"),
        F.current_timestamp().alias("loaded_at"),
    ).select(*RAW_ROWS.fieldNames())


@dataclass
class SheetPartition(InputPartition):
    """One sheet of one workbook."""

    file: str
    sheet: str


class WorkbookReader(DataSourceReader):
    """Sheets in parallel, each parsed up to the highest row number that the query's filters let through."""

    def __init__(self, options: dict[str, str]):
        self.path, self.sheet, self.last = options["path"], options.get("sheet"), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, (EqualTo, LessThan, LessThanOrEqual)) and one.attribute == ("source_row_number",):
                bound = one.value - isinstance(one, LessThan)
                self.last = bound if self.last is None else min(self.last, bound)
            # Spark applies every filter again; here they only say where to stop.
            yield one

    def partitions(self) -> list[SheetPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        books = sorted(f.path for f in files if f.is_file and f.path.endswith(".xlsx"))
        return [SheetPartition(book, sheet) for book in books for sheet in ([self.sheet] if self.sheet else self._sheets(book))]

    def _content(self, book: str) -> bytes:
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(book) as file:
            return file.read()

    def _sheets(self, book: str) -> list[str]:
        with zipfile.ZipFile(io.BytesIO(self._content(book))) as parts:
            return [node.get("name") for node in _part(parts, "xl/workbook.xml").iter() if _name(node.tag) == "sheet"]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        content = self._content(partition.file)
        file_id = f"sha256:{hashlib.sha256(content).hexdigest()}"
        for number, cells, types in _rows(content, partition.sheet):
            if self.last is not None and number > self.last:
                return
            yield (file_id, partition.file, partition.sheet, number, cells, types, None)


class WorkbookSource(DataSource):
    """Format ``workbook`` with the options ``path`` (a file or a folder) and ``sheet`` (all sheets without it)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        return SHEET_ROWS

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader({k.lower(): v for k, v in self.options.items()})


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows of ``scan_workbooks`` as a source of its own: a task per sheet, and a filter on the row number ends its parsing.

    A workbook that can not be read as far as the filter goes, or has no such sheet, fails the job. The path must be one that
    pyarrow's file systems open.
    """
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").option("path", qualified(spark, path))
    return (reader.option("sheet", sheet) if sheet else reader).load()
