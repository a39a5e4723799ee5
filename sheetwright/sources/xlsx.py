"""XLSX sheets as a data source, read and written with the standard library.

    spark.dataSource.register(XlsxSource)
    spark.read.format("xlsx").option("sheet", "results").load(path)
    df.write.format("xlsx").mode("overwrite").save(folder)

Every cell is a string; an empty cell is an empty string and a row beyond the
written ones does not exist.  The first row names the columns, and ``src_pos``
numbers the rows from 0.  A sheet has about a million rows at most, so one task
reads a file; several files are several tasks.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _local(path: str) -> str:
    return path.removeprefix("file://")


def column_number(name: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n - 1


def column_name(n: int) -> str:
    name, n = "", n + 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[list[str]]:
    """The rows of a sheet (the first by default), as strings; a whole number has no decimals."""
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in book.iter(f"{_NS}sheet")]
        target = next((t for n, t in sheets if sheet in (None, n)), None)
        if target is None:
            raise ValueError(f"no sheet named {sheet}")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with z.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    ref = re.match(r"[A-Z]+", c.get("r") or "")
                    at = column_number(ref[0]) if ref else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value, kind = c.find(f"{_NS}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = _text(c)
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else re.sub(r"^(-?\d+)\.0+$", r"\1", value.text)
                yield cells
                row.clear()


def write_book(path: str, sheets: dict[str, list[list]]) -> None:
    """A workbook of string cells; ``sheets`` holds rows by sheet name."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    numbers = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, sheets, strict=True))
        z.writestr("xl/workbook.xml", f'{head}<workbook {main} xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, rows in zip(numbers, sheets.values(), strict=True):
            body = "".join(
                f'<row r="{r}">' + "".join(f'<c r="{column_name(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for k, v in enumerate(row) if v is not None) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"{head}<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str], sheet: str | None):
        self.schema, self.paths, self.sheet = schema, paths, sheet

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        rows = sheet_rows(partition.path, self.sheet)
        header = next(rows, [])
        places = [header.index(f.name) if f.name in header else None for f in self.schema.fields]
        for at, row in enumerate(rows):
            yield tuple(at if f.name == "src_pos" else "" if p is None or p >= len(row) else row[p] for f, p in zip(self.schema.fields, places, strict=True))


class _Done(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    """A workbook for each partition, which must fit in its task; write one partition for one file."""

    def __init__(self, schema: StructType, folder: str, sheet: str):
        self.names, self.folder, self.sheet = schema.names, folder, sheet

    def write(self, iterator):
        from pyspark import TaskContext

        rows = [list(self.names)] + [[None if v is None else str(v) for v in r] for r in iterator]
        os.makedirs(self.folder, exist_ok=True)
        number = TaskContext.get().partitionId()
        temporary = os.path.join(self.folder, f".{number}-{TaskContext.get().taskAttemptId()}")
        write_book(temporary, {self.sheet: rows})
        os.replace(temporary, os.path.join(self.folder, f"part-{number:05d}.xlsx"))
        return _Done()


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _paths(self) -> list[str]:
        path = _local(self.options["path"])
        return sorted(glob.glob(os.path.join(path, "*.xlsx"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]

    def schema(self) -> StructType:
        header = next(sheet_rows(self._paths()[0], self.options.get("sheet")), [])
        return StructType([StructField("src_pos", LongType()), *[StructField(h, StringType()) for h in header if h]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self._paths(), self.options.get("sheet"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, _local(self.options["path"]), self.options.get("sheet", "results"))
