"""Workbooks (.xlsx) as a Spark data source: one file for each folder of rows, or one for all.

A workbook is a zipped set of XML sheets.  Tasks write whole workbooks under temporary
names and report them; the commit gives them their names once every task has ended, so
that a failed task or job leaves none.  Files are opened through the file system of the
path, so any store that Arrow knows will do.

    spark.dataSource.register(Workbooks)
    rows.write.format("workbook").option("folder", "dataset").mode("append").save(path)
    spark.read.format("workbook").schema(...).load(path)

Defined cases: null cells stay empty and are read as null; the empty string is a cell of
its own; a folder with more rows than a sheet holds, or that several tasks hold, goes to
numbered files; characters that spreadsheets refuse are dropped; no rows, no file; a
column ``file_name`` of the schema is the name of the file that a row was read from, and
``workbook`` that of the workbook whose numbered files they are: each file has it as its title.
"""

from __future__ import annotations

import itertools
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StructType

#: Rows of a sheet below its header, the parts of a workbook, its name space, characters that it refuses.
SHEET_ROWS = 1_048_575
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    '<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
    '<Relationship Id="r2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Results" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_CORE = "docProps/core.xml"
_TITLE = "http://purl.org/dc/elements/1.1/"
_SHEET = "xl/worksheets/sheet1.xml"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REFUSED = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]")


def _store(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def column_name(n: int) -> str:
    """A, B, ..., Z, AA, ... of a column counted from 0."""
    name = ""
    while n >= 0:
        name, n = chr(65 + n % 26) + name, n // 26 - 1
    return name


def _cell(at: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value - value == 0:
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_REFUSED.sub("", str(value)), {chr(13): "&#13;"})}</t></is></c>'


class Sheet:
    """A workbook of one sheet, written row by row to a stream."""

    def __init__(self, stream, names: list[str], title: str):
        self.stream, self.book, self.rows = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), 0
        core = f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="{_TITLE}"><dc:title>{escape(title)}</dc:title></cp:coreProperties>'
        for part, xml in (*_PARTS.items(), (_CORE, core)):
            self.book.writestr(part, f'<?xml version="1.0" encoding="UTF-8"?>{xml}')
        self.columns = [column_name(i) for i in range(len(names))]
        self.sheet = self.book.open(_SHEET, "w", force_zip64=True)
        self.sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        self._row(names)

    def _row(self, values) -> None:
        n = self.rows + 1
        self.sheet.write(f'<row r="{n}">{"".join(_cell(f"{c}{n}", v) for c, v in zip(self.columns, values, strict=True))}</row>'.encode())

    def add(self, values) -> None:
        self.rows += 1
        self._row(values)

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.book.close()
        self.stream.close()


def _index(cell: str) -> int:
    """Column of a cell's name, from 0."""
    n = 0
    for letter in re.match("[A-Z]+", cell).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def sheet_rows(stream) -> Iterator[list[str | None]]:
    """The cells of each row of the first sheet as text, header first; inline, shared and plain values."""
    with zipfile.ZipFile(stream) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for _, item in ElementTree.iterparse(part) if item.tag == f"{_MAIN}si"]
        first = min((n for n in book.namelist() if n.startswith("xl/worksheets/")), key=lambda n: (len(n), n))
        with book.open(first) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for n, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _index(cell.get("r")) if cell.get("r") else n
                    value = cell.findtext(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif cell.get("t") == "s":
                        value = shared[int(value)]
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = value
                yield cells
                row.clear()


def workbook_title(stream) -> str | None:
    """The title of a workbook, if it has one."""
    with zipfile.ZipFile(stream) as book:
        return ElementTree.fromstring(book.read(_CORE)).findtext(f"{{{_TITLE}}}title") if _CORE in book.namelist() else None


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # temporary path, name without ending


class _Writer(DataSourceWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.folder, self.name = options["path"].rstrip("/"), options.get("folder"), options.get("name", "merged")
        self.overwrite, self.most = overwrite, int(options.get("rows", SHEET_ROWS))
        self.names = [f.name for f in schema.fields if f.name != self.folder]
        self.at = next((i for i, f in enumerate(schema.fields) if f.name == self.folder), None)
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        store, temporary = _store(self.temporary)
        store.create_dir(temporary, recursive=True)  # by the driver: a task that outlives an abort finds no folder

    def write(self, rows) -> _Written:
        store, temporary = _store(self.temporary)
        files, sheet, now = [], None, None
        for row in rows:
            values = list(row)
            name = self.name if self.at is None else str(values.pop(self.at))
            if sheet is None or name != now or sheet.rows == self.most:
                if sheet is not None:
                    sheet.close()
                files.append((f"{temporary}/{uuid.uuid4().hex}", re.sub(r"[^\w.\-]", "_", name)))
                sheet, now = Sheet(store.open_output_stream(files[-1][0]), self.names, files[-1][1]), name
            sheet.add(values)
        if sheet is not None:
            sheet.close()
        return _Written(files)

    def commit(self, messages) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            for old in store.get_file_info(fs.FileSelector(path)):
                if old.path.endswith(".xlsx"):
                    store.delete_file(old.path)
        groups: dict[str, list[str]] = {}
        for temporary, name in (f for m in messages if m for f in m.files):
            groups.setdefault(name, []).append(temporary)
        taken = {f"{path}/{name}.xlsx" for name, files in groups.items() if len(files) == 1} | set(_files(self.path))
        for name, files in groups.items():
            free = (f for n in itertools.count(1) if (f := f"{path}/{name}-{n}.xlsx") not in taken)  # another workbook can be called so
            for file in files:
                at = f"{path}/{name}.xlsx" if len(files) == 1 else next(free)
                store.move(file, at)
                taken.add(at)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, temporary = _store(self.temporary)
        if store.get_file_info(temporary).type != fs.FileType.NotFound:
            store.move(temporary, f"{temporary}-gone")  # tasks that still run can open no file in it
            store.delete_dir(f"{temporary}-gone")


_CASTS = {BooleanType: lambda x: x not in ("0", "false", "FALSE"), IntegerType: lambda x: int(float(x)), LongType: lambda x: int(x) if re.fullmatch(r"-?\d+", x) else int(float(x)), FloatType: float, DoubleType: float}


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.fields = options["path"], [(f.name, _CASTS.get(type(f.dataType), str)) for f in schema.fields]

    def partitions(self) -> list[_File]:
        return [_File(p) for p in _files(self.path)]

    def read(self, partition: _File):
        store, _ = _store(self.path)
        own = {"file_name": partition.path.rsplit("/", 1)[-1]}
        with store.open_input_file(partition.path) as stream:
            title = workbook_title(stream)
        own["workbook"] = f"{title}.xlsx" if title else own["file_name"]
        with store.open_input_file(partition.path) as stream:
            rows = sheet_rows(stream)
            place = {name: i for i, name in enumerate(next(rows, []))}
            for cells in rows:
                values = []
                for name, cast in self.fields:
                    at = place.get(name)
                    value = cells[at] if at is not None and at < len(cells) else None
                    values.append(own[name] if name in own and at is None else None if value is None else cast(value))
                yield tuple(values)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, inner = _store(path)
    if inner.endswith(".xlsx"):
        return [inner]
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(inner)) if x.path.endswith(".xlsx"))


class Workbooks(DataSource):
    """Options: ``path``; for writing ``folder`` (the column that names the file), ``name`` of the file without one, ``rows`` of a sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        """Every column of the first file, as text."""
        files = _files(self.options["path"])
        if not files:
            raise ValueError("no workbook there: give a schema")
        with _store(self.options["path"])[0].open_input_file(files[0]) as stream:
            names = next(sheet_rows(stream), [])
        return ", ".join(f"`{n}` string" for n in names if n) + ", file_name string"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def write_by_folder(rows: DataFrame, path: str, folder: str, *, merged: str | None = "merged") -> None:
    """One workbook for each value of ``folder``, and one of all rows; both are written by tasks, none through the driver.

    Up to a sheet's rows, a folder and the union of all are a sheet each, hence a task each; beyond,
    they are dealt to numbered files, which tasks write at once.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Workbooks)
    large = {r[0]: -(-r[1] // SHEET_ROWS) for r in rows.groupBy(folder).count().filter(F.col("count") > SHEET_ROWS).collect()}  # a row for a million rows at most
    part = F.lit(0).cast("long")
    for name, sheets in large.items():
        part = F.when(F.col(folder).eqNullSafe(F.lit(name)), F.pmod(F.xxhash64(*rows.columns), F.lit(sheets))).otherwise(part)
    rows.repartition(F.col(folder), part).sortWithinPartitions(folder).write.format("workbook").option("folder", folder).mode("append").save(path)
    if merged:
        sheets = max(1, -(-rows.count() // SHEET_ROWS))
        rows.repartition(sheets).write.format("workbook").option("name", merged).mode("append").save(path)


def read(spark, path: str, schema: str | StructType | None = None) -> DataFrame:
    spark.dataSource.register(Workbooks)
    reader = spark.read.format("workbook")
    return (reader.schema(schema) if schema else reader).load(path)
