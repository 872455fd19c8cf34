"""File sources and sinks beside Parquet: sniffing, JSON lines, CSV, TSV words, workbooks, canonical JSON."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: First bytes of file types, in hex.
MAGIC = (("49492A00", "TIFF"), ("4D4D002A", "TIFF"), ("25504446", "PDF"), ("89504E470D0A1A0A", "PNG"), ("FFD8FF", "JPEG"), ("504B0304", "ZIP"))


def sniffed(content: Column) -> Column:
    """File type by the first bytes of binary content."""
    head, kind = F.hex(F.substring(content, 1, 8)), F.lit("UNKNOWN")
    for magic, name in reversed(MAGIC):
        kind = F.when(head.startswith(magic), name).otherwise(kind)
    return kind


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, kind and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", sniffed(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"))


def content_key(sha256: Column, name: Column) -> Column:
    """Where content is stored: by the first digits of its digest, with its file's name."""
    return F.concat_ws("/", F.lit("documents"), F.substring(sha256, 1, 2), F.substring(sha256, 3, 2), F.concat_ws("_", sha256, F.element_at(F.split(name, "[/\\\\]"), -1)))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool) -> DataFrame:
    """JSON lines: a bad line is an error (strict) or left out. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def word_table(lines: DataFrame, column: str) -> DataFrame:
    """Words of an OCR engine's tab-separated output: level 5 rows with a confidence."""
    names = "level int, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string"
    rows = lines.select(F.from_csv(F.col(column), names, {"sep": "\t", "mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.filter("level = 5 AND conf >= 0 AND trim(text) <> ''")


def canonical_json(*columns: str) -> Column:
    """Compact JSON of the columns with sorted keys; nulls are left out."""
    return F.to_json(F.struct(*sorted(columns)))


def write_report(df: DataFrame, folder: str) -> None:
    """A report as JSON lines and as CSV."""
    df.write.mode("overwrite").json(f"{folder}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    """path, member, length, kind, sha256 of every file in the ZIP archives below a folder; error in place of these for one that can't be read.

    Archives come through Spark's own reader, so they may lie in any store it
    reads; each is read in the task of its row, member by member.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                        for info in sorted((x for x in archive.infolist() if not x.is_dir()), key=lambda x: x.filename):
                            digest, head, size = hashlib.sha256(), b"", 0
                            with archive.open(info) as member:
                                while part := member.read(1 << 20):
                                    head, size = head or part[:8], size + len(part)
                                    digest.update(part)
                            rows.append((path, info.filename, size, head, digest.hexdigest(), None))
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                    rows = [(path, None, None, None, None, type(e).__name__)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()), strict=True)], ["path", "member", "length", "head", "sha256", "error"])

    found = files.mapInArrow(run, "path string, member string, length long, head binary, sha256 string, error string")
    return found.select("path", "member", "length", F.when(F.col("member").isNotNull(), sniffed(F.coalesce("head", F.lit(b"")))).alias("kind"), "sha256", "error")


def merged_shards(shards: list[DataFrame], key: str, expected: int) -> DataFrame:
    """The rows of all shards, in order of ``key``; an error unless there are ``expected`` of them, each with another key."""
    out = shards[0]
    for more in shards[1:]:
        out = out.unionByName(more)
    n, keys = out.agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    if n != expected or keys != expected:
        raise ValueError(f"expected {expected} rows with as many keys, got {n} and {keys}")
    return out.orderBy(key)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


class _Sheet(InputPartition):
    pass


class WorkbookSource(DataSource):
    """One sheet of an XLSX workbook as strings: ``format("workbook").option("path", ...).option("sheet", "1")``.

    The first row names the columns in the schema that the reader is given.
    Writing makes a folder with a workbook of one sheet for each task (and for
    each ``most_rows`` rows of it), the columns' names in the first row. Parts
    are written under hidden names and take their own when all tasks are done;
    if one fails, nothing stays. The folder must be one that all machines mount.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def reader(self, schema):
        return _WorkbookReader(self.options, schema.names)

    def writer(self, schema, overwrite: bool):
        return _WorkbookWriter(self.options, schema.names, overwrite)


class _WorkbookReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.sheet, self.names = options["path"], options.get("sheet", "1"), names

    def partitions(self) -> list[InputPartition]:
        return [_Sheet(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as book:
            shared: list[str] = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in x.iterfind(".//m:t", _NS)) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
            with book.open(f"xl/worksheets/sheet{self.sheet}.xml") as sheet:
                header: dict[str, str] = {}
                for _, row in ElementTree.iterparse(sheet):
                    if row.tag != f"{{{_NS['m']}}}row":
                        continue
                    cells = {}
                    for c in row.iterfind("m:c", _NS):
                        value, inline = c.find("m:v", _NS), c.find("m:is/m:t", _NS)
                        text = (inline.text if inline is not None else value.text if value is not None else None) or ""
                        cells["".join(x for x in c.get("r", "") if x.isalpha())] = shared[int(text)] if c.get("t") == "s" else text
                    if not header:
                        header = cells
                    else:
                        by_name = {header.get(k): v for k, v in cells.items()}
                        yield tuple(by_name.get(n) for n in self.names)
                    row.clear()


#: Fixed value: the rows that a sheet can have, its header among them.
SHEET_ROWS = 1_048_576
#: The parts of a workbook beside its sheet.
_BOOK = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


def _letters(k: int) -> str:
    """A column's letters: 0 is A, 26 is AA."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _shown(value) -> str:
    """A cell's text: lists and structs as JSON, null as nothing; characters that XML can't hold as a question mark."""
    if isinstance(value, Row):
        value = value.asDict(recursive=True)
    text = "" if value is None else json.dumps(value, sort_keys=True, default=str) if isinstance(value, list | dict) else str(value)
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "?", text))


class _WorkbookWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.sheet, self.names, self.overwrite = options["path"].removeprefix("file://"), options.get("sheet", "Sheet1"), names, overwrite
        self.rows, self.job = int(options.get("most_rows", SHEET_ROWS)) - 1, uuid.uuid4().hex
        if not overwrite and os.path.isdir(self.path) and any(n.endswith(".xlsx") for n in os.listdir(self.path)):
            self.first = 1 + max(int(n[5:10]) for n in os.listdir(self.path) if re.fullmatch(r"part-\d{5,}-\d+\.xlsx", n))
        else:
            self.first = 0

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        task = TaskContext.get()
        folder = os.path.join(self.path, f".{self.job}")
        os.makedirs(folder, exist_ok=True)
        names, left = [], _Ahead(iterator)
        while left or not names:
            name = f"part-{self.first + task.partitionId():05d}-{len(names)}.xlsx"
            own = os.path.join(folder, f"{name}.{task.taskAttemptId()}")
            with zipfile.ZipFile(own, "w", zipfile.ZIP_DEFLATED) as book:
                for part, text in _BOOK.items():
                    book.writestr(part, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text.replace("{sheet}", escape(self.sheet, {'"': "&quot;"})))
                with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
                    out.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                    out.write(self._row(1, self.names))
                    for k, row in enumerate(left.take(self.rows), 2):
                        out.write(self._row(k, row))
                    out.write(b"</sheetData></worksheet>")
            names.append(os.path.basename(own))
        return _Written(names)

    @staticmethod
    def _row(number: int, values) -> bytes:
        cells = "".join(f'<c r="{_letters(k)}{number}" t="inlineStr"><is><t xml:space="preserve">{_shown(v)}</t></is></c>' for k, v in enumerate(values))
        return f'<row r="{number}">{cells}</row>'.encode()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for name in os.listdir(self.path):
                if name.endswith(".xlsx"):
                    os.unlink(os.path.join(self.path, name))
        for message in messages:
            for name in message.names if message else []:
                os.replace(os.path.join(self.path, f".{self.job}", name), os.path.join(self.path, name.rpartition(".")[0]))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What this job has written and not committed goes."""
        shutil.rmtree(os.path.join(self.path, f".{self.job}"), ignore_errors=True)


class _Ahead:
    """An iterator that knows whether there is more."""

    def __init__(self, rows: Iterator) -> None:
        self.rows, self.next = rows, []
        self._fill()

    def _fill(self) -> None:
        self.next = [row for row in islice(self.rows, 1)]

    def __bool__(self) -> bool:
        return bool(self.next)

    def take(self, many: int) -> Iterator:
        while self.next and many > 0:
            row, many = self.next[0], many - 1
            self._fill()
            yield row
