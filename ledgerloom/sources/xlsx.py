"""Excel workbooks (.xlsx), with the standard library's zip and XML readers; one task reads a workbook."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ExcelEncrypted, ExcelFileTooLarge, ExcelInvalid
from ..functions.casts import strict_cast
from ..session import ship
from ..types import ExcelLoadOptions, SchemaHint

#: File signatures, XML namespaces, default limit of the string table.
XLSX, OLE2 = b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
STRING_TABLE = 100 * 1024 * 1024


def is_xlsx(head: bytes) -> bool:
    return head[:4] == XLSX


def is_xls(head: bytes) -> bool:
    return head[:8] == OLE2


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


class Workbook:
    """Rows of a workbook as strings; sheets are streamed."""

    def __init__(self, data: bytes, max_string_table_bytes: int = 0):
        if not data:
            raise ExcelInvalid("the file is empty")
        if is_xls(data):
            # an encrypted .xlsx is an OLE2 file with this stream
            if "EncryptedPackage".encode("utf-16-le") in data:
                raise ExcelEncrypted("the workbook is encrypted")
            raise ExcelInvalid("the old .xls format is not supported")
        if not is_xlsx(data):
            raise ExcelInvalid("unrecognized Excel format")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
            links = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            raise ExcelInvalid(f"no workbook: {e}") from None
        target = {r.get("Id"): r.get("Target") for r in links}
        self.sheets = [(s.get("name"), target[s.get(LINK)]) for s in book.iter(f"{MAIN}sheet")]
        self.strings: list[str] = []
        names = self.zip.NameToInfo
        if "xl/sharedStrings.xml" in names:
            size = names["xl/sharedStrings.xml"].file_size
            if size > (max_string_table_bytes or STRING_TABLE):
                raise ExcelFileTooLarge(f"the string table has {size} bytes")
            table = ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))
            self.strings = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in table.iter(f"{MAIN}si")]

    @property
    def sheet_names(self) -> list[str]:
        return [n for n, _ in self.sheets]

    @property
    def string_table_size(self) -> int:
        """Strings of the shared table."""
        return len(self.strings)

    def row_count(self, sheet: str | int = "") -> int:
        """Rows with values, the header included."""
        return sum(1 for _ in self.rows(sheet))

    def path(self, sheet: str | int) -> str:
        names = [n for n, _ in self.sheets]
        if sheet == "":
            sheet = 0
        if isinstance(sheet, int):
            if not 0 <= sheet < len(names):
                raise ExcelInvalid(f"there is no sheet {sheet}")
        elif sheet not in names:
            raise ExcelInvalid(f"there is no sheet '{sheet}', only {names}")
        else:
            sheet = names.index(sheet)
        at = self.sheets[sheet][1]
        return at[1:] if at.startswith("/") else f"xl/{at}"

    def rows(self, sheet: str | int = "") -> Iterator[list[str]]:
        """Rows with values; gaps between cells are empty strings, empty rows are left out."""
        with self.zip.open(self.path(sheet)) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{MAIN}row":
                    continue
                row: list[str] = []
                for i, c in enumerate(e.iter(f"{MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    row.extend([""] * (at + 1 - len(row)))
                    row[at] = self._value(c)
                e.clear()
                if any(row):
                    yield row

    def _value(self, c: ElementTree.Element) -> str:
        kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
        if v is None or v.text is None:
            return ""
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "true" if v.text == "1" else "false"
        return v.text


def _books(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of the workbooks of a path (or of several, by commas), of any file system that the cluster knows."""
    return spark.read.format("binaryFile").load(path.split(",")).select("path", "content")


def read_xlsx(spark: SparkSession, path: str, options: ExcelLoadOptions | None = None, hint: SchemaHint | None = None) -> DataFrame:
    """Rows of a sheet of each workbook, as :func:`csv_files.read_csv` gives those of a CSV file.

    The first row of the first workbook (by path) gives the columns. Shorter rows are filled with nulls; a value beyond the
    columns fails the query with ExcelInvalid.
    """
    o = options or ExcelLoadOptions()
    ship(spark)
    books = _books(spark, path)
    first = books.agg(F.min("path").alias("path")).first().path
    if first is None:
        raise ExcelInvalid("there is no workbook")
    head = next(Workbook(bytes(books.where(F.col("path") == first).first().content), o.max_string_table_bytes).rows(o.sheet), None)
    if head is None:
        raise ExcelInvalid("the sheet is empty")
    if hint is not None:
        hint.validate(len(head))
    width, has_header, sheet, table = len(head), o.has_header, o.sheet, o.max_string_table_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = Workbook(content.as_py(), table).rows(sheet)
                if has_header:
                    next(rows, None)
                while part := list(islice(rows, 10_000)):
                    for row in part:
                        if any(row[width:]):
                            raise ExcelInvalid(f"a row of {at} has more than {width} columns")
                    columns = zip(*[row[:width] + [""] * (width - len(row)) for row in part])
                    yield pa.RecordBatch.from_arrays([pa.array([v or None for v in c], pa.string()) for c in columns], [f"c{i}" for i in range(width)])

    raw = books.mapInArrow(run, ", ".join(f"c{i} string" for i in range(width)))
    names = [c.name for c in hint.columns] if hint else head if has_header else [f"col_{i}" for i in range(width)]
    kinds = [c.type_id for c in hint.columns] if hint else [0] * width
    return raw.select(*[strict_cast(F.col(f"c{i}"), k, n).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])


def write_workbook(path: str | BinaryIO, sheets: dict[str, list[list[str]]]) -> None:
    """A workbook of string cells at a local path or in an open file; for small results."""
    from xml.sax.saxutils import escape

    main, rel = MAIN[1:-1], "http://schemas.openxmlformats.org/package/2006/relationships"
    office = LINK[1:-3]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{rel}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="s{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{rel}">{links}</Relationships>')
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="s{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        for i, rows in enumerate(sheets.values()):
            body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in row) + "</row>" for row in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
