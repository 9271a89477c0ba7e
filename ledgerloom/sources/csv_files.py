"""CSV files: lenient (all strings), or strict by a schema hint."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CsvMissingHeader, InvalidCsv, ValidationError
from ..functions.casts import FLOAT, INTEGER, strict_cast
from ..types import CsvReadOptions, CsvWriteOptions, NullHandling, SchemaHint


def _reader(spark: SparkSession, o: CsvReadOptions, header: bool):
    if len(o.delimiter) != 1:
        raise ValidationError("the delimiter must be one character")
    settings = {"sep": o.delimiter, "header": header, "multiLine": bool(o.multi_line), "quote": '"', "escape": '"', "inferSchema": False, "enforceSchema": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8", "mode": "PERMISSIVE", "nullValue": "￾", "emptyValue": "", "maxColumns": 20480, "maxCharsPerColumn": -1}
    return spark.read.options(**settings)


def surveyed(spark: SparkSession, path: str, o: CsvReadOptions) -> CsvReadOptions:
    """``o`` with multi_line decided, after one scan of the lines; bytes that are no UTF-8 are InvalidCsv.

    A line with an odd number of quotes may go on in the next one; without such lines no record spans two, and large files
    can be split among tasks.
    """
    line = F.col("value")
    quotes = F.when(F.contains(line, F.lit('"')), F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit(""))))
    r = spark.read.text(path).agg(
        F.max(F.coalesce(quotes % 2 == 1, F.lit(False))).alias("open"),
        F.min(F.when(~F.is_valid_utf8(line), F.col("_metadata.file_path"))).alias("bad"),
    ).first()
    if r.bad is not None:
        raise InvalidCsv(f"{r.bad} holds bytes that are no UTF-8")
    return o if o.multi_line is not None else replace(o, multi_line=bool(r.open))


def header_of(spark: SparkSession, path: str, o: CsvReadOptions) -> list[str]:
    """Fields of the first record."""
    first = _reader(spark, o, False).csv(path)
    if not first.columns:
        raise CsvMissingHeader("the file is empty")
    rows = first.limit(1).collect()
    if not rows:
        raise CsvMissingHeader("the file is empty")
    return [v or "" for v in rows[0]]


def read_csv(spark: SparkSession, path: str, options: CsvReadOptions | None = None, hint: SchemaHint | None = None) -> DataFrame:
    """Rows of CSV files (RFC 4180 quotes; line ends LF, CR LF or CR; nothing is trimmed; blank lines are skipped).

    Without a hint all columns are strings, named by the header or col_N. With one, names and types are the hint's,
    its length must be that of the first record, and a value that doesn't fit fails the query. Short rows are
    filled with nulls, further fields are dropped. An empty field is null; with EMPTY_STRING a string column
    keeps it as ''. A file of only a header has no rows; an empty one is CsvMissingHeader, bytes that are no UTF-8 are InvalidCsv.
    """
    o = surveyed(spark, path, options or CsvReadOptions())
    first = header_of(spark, path, o)
    if hint is not None:
        hint.validate(len(first))
    plain = [f"c{i}" for i in range(len(first))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in plain])
    raw = _reader(spark, o, o.has_header).schema(schema).csv(path)
    names = [c.name for c in hint.columns] if hint else first if o.has_header else [f"col_{i}" for i in range(len(first))]
    kinds = [c.type_id for c in hint.columns] if hint else [0] * len(names)
    out = []
    for c, name, kind in zip(plain, names, kinds):
        value = F.col(c)
        if kind not in (1, 2, 3) and o.null_handling == NullHandling.EMPTY_STRING:
            value = F.coalesce(value, F.lit(""))
        elif kind not in (1, 2, 3):
            value = F.when(value != "", value)
        else:
            value = strict_cast(value, kind, name)
        out.append(value.alias(name))
    return raw.select(*out)


def infer_types(df: DataFrame, rows: int | None = None) -> dict[str, str]:
    """Types of string columns by all rows, or by at most ``rows`` of them: bigint if all values are, else double if all are, else string.

    An empty or missing value makes a column a string. One aggregated row.
    """
    sample = df if rows is None else df.limit(rows)
    tests = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        whole = F.coalesce(v.rlike(INTEGER) & v.try_cast("bigint").isNotNull(), F.lit(False))
        tests += [F.bool_and(whole).alias(f"i{i}"), F.bool_and(F.coalesce(v.rlike(FLOAT), F.lit(False))).alias(f"d{i}")]
    r = sample.agg(*tests).first()
    return {c: "bigint" if r[f"i{i}"] else "double" if r[f"d{i}"] else "string" for i, c in enumerate(df.columns)}


def write_csv(df: DataFrame, path: str, options: CsvWriteOptions | None = None) -> None:
    """The reverse way: a folder of CSV files."""
    o = options or CsvWriteOptions()
    df.write.mode("error").options(sep=o.delimiter, header=o.has_header, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
