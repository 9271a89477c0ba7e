"""Queries of the readers, sinks and the wire format, on tables written out and read again."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import put, scratch, table
from ..sources.arrow_ipc import read_ipc, to_ipc
from ..sources.csv_files import infer_types, read_csv, write_csv
from ..sources.parquet_files import row_groups, write_parquet
from ..sources.xlsx import read_xlsx, write_workbook
from ..streaming.csv_stream import csv_to_parquet
from ..types import ColumnDef, CsvReadOptions, CsvWriteOptions, ExcelLoadOptions, ParquetWriteOptions, SchemaHint

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_HINT = SchemaHint([ColumnDef("order_id", 1), ColumnDef("customer", 1), ColumnDef("status", 0), ColumnDef("price", 2), ColumnDef("priority", 99)])


def _orders_csv(spark: SparkSession, d: str, options: CsvWriteOptions | None = None) -> str:
    out = scratch(spark)
    write_csv(table(spark, d, "orders").select(*_ORDERS), out, options)
    return out


def csv_lenient(spark: SparkSession, d: str) -> DataFrame:
    return read_csv(spark, _orders_csv(spark, d)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def csv_strict_types(spark: SparkSession, d: str) -> DataFrame:
    return read_csv(spark, _orders_csv(spark, d), hint=_HINT)


def _quoted(spark: SparkSession, d: str) -> DataFrame:
    """Orders with texts that need quotes: delimiters, quotes, line ends and blanks within; and a flag as the words of a hint's boolean."""
    o = table(spark, d, "orders")
    note = F.concat(F.lit('said "'), "o_orderpriority", F.lit('", then\n'), "o_orderstatus", F.lit(" "))
    words = F.array(*map(F.lit, ("true", "1", "yes", "T", "Y", "false", "0", "no", "F", "N")))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, note).otherwise(F.lit(", ")).alias("note"), F.get(words, (F.col("o_orderkey") % 10).cast("int")).alias("flag"))


def csv_quotes(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark)
    write_csv(_quoted(spark, d), out)
    return read_csv(spark, out, None, SchemaHint([ColumnDef("order_id", 1), ColumnDef("note", 0), ColumnDef("flag", 3)]))


def csv_no_header(spark: SparkSession, d: str) -> DataFrame:
    return read_csv(spark, _orders_csv(spark, d, CsvWriteOptions(has_header=False)), CsvReadOptions(has_header=False)).select("col_0", "col_2", "col_4")


def csv_custom_delimiter(spark: SparkSession, d: str) -> DataFrame:
    return read_csv(spark, _orders_csv(spark, d, CsvWriteOptions("|")), CsvReadOptions("|"), _HINT)


def csv_infer_types(spark: SparkSession, d: str) -> DataFrame:
    found = infer_types(read_csv(spark, _orders_csv(spark, d)))
    return spark.createDataFrame(sorted(found.items()), "name string, type string")


def csv_stream(spark: SparkSession, d: str) -> DataFrame:
    out, state = scratch(spark), scratch(spark)
    csv_to_parquet(spark, _orders_csv(spark, d), out, state, _HINT).awaitTermination()
    return spark.read.parquet(out)


def parquet_row_groups(spark: SparkSession, d: str) -> DataFrame:
    """What the footers of the written files say: rows, and row groups that are not as large as asked though they aren't the last of their file."""
    out = scratch(spark)
    write_parquet(table(spark, d, "orders"), out, ParquetWriteOptions(1024))

    odd = F.count_if(F.expr("n_rows > 1024 or (n_rows <> 1024 and not last)"))
    return row_groups(spark, out).agg(F.sum("n_rows").alias("rows"), odd.alias("odd_groups"))


def arrow_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return read_ipc(spark, to_ipc(table(spark, d, "nation")))


def xlsx_read(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")  # a few rows in any size
    book, at = io.BytesIO(), f"{scratch(spark)}/book.xlsx"
    write_workbook(book, {"other": [["x"], ["1"]], "nation": [nation.columns, *[[str(v) for v in r] for r in nation.collect()]]})
    put(spark, at, book.getvalue())
    hint = SchemaHint([ColumnDef("n_nationkey", 1), ColumnDef("n_name", 0), ColumnDef("n_regionkey", 1)])
    return read_xlsx(spark, at, ExcelLoadOptions("nation"), hint)


_TYPED = "SELECT o_orderkey order_id, o_custkey customer, o_orderstatus status, o_totalprice price, o_orderpriority priority FROM orders"


def queries() -> dict:
    return {f.__name__: f for f in (csv_lenient, csv_strict_types, csv_quotes, csv_no_header, csv_custom_delimiter, csv_infer_types, csv_stream, parquet_row_groups, arrow_roundtrip, xlsx_read)}


def oracle_sql() -> dict[str, str]:
    return {
        "csv_lenient": "SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, o_orderstatus, o_orderpriority FROM orders",
        "csv_strict_types": _TYPED,
        "csv_quotes": "SELECT o_orderkey order_id, CASE WHEN o_orderkey % 3 = 0 THEN 'said \"' || o_orderpriority || '\", then' || chr(10) || o_orderstatus || ' ' ELSE ', ' END note, o_orderkey % 10 < 5 flag FROM orders",
        "csv_no_header": "SELECT CAST(o_orderkey AS VARCHAR) col_0, o_orderstatus col_2, o_orderpriority col_4 FROM orders",
        "csv_custom_delimiter": _TYPED,
        "csv_infer_types": "SELECT * FROM (VALUES ('o_custkey', 'bigint'), ('o_orderkey', 'bigint'), ('o_orderpriority', 'string'), ('o_orderstatus', 'string'), ('o_totalprice', 'double')) t(name, type)",
        "csv_stream": _TYPED,
        "parquet_row_groups": 'SELECT count(*) AS "rows", 0::BIGINT odd_groups FROM orders',
        "arrow_roundtrip": "SELECT * FROM nation",
        "xlsx_read": "SELECT CAST(n_nationkey AS BIGINT) n_nationkey, n_name, CAST(n_regionkey AS BIGINT) n_regionkey FROM nation",
    }
