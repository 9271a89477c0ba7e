"""Parquet sink with row groups of a set number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..types import ParquetWriteOptions


def write_parquet(df: DataFrame, path: str, options: ParquetWriteOptions | None = None, mode: str = "error") -> None:
    """One valid dataset; row groups hold ``row_group_size`` rows at most, compression is as asked."""
    o = options or ParquetWriteOptions()
    df.write.mode(mode).option("compression", o.compression.value).option("parquet.block.row.count.limit", o.row_group_size).parquet(path)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, last, n_rows, n_bytes, compression: the row groups of a dataset by the footers of its files, each read by one task."""
    ship(spark)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                meta = pq.ParquetFile(pa.BufferReader(content.as_buffer())).metadata
                n = meta.num_row_groups
                groups = [meta.row_group(i) for i in range(n)]
                kinds = [g.column(0).compression.lower() if g.num_columns else None for g in groups]
                columns = [[file] * n, list(range(n)), [i == n - 1 for i in range(n)], [g.num_rows for g in groups], [g.total_byte_size for g in groups], kinds]
                types = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "nth", "last", "n_rows", "n_bytes", "compression"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "content")
    return files.mapInArrow(footers, "file string, nth int, last boolean, n_rows bigint, n_bytes bigint, compression string")
