"""Arrow IPC streams as an interchange format."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

from ..errors import ArrowError, ValidationError
from ..operators.validate import validate_batch_schema, validate_schema


def read_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    """All record batches of a stream; unsigned 64-bit columns become bigint."""
    if not data:
        raise ArrowError("empty Arrow IPC data")
    try:
        table = pa.ipc.open_stream(data).read_all()
    except (pa.ArrowInvalid, OSError) as e:
        raise ArrowError(f"no Arrow IPC stream: {e}") from None
    fields = [pa.field(f.name, pa.int64() if pa.types.is_uint64(f.type) else f.type, f.nullable) for f in table.schema]
    return spark.createDataFrame(table.cast(pa.schema(fields)))


def read_ipc_files(spark: SparkSession, path: str) -> DataFrame:
    """Stream files of one schema, each read by one task; the schema is that of the first file."""
    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.limit(1).collect()
    if not first:
        raise ArrowError(f"no files in {path}")
    schema = pa.ipc.open_stream(first[0].content).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from pa.ipc.open_stream(content.as_buffer()).read_all().cast(schema).to_batches()

    return files.mapInArrow(run, from_arrow_schema(schema))


def to_ipc(df: DataFrame) -> bytes:
    """A result as one stream of one batch; for results that fit the driver."""
    table = df.toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        for batch in table.to_batches() or [pa.RecordBatch.from_pylist([], table.schema)]:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_features(spark: SparkSession, data: bytes) -> DataFrame:
    """A feature frame: order_id and double features, with at least one row."""
    df = read_ipc(spark, data)
    validate_schema(df)
    if df.isEmpty():
        raise ValidationError("no rows")
    return df


def read_forecast_batch(spark: SparkSession, data: bytes) -> DataFrame:
    """sku_id, time_index, demand; further columns are left out. At least one row."""
    df = read_ipc(spark, data)
    validate_batch_schema(df)
    if df.isEmpty():
        raise ValidationError("no rows")
    return df.select("sku_id", "time_index", "demand")


def read_transactions(spark: SparkSession, data: bytes) -> DataFrame:
    """order_id, item_id from the first two columns, which must be strings whatever their names."""
    df = read_ipc(spark, data)
    fields = df.schema.fields
    if len(fields) < 2 or any(f.dataType.simpleString() != "string" for f in fields[:2]):
        raise ValidationError("the first two columns must be strings")
    if df.isEmpty():
        raise ValidationError("no rows")
    return df.select(df[0].alias("order_id"), df[1].alias("item_id"))
