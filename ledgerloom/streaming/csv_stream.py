"""CSV files that arrive in a folder, converted as they come."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.casts import strict_cast
from ..types import CsvReadOptions, SchemaHint


def csv_to_parquet(spark: SparkSession, folder: str, out: str, state: str, hint: SchemaHint, options: CsvReadOptions | None = None, continuous: bool = False) -> StreamingQuery:
    """Every file once: ``state`` remembers which are done. Takes what is there and stops, or goes on if ``continuous``."""
    o = options or CsvReadOptions()
    hint.validate(len(hint.columns))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(hint.columns))])
    raw = spark.readStream.schema(schema).options(sep=o.delimiter, header=o.has_header, multiLine=o.multi_line is not False, escape='"').csv(folder)
    rows = raw.select(*[strict_cast(F.col(f"c{i}"), c.type_id, c.name).alias(c.name) for i, c in enumerate(hint.columns)])
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
    return (writer if continuous else writer.trigger(availableNow=True)).start()
