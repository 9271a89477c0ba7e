"""The eight entry points, on Arrow IPC bytes and files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .errors import ValidationError
from .operators.clustering import kmeans
from .operators.forecast import forecast_batch, forecast_series
from .operators.iforest import anomalies
from .operators.itemsets import frequent_itemsets, transactions
from .operators.scaling import scale
from .operators.validate import validate_dims, validate_threshold
from .sources.arrow_ipc import read_features, read_forecast_batch, read_transactions, to_ipc
from .sources.csv_files import read_csv
from .sources.parquet_files import write_parquet
from .sources.xlsx import read_xlsx
from .types import Compression, CsvReadOptions, ExcelLoadOptions, ParquetWriteOptions, PredictionMode, ScalingMethod, SchemaHint


def detect_order_anomalies(spark: SparkSession, data: bytes, threshold: float, scaling_mode: int = 0) -> bytes:
    """order_id, abnormal_score, is_abnormal of a feature frame."""
    validate_threshold(threshold)
    return to_ipc(anomalies(read_features(spark, data), threshold, scaling_mode))


def segment_customer_orders(spark: SparkSession, data: bytes, n_clusters: int, scaling_mode: int = 0) -> bytes:
    """order_id, cluster_id of a feature frame."""
    df = read_features(spark, data)
    features = df.columns[1:]
    validate_dims(len(features))
    return to_ipc(kmeans(scale(df, features, scaling_mode), features, n_clusters))


def predict_inventory_demand(spark: SparkSession, data: bytes, predict_steps: int, scaling_mode: int = 0, prediction_mode: int = 0, season_period: int = 0, inverse_scale: bool = False) -> bytes:
    """step_index, prediction of the third column of a feature frame, ordered by the second."""
    df = read_features(spark, data)
    if len(df.columns) < 3:
        raise ValidationError("at least 2 feature columns are needed")
    return to_ipc(forecast_series(df, [df.columns[1]], df.columns[2], predict_steps, PredictionMode.from_code(prediction_mode, season_period), ScalingMethod.of(scaling_mode), inverse_scale).orderBy("step_index"))


def predict_inventory_demand_batch(spark: SparkSession, data: bytes, predict_steps: int, mode: str = "linear", scaling: str = "none", period: int = 7) -> bytes:
    """sku_id, step_index, prediction, error_code, error_message of each sku_id, in the order in which they first appear."""
    rows = read_forecast_batch(spark, data)
    seen = rows.withColumn("at", F.monotonically_increasing_id()).groupBy(F.col("sku_id").alias("sku")).agg(F.min("at").alias("at"))  # rows keep their order
    out = forecast_batch(rows, predict_steps, mode, scaling, period)
    return to_ipc(out.join(seen, F.col("sku_id") == F.col("sku")).orderBy("at", "step_index").select(*out.columns))


def find_association_patterns(spark: SparkSession, data: bytes, min_support: int) -> bytes:
    """pattern, support of (order, item) rows."""
    if min_support < 1:
        raise ValidationError("min_support must be at least 1")
    return to_ipc(frequent_itemsets(transactions(read_transactions(spark, data)), min_support))


def convert_csv_to_parquet(spark: SparkSession, path: str, out: str, delimiter: str = ",", has_header: bool = True, row_group_size: int = 1024, schema_hint_json: str | None = None, compression: Compression = Compression.UNCOMPRESSED) -> None:
    """CSV files to one Parquet dataset."""
    write = ParquetWriteOptions(row_group_size, compression)
    hint = SchemaHint.from_json(schema_hint_json) if schema_hint_json else None
    write_parquet(read_csv(spark, path, CsvReadOptions(delimiter, has_header), hint), out, write)


def convert_excel_to_parquet(spark: SparkSession, path: str, out: str, sheet_name: str = "", has_header: bool = True, row_group_size: int = 1024, max_string_table_bytes: int = 0, schema_hint_json: str | None = None, compression: Compression = Compression.UNCOMPRESSED) -> None:
    """A sheet of a workbook to one Parquet dataset."""
    write = ParquetWriteOptions(row_group_size, compression)
    hint = SchemaHint.from_json(schema_hint_json) if schema_hint_json else None
    write_parquet(read_xlsx(spark, path, ExcelLoadOptions(sheet_name, has_header, max_string_table_bytes), hint), out, write)


def get_version() -> str:
    """Version of the package."""
    return __version__
