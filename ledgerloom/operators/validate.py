"""Checks of arguments, schemas and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArrowError, ValidationError
from ..types import MAX_FEATURES, STRICT_DIMS


def validate_threshold(threshold: float) -> None:
    if not 0.0 <= threshold <= 1.0:
        raise ValidationError(f"threshold must be 0-1, got {threshold}")


def validate_schema(df: DataFrame, id_col: str = "order_id") -> list[str]:
    """Feature columns of a feature frame: the first column is the string key, all others are doubles."""
    first, *rest = df.schema.fields
    if first.name != id_col or first.dataType.simpleString() != "string":
        raise ValidationError(f"the first column must be {id_col} of type string, got {first.name} of {first.dataType.simpleString()}")
    for f in rest:
        if f.dataType.simpleString() != "double":
            raise ArrowError(f"feature {f.name} must be double, got {f.dataType.simpleString()}")
    if not rest:
        raise ValidationError("no feature columns")
    return [f.name for f in rest]


def validate_batch_schema(df: DataFrame) -> None:
    """The first three columns must be sku_id string, time_index double, demand double; more are ignored."""
    want = [("sku_id", "string"), ("time_index", "double"), ("demand", "double")]
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields[:3]]
    if got != want:
        raise ValidationError(f"the columns must begin with {want}, got {got}")


def validate_dims(n: int, strict: bool = False) -> None:
    """2 to 16 features; ``strict`` allows only the widths with a fixed kernel."""
    if n > MAX_FEATURES:
        raise ValidationError(f"at most {MAX_FEATURES} features are supported, got {n}")
    if n < 2:
        raise ValidationError(f"at least 2 features are needed, got {n}")
    if strict and n not in STRICT_DIMS:
        raise ValidationError(f"{n} features are not supported, use one of {STRICT_DIMS}")


def feature_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: rows, and how many hold a null, a NaN or an infinity in a feature; one scan."""
    some = lambda test: F.count_if(reduce(lambda a, b: a | b, [test(F.col(f"`{c}`")) for c in features]))
    return df.agg(
        F.count("*").alias("rows"),
        some(lambda c: c.isNull()).alias("null_rows"),
        some(lambda c: F.coalesce(F.isnan(c), F.lit(False))).alias("nan_rows"),
        some(lambda c: F.coalesce(F.abs(c) == float("inf"), F.lit(False))).alias("infinite_rows"),
    )


def validate_features(df: DataFrame, features: list[str]) -> int:
    """Number of rows; a ValidationError for no rows, no features, and nulls, NaN or infinities."""
    if not features:
        raise ValidationError("no feature columns")
    r = feature_counts(df, features).first()
    if not r.rows:
        raise ValidationError("the feature frame is empty")
    if r.null_rows or r.nan_rows or r.infinite_rows:
        raise ValidationError(f"features hold null in {r.null_rows}, NaN in {r.nan_rows} and infinity in {r.infinite_rows} rows")
    return r.rows
