"""Demand forecasts by least squares on features of time, one series or one for each key.

A series costs one shuffle by its key. The position in time is a row number, the sums of
products of the features are partial aggregates, and one small system is solved for each
series, many at once. Scaling of the target is affine and least squares follow affine
maps, so scaled forecasts are derived from the unscaled fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..session import cut, ship
from ..types import EPSILON, PredictionMode, ScalingMethod
from .validate import validate_batch_schema

#: A key with more rows than this is numbered by a range sort over many tasks.
HOT = 5_000_000
#: Residual share of a feature's variance below which the features count as dependent; variance that counts as none.
RANK, NOTHING = 1e-10, 1e-18
TOO_SHORT = "prediction requires at least 2 data points"
SINGULAR = "regression fitting failed: singular"
MISSING = "demand holds null, NaN or infinite values"


def features(t: Column, n: Column, mode: PredictionMode) -> list[Column]:
    """Features of time. Powers are of (t - (n-1)/2) / n, which spans the same space as powers of t and is well conditioned."""
    if mode.kind in ("seasonal", "ensemble") and mode.period <= 0:
        raise ValidationError("the season period must be positive")
    u = (t - (n - 1) / 2) / n
    turn = F.lit(2.0) * F.pi() * t / F.lit(float(mode.period))
    if mode.kind == "seasonal":
        return [u, F.sin(turn), F.cos(turn)]
    if mode.kind == "ensemble":
        return [u, u * u, F.sin(turn), F.cos(turn)]
    out = [u]
    for _ in range(1, mode.degree if mode.kind == "polynomial" else 1):
        out.append(out[-1] * u)
    return out


def positions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``t`` (from 0, by ``order`` within ``key``) and ``n`` (rows of the key).

    Keys of up to HOT rows are numbered in a window; larger ones, if there are any, by a range sort whose
    partitions are counted, so that no task takes a whole hot key.
    """
    own = Window.partitionBy(key)
    t = F.row_number().over(own.orderBy(*order)).cast("bigint") - 1
    counts = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    if counts.isEmpty():
        return df.withColumns({"t": t, "n": F.count("*").over(own)})
    counts = cut(counts)
    cold = df.join(counts, df[key] == counts["__key"], "left_anti").withColumns({"t": t, "n": F.count("*").over(own)})
    rows = df.join(counts, df[key] == counts["__key"]).drop("__key")
    big = cut(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__at", F.monotonically_increasing_id()))
    big = big.withColumn("__part", F.shiftright("__at", 33))
    held = big.groupBy(key, "__part").agg(F.count("*").alias("__held"), F.min("__at").alias("__low"))
    before = F.coalesce(F.sum("__held").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("__before", before).drop("__held")
    warm = big.join(held, [key, "__part"]).withColumn("t", F.col("__at") - F.col("__low") + F.col("__before"))
    return cold.unionByName(warm.select(*cold.columns))


def solve(n: np.ndarray, sy: np.ndarray, sx: np.ndarray, sxx: np.ndarray, sxy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ok, intercepts, coefficients) of many systems: Cholesky of the centred, scaled Gram matrix with a rank test."""
    m, k = sx.shape
    mean, my = sx / n[:, None], sy / n
    g = sxx / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    b = sxy / n[:, None] - mean * my[:, None]
    var = np.einsum("mii->mi", g).copy()
    ok = (var > NOTHING).all(1)
    s = np.sqrt(np.where(var > NOTHING, var, 1.0))
    g, b = g / (s[:, :, None] * s[:, None, :]), b / s
    low = np.zeros((m, k, k))
    for j in range(k):
        rest = g[:, j, j] - (low[:, j, :j] ** 2).sum(1)
        ok &= rest > RANK
        low[:, j, j] = np.sqrt(np.where(rest > RANK, rest, 1.0))
        for i in range(j + 1, k):
            low[:, i, j] = (g[:, i, j] - (low[:, i, :j] * low[:, j, :j]).sum(1)) / low[:, j, j]
    x = b.copy()
    for j in range(k):
        x[:, j] = (x[:, j] - (low[:, j, :j] * x[:, :j]).sum(1)) / low[:, j, j]
    for j in reversed(range(k)):
        x[:, j] = (x[:, j] - (low[:, j + 1 :, j] * x[:, j + 1 :]).sum(1)) / low[:, j, j]
    x /= s
    return ok, my - (mean * x).sum(1), x


def _fit(k: int):
    """Pandas UDF of the moments (sy, sx, sxx upper triangle, sxy) of series: null where singular, else intercept and coefficients."""
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    @F.pandas_udf("array<double>")
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for n, moments in batches:
            if not len(n):
                yield pd.Series([], dtype=object)
                continue
            a = np.array(moments.tolist(), dtype=float).reshape(len(n), -1)
            sxx = np.zeros((len(n), k, k))
            for q, (i, j) in enumerate(upper):
                sxx[:, i, j] = sxx[:, j, i] = a[:, 1 + k + q]
            with np.errstate(all="ignore"):
                ok, c, x = solve(n.to_numpy(float), a[:, 0], a[:, 1 : 1 + k], sxx, a[:, 1 + k + len(upper) :])
            ok &= n.to_numpy() >= 2
            yield pd.Series([np.r_[ci, xi] if o else None for o, ci, xi in zip(ok, c, x)], dtype=object)

    return fit


def fit_series(df: DataFrame, key: str, order: list[str], value: str, mode: PredictionMode) -> DataFrame:
    """One row for each key: n, missing (values that are null, NaN or infinite), statistics of the values and beta (null: no fit)."""
    ship(df.sparkSession)
    named = df.select(F.col(key).alias("sku_id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("y")).where("sku_id is not null")
    rows = positions(named, "sku_id", [f"o{i}" for i in range(len(order))] + ["y"])
    t, n, y = F.col("t").cast("double"), F.col("n").cast("double"), F.col("y")
    x = features(t, n, mode)
    k = len(x)
    fine = y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    rows = rows.select("sku_id", "n", F.when(fine, y).alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    xs = [F.col(f"x{i}") for i in range(k)]
    y = F.col("y")
    moments = [F.sum(y), *map(F.sum, xs), *[F.sum(xs[i] * xs[j]) for i in range(k) for j in range(i, k)], *[F.sum(c * y) for c in xs]]
    out = rows.groupBy("sku_id").agg(
        F.count("*").alias("n"),
        (F.count("*") - F.count("y")).alias("missing"),
        F.min("y").alias("low"),
        F.max("y").alias("high"),
        F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("deviation"),
        F.array(*[F.coalesce(m, F.lit(0.0)) for m in moments]).alias("moments"),
    )
    return out.withColumn("beta", _fit(k)("n", "moments")).drop("moments")


def forecast(df: DataFrame, key: str, order: list[str], value: str, steps: int, mode: PredictionMode, scaling: ScalingMethod = ScalingMethod.NONE, inverse_scale: bool = False) -> DataFrame:
    """sku_id, step_index, prediction, error_code, error_message: ``steps`` rows for each key, or one error row.

    Time is the position by ``order``, not its values (ties: by value). Predictions are in the units of the scaled
    target unless ``inverse_scale``. Keys with fewer than 2 rows or missing values get ValidationError, dependent
    features ModelError. Rows with a null key are left out. Repeated rows are points of their own.
    """
    if steps < 1:
        raise ValidationError("predict_steps must be at least 1")
    fits = fit_series(df, key, order, value, mode)
    code = F.when((F.col("missing") > 0) | (F.col("n") < 2), "ValidationError").when(F.col("beta").isNull(), "ModelError")
    said = F.when(F.col("missing") > 0, MISSING).when(F.col("n") < 2, TOO_SHORT).when(F.col("beta").isNull(), SINGULAR)
    rows = fits.withColumns({"error_code": code, "error_message": said})
    none = F.array(F.lit(None).cast("int"))
    rows = rows.withColumn("step_index", F.explode(F.when(F.col("error_code").isNull(), F.sequence(F.lit(0), F.lit(steps - 1))).otherwise(none)))
    t, n = (F.col("n") + F.col("step_index")).cast("double"), F.col("n").cast("double")
    p = F.col("beta")[0]
    for i, x in enumerate(features(t, n, mode)):
        p = p + F.col("beta")[i + 1] * x
    if scaling != ScalingMethod.NONE and not inverse_scale:
        shift, spread = (F.col("low"), F.col("high") - F.col("low")) if scaling == ScalingMethod.MIN_MAX else (F.col("mean"), F.col("deviation"))
        p = F.when(F.abs(spread) < EPSILON, F.lit(0.0)).otherwise((p - shift) / spread)
    return rows.select("sku_id", "step_index", F.when(F.col("error_code").isNull(), p).alias("prediction"), "error_code", "error_message")


def forecast_batch(df: DataFrame, steps: int, mode: str = "linear", scaling: str = "none", period: int = 7, inverse_scale: bool = False) -> DataFrame:
    """Forecast of each sku_id of a frame that begins with sku_id, time_index, demand; further columns aren't read."""
    validate_batch_schema(df)
    return forecast(df, "sku_id", ["time_index"], "demand", steps, PredictionMode.from_name(mode, period), ScalingMethod.of(scaling), inverse_scale)


def forecast_series(df: DataFrame, order: list[str], value: str, steps: int, mode: PredictionMode, scaling: ScalingMethod = ScalingMethod.NONE, inverse_scale: bool = False) -> DataFrame:
    """step_index, prediction of one series; an error of the series fails the query with its text."""
    out = forecast(df.withColumn("__one", F.lit("series")), "__one", order, value, steps, mode, scaling, inverse_scale)
    said = F.raise_error(F.concat_ws(": ", "error_code", "error_message"))
    return out.select(F.coalesce("step_index", F.when(F.col("error_code").isNotNull(), said.cast("int"))).alias("step_index"), "prediction")


def linear_regression(df: DataFrame, x: str, y: str, steps: int) -> DataFrame:
    """step_index, prediction: a line through (x, y), at x = n+1 .. n+steps whatever the values of x."""
    if steps < 1:
        raise ValidationError("predict_steps must be at least 1")
    c, v = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.agg(F.count("*").alias("n"), F.regr_slope(v, c).alias("b"), F.regr_intercept(v, c).alias("a"))
    step = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    return fit.withColumn("step_index", step).select("step_index", (F.col("a") + F.col("b") * (F.col("n") + 1 + F.col("step_index"))).alias("prediction"))
