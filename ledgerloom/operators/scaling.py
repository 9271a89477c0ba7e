"""Min-max and standard scaling, of a whole table or of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import EPSILON, ScalingMethod


def _number(c: Column) -> Column:
    """NaN counts as missing in the statistics, and only there."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def _statistics(c: Column, method: ScalingMethod) -> tuple[Column, Column]:
    """(shift, spread) as aggregates."""
    if method == ScalingMethod.MIN_MAX:
        return F.min(_number(c)), F.max(_number(c)) - F.min(_number(c))
    return F.avg(c), F.stddev_pop(c)


def scaled(c: Column, shift: Column, spread: Column) -> Column:
    """(c - shift) / spread, 0 where the spread is below the double epsilon (in absolute terms)."""
    return F.when(F.abs(spread) < EPSILON, F.lit(0.0)).otherwise((c.cast("double") - shift) / spread)


def scale(df: DataFrame, columns: list[str], method: ScalingMethod | int | str, by: str | None = None) -> DataFrame:
    """``columns`` scaled in place; all other columns stay.

    Min-max: (x - min) / (max - min); standard: (x - mean) / population deviation; constant columns become 0.
    Over the table the statistics are one aggregated row that is broadcast; ``by`` scales each group by its own,
    which are joined to the rows so that a large group is no single task's.
    """
    method = ScalingMethod.of(method)
    if method == ScalingMethod.NONE or not columns:
        return df
    stats = []
    for i, c in enumerate(columns):
        shift, spread = _statistics(F.col(f"`{c}`"), method)
        stats += [shift.alias(f"__shift{i}"), spread.alias(f"__spread{i}")]
    if by is None:
        joined = df.crossJoin(F.broadcast(df.agg(*stats)))  # one row
    else:
        groups = df.groupBy(F.col(f"`{by}`").alias("__by")).agg(*stats)
        joined = df.join(groups, df[by].eqNullSafe(groups["__by"]))
    new = {c: scaled(F.col(f"`{c}`"), F.col(f"__shift{i}"), F.col(f"__spread{i}")) for i, c in enumerate(columns)}
    return joined.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in df.columns])


def normalize_scores(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """A score column by min-max; 0 where all scores are equal."""
    stats = df.agg(F.min(F.col(f"`{column}`")).alias("__low"), F.max(F.col(f"`{column}`")).alias("__high"))
    c, low, high = F.col(f"`{column}`"), F.col("__low"), F.col("__high")
    return df.crossJoin(F.broadcast(stats)).withColumn(out or column, F.when(high > low, (c - low) / (high - low)).otherwise(0.0)).drop("__low", "__high")

