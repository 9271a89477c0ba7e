"""Column expressions: strict casts and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that a strict cast takes; blanks are never trimmed.
INTEGER = r"^[+-]?[0-9]+\z"
FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z"
TRUE, FALSE = ("true", "1", "yes", "t", "y"), ("false", "0", "no", "f", "n")


def _bare(c: Column) -> Column:
    """No blank or control character at either end, which a cast would trim."""
    return F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126)


def _usual(c: Column) -> Column:
    """A text between a sign, point or digit and a point or digit, not hexadecimal: such a text is a number by Spark's cast if it is one by FLOAT."""
    last = F.ascii(F.substring(c, -1, 1))
    return F.ascii(c).isin(43, 45, 46, *range(48, 58)) & (last.between(48, 57) | (last == 46)) & ~F.contains(F.lower(c), F.lit("x"))


def cast_or_null(c: Column, type_id: int) -> Column:
    """A text as its type; null for an empty text and for one that doesn't fit.

    The patterns are only matched where looking at the ends of a text doesn't settle it.
    """
    if type_id == 1:
        return F.when(_bare(c), c.try_cast("bigint"))
    if type_id == 2:
        return F.when(_usual(c) | c.rlike(FLOAT), c.try_cast("double"))
    if type_id == 3:
        low = F.lower(c)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    return F.when(c != "", c)


def strict_cast(c: Column, type_id: int, name: str) -> Column:
    """As :func:`cast_or_null`, but a text that doesn't fit fails the query with TypeConversionFailed."""
    out = cast_or_null(c, type_id)
    kind = {1: "bigint", 2: "double", 3: "boolean"}.get(type_id)
    if kind is None:
        return out
    said = F.concat(F.lit(f"TypeConversionFailed: column '{name}': "), c, F.lit(f" is no {kind}"))
    return F.coalesce(out, F.when(c != "", F.raise_error(said).cast(kind)))


def reaches(score: Column, threshold: float) -> Column:
    """score >= threshold, false for null and NaN."""
    return F.coalesce((score >= F.lit(float(threshold))) & ~F.isnan(score), F.lit(False))
