"""Baskets of the transaction lines, for the operators on sets of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_of(column: str | Column) -> Column:
    """Item of a line: without surrounding blanks and tabs, in upper case; null where nothing is left."""
    c = F.upper(F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(" \t")))
    return F.when(c != "", c)


def basket_items(lines: DataFrame, order_col: str = "order_id", item_col: str = "item_id") -> DataFrame:
    """order_id, item: each distinct item of each order once; partial aggregation before the shuffle."""
    rows = lines.select(lines[order_col].alias("order_id"), item_of(lines[item_col]).alias("item"))
    return rows.where("order_id is not null and item is not null").distinct()


def baskets(lines: DataFrame, order_col: str = "order_id", item_col: str = "item_id") -> DataFrame:
    """order_id, items: the sorted set of items of each order that has any."""
    rows = lines.select(lines[order_col].alias("order_id"), item_of(lines[item_col]).alias("item"))
    rows = rows.where("order_id is not null and item is not null")
    return rows.groupBy("order_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
