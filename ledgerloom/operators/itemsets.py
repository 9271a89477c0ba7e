"""Frequent itemsets with absolute supports."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..session import cut


def transactions(lines: DataFrame, order_col: str = "order_id", item_col: str = "item_id") -> DataFrame:
    """order_id, items: the distinct items of each order; rows with a null are left out."""
    rows = lines.select(F.col(order_col).alias("order_id"), F.col(item_col).alias("item")).where("order_id is not null and item is not null")
    return rows.groupBy("order_id").agg(F.collect_set("item").alias("items"))


def item_support(lines: DataFrame, order_col: str = "order_id", item_col: str = "item_id") -> DataFrame:
    """item, support: the orders that hold each item."""
    rows = lines.select(F.col(order_col).alias("order_id"), F.col(item_col).alias("item")).where("order_id is not null and item is not null")
    return rows.distinct().groupBy("item").agg(F.count("*").alias("support"))


def frequent_itemsets(baskets: DataFrame, min_support: int, items_col: str = "items") -> DataFrame:
    """pattern, support: all itemsets in at least ``min_support`` baskets, items in order of falling support (ties: by item).

    Items keep their type, whatever it is. No patterns is a valid result of no rows. Baskets must hold each item once.
    """
    if min_support < 1:
        raise ValidationError("min_support must be at least 1")
    baskets = cut(baskets.select(F.col(items_col).alias("items")).where(F.size("items") > 0))  # read three times
    n = baskets.count()
    spark = baskets.sparkSession
    if not n or min_support > n:
        return spark.createDataFrame([], f"pattern {baskets.schema['items'].dataType.simpleString()}, support bigint")
    # the miner takes a share and rounds it up to a count
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_support - 0.5) / n), minConfidence=1.0).fit(baskets).freqItemsets
    found = cut(found.where(F.col("freq") >= min_support))  # mined once
    support = found.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), F.col("freq").alias("own"))
    ranked = found.select("items", "freq", F.explode("items").alias("item")).join(support, "item")
    ranked = ranked.groupBy("items", "freq").agg(F.array_sort(F.collect_list(F.struct((-F.col("own")).alias("o"), "item"))).alias("r"))
    return ranked.select(F.transform("r", lambda x: x["item"]).alias("pattern"), F.col("freq").alias("support"))


def eliminated_baskets(baskets: DataFrame, min_support: int, items_col: str = "items", id_col: str = "order_id") -> DataFrame:
    """order_id, lost: baskets that hold an item below ``min_support``, and how many such items."""
    rows = baskets.select(F.col(id_col).alias("order_id"), F.explode(items_col).alias("item")).distinct()
    rare = rows.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") < min_support).select("item")
    return rows.join(rare, "item").groupBy("order_id").agg(F.count("*").alias("lost"))
