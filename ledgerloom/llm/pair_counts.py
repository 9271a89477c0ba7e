"""Items that appear together: a blocked Gram matrix of baskets and items.

The transactions are a sparse binary matrix X of records and items. Tasks take the records
in blocks and cut each record block into binary sparse item blocks. For each pair of item
blocks I, J that a record block holds, a transpose-product gives the sparse tile X_I' X_J; the
sum of a tile over all record blocks holds the counts of its pairs. Dividing by the counts
expected from the marginals gives the lift.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship, small

#: Least width of an item block (in codes) and most blocks there are; entries of a record block; pairs that a product expands at once.
WIDTH, MOST_BLOCKS, RECORD_BLOCK, EXPANDED = 4096, 64, 500_000, 4_000_000
#: Entries of a record that lie in one task: a record of more is cut into segments, and each pair of segments is a record of its own.
SEGMENT = 2048

Tile = tuple[np.ndarray, np.ndarray, np.ndarray]


class ItemBlock:
    """The columns of a record block within one item block: a run of codes for each record that has any."""

    def __init__(self, record: np.ndarray, start: np.ndarray, length: np.ndarray, codes: np.ndarray):
        self.record, self.start, self.length, self.codes = record, start, length, codes


def item_blocks(record: np.ndarray, codes: np.ndarray, width: int) -> dict[int, ItemBlock]:
    """The item blocks of a record block, by number; entries sorted by (record, code), each once."""
    if not len(record):
        return {}
    block = codes // width
    start = np.nonzero(np.r_[True, (record[1:] != record[:-1]) | (block[1:] != block[:-1])])[0]
    length = np.diff(np.r_[start, len(record)])
    of = block[start]
    return {int(b): ItemBlock(record[start[at]], start[at], length[at], codes) for b in np.unique(of) for at in (np.nonzero(of == b)[0],)}


def _chunks(reps: np.ndarray) -> Iterator[slice]:
    """Runs of rows whose pairs are at most EXPANDED (or one row)."""
    ends, first = np.cumsum(reps), 0
    while first < len(reps):
        base = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, base + EXPANDED, "right")))
        yield slice(first, stop)
        first = stop


def _summed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Tile:
    """Cells (i, j) of a tile with their counts; each part is counted before the next is expanded."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for i, j in parts:
        k, c = np.unique((i << 32) | j, return_counts=True)
        if len(keys):
            both, where = np.unique(np.r_[keys, k], return_inverse=True)
            keys, counts = both, np.bincount(where, np.r_[counts, c], len(both)).astype(np.int64)
        else:
            keys, counts = k, c
    return keys >> 32, keys & 0xFFFFFFFF, counts


def transpose_product(a: ItemBlock, b: ItemBlock) -> Tile:
    """The tile A'B of two item blocks of one record block, the smaller code of a cell first."""
    _, x, y = np.intersect1d(a.record, b.record, assume_unique=True, return_indices=True)
    la, lb, sa, sb = a.length[x], b.length[y], a.start[x], b.start[y]

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in _chunks(la * lb):
            reps = la[s] * lb[s]
            nth = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            wide = np.repeat(lb[s], reps)
            i, j = a.codes[np.repeat(sa[s], reps) + nth // wide], b.codes[np.repeat(sb[s], reps) + nth % wide]
            yield np.minimum(i, j), np.maximum(i, j)

    return _summed(parts())


def gram_triangle(a: ItemBlock) -> Tile:
    """The cells above the diagonal of the tile A'A."""
    entry = np.repeat(a.start - (np.cumsum(a.length) - a.length), a.length) + np.arange(int(a.length.sum()))
    behind = np.repeat(a.start + a.length, a.length) - entry - 1

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in _chunks(behind):
            reps = behind[s]
            left = np.repeat(entry[s], reps)
            yield a.codes[left], a.codes[left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)]

    return _summed(parts())


def gram_tiles(record: np.ndarray, codes: np.ndarray, side: np.ndarray, width: int) -> Iterator[Tile]:
    """The tiles of a record block. ``side`` is 3 for entries of a whole record, 1 and 2 for those of a pair of segments."""
    of = lambda s: item_blocks(record[side == s], codes[side == s], width)
    whole, left, right = of(3), of(1), of(2)
    for i, a in whole.items():
        yield gram_triangle(a)
        for j, b in whole.items():
            if i < j:
                yield transpose_product(a, b)
    for a in left.values():
        for b in right.values():
            yield transpose_product(a, b)


def gram_counts(entries: DataFrame, codes: int) -> DataFrame:
    """i, j, n of pairs of codes (i < j) over ``entries``: order_id, code BIGINT from 0 below ``codes`` (2**31 at most), each once.

    Records are spread by hash and taken in record blocks by their tasks. A record of more than SEGMENT entries is
    cut into segments by hash of the code, so that no record burdens one task with all its pairs; all take the same products.
    """
    ship(entries.sparkSession)
    width = max(WIDTH, -(-codes // MOST_BLOCKS))
    rows = entries.select("order_id", "code")
    large = small(cut(rows.groupBy("order_id").agg(F.count("*").alias("size")).where(F.col("size") > SEGMENT)))
    rows = rows.join(large, "order_id", "left").withColumn("parts", F.coalesce(F.ceil(F.col("size") / SEGMENT), F.lit(1)).cast("int"))
    own, other = F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"), F.col("t")
    rows = rows.withColumn("s", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("s") == other, 3).when(F.col("s") < other, 1).otherwise(2)
    rows = rows.select("order_id", F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v"), (F.col("code") * 4 + side).alias("entry"))
    records = rows.groupBy("order_id", "u", "v").agg(F.sort_array(F.collect_list("entry")).alias("entries")).where(F.size("entries") > 1).select("entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets = np.asarray(lists.offsets)
            flat, offsets = np.asarray(lists.values)[offsets[0] : offsets[-1]], offsets - offsets[0]
            at = 0
            while at < len(lists):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RECORD_BLOCK, "right")) - 1)
                part = flat[offsets[at] : offsets[to]]
                record = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
                tiles = list(zip(*gram_tiles(record, part >> 2, part & 3, width)))
                if tiles:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in tiles], ["i", "j", "n"])
                at = to

    return records.mapInArrow(run, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))


def dense_codes(items: DataFrame) -> DataFrame:
    """``items`` (item and further columns) with ``code``: its place in the order of the items, from 0."""
    # kept, so that the places are the same for all who read them
    rows = cut(items.repartitionByRange("item").sortWithinPartitions("item").withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"part": F.shiftright("at", 33), "nth": F.col("at").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("held")).select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))  # a row a partition
    return cut(rows.join(starts, "part").withColumn("code", F.col("start") + F.col("nth")).drop("part", "nth", "start", "at"))


def together(pairs: DataFrame, order_col: str = "order_id", item_col: str = "item", least: int = 1, lift: float = 0.0) -> DataFrame:
    """item_a, item_b, n_ab, n_a, n_b, n, lift of pairs of items with n_ab >= least and n_ab*n/(n_a*n_b) >= lift.

    ``pairs``: order and item, repeated rows count once, nulls are left out; n is the number of orders with an
    item. Items that no such pair can hold are left out beforehand, which changes no result: those in fewer than
    ``least`` baskets, and those in more than n/lift, as n_ab is at most the smaller of n_a and n_b. An empty
    table gives no rows. Of a pair, the smaller item is item_a.
    """
    rows = pairs.select(pairs[order_col].alias("order_id"), pairs[item_col].alias("item")).where("order_id is not null and item is not null").distinct()
    rows = cut(rows)
    n = rows.agg(F.count_distinct("order_id").alias("n"))  # one row
    marginals = rows.groupBy("item").agg(F.count("*").alias("n_item"))
    useful = marginals.where(F.col("n_item") >= least).crossJoin(n).where(F.col("n_item") * F.lit(float(lift)) <= F.col("n"))
    codes = dense_codes(useful)
    counted = gram_counts(rows.join(codes.select("item", "code"), "item").select("order_id", "code"), codes.count()).where(F.col("n") >= least)
    a = codes.select(F.col("code").alias("i"), F.col("item").alias("one"), F.col("n_item").alias("n_one"))
    b = codes.select(F.col("code").alias("j"), F.col("item").alias("two"), F.col("n_item").alias("n_two"), F.col("n").alias("n_all"))
    out = counted.join(a, "i").join(b, "j")
    ratio = F.col("n").cast("double") * F.col("n_all") / (F.col("n_one").cast("double") * F.col("n_two"))
    return out.select(
        F.least("one", "two").alias("item_a"),
        F.greatest("one", "two").alias("item_b"),
        F.col("n").alias("n_ab"),
        F.when(F.col("one") < F.col("two"), F.col("n_one")).otherwise(F.col("n_two")).alias("n_a"),
        F.when(F.col("one") < F.col("two"), F.col("n_two")).otherwise(F.col("n_one")).alias("n_b"),
        F.col("n_all").alias("n"),
        ratio.alias("lift"),
    ).where(F.col("lift") >= lift)
