"""Most frequent items in bounded memory: a heavy-light split.

Each partition keeps a fixed number of buckets with a few entries each. Items vote:
an entry whose item is outvoted is evicted, and its count falls into a compact array of
counters, the light part. Partitions merge bucket by bucket: entries of one item add up,
a bucket keeps its largest, the rest falls into the light part. An entry's count is a
lower bound of its item's frequency, and with the item's light counter an upper one.

The exact top-k then takes one more pass over only the rows whose upper bound reaches
the k-th lower bound; no item of the true top-k is below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship

#: Buckets, entries of a bucket, light counters, votes against one that evict. Memory is fixed by these alone.
BUCKETS, ENTRIES, COUNTERS, VOTES = 2048, 4, 1 << 16, 8
#: Rows that a task counts before they vote; most sketches that are merged, a core.
ROWS, SKETCHES = 200_000, 4


class Sketch:
    """The heavy-light sketch of one partition: buckets as arrays of entries (hash, item, count), votes against each, light counters."""

    def __init__(self, buckets: int, entries: int, counters: int):
        self.hash = np.full((buckets, entries), -1, np.int64)
        self.item = np.full((buckets, entries), None, object)
        self.count = np.zeros((buckets, entries), np.int64)
        self.against, self.light = np.zeros(buckets, np.int64), np.zeros(counters, np.int64)

    def add(self, items: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Occurrences of distinct items (with hashes of 63 bits), all buckets at once."""
        bucket = hashes % len(self.hash)
        same = (self.hash[bucket] == hashes[:, None]) & (self.item[bucket] == items[:, None])
        row, entry = np.nonzero(same)
        self.count[bucket[row], entry] += counts[row]
        # those that no entry holds, by bucket, the largest first
        rest = np.nonzero(~same.any(1))[0]
        rest = rest[np.lexsort((hashes[rest], -counts[rest], bucket[rest]))]
        if not len(rest):
            return
        b = bucket[rest]
        first = np.r_[0, np.nonzero(np.diff(b))[0] + 1]
        nth = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)]))
        free = (self.hash < 0).sum(1)  # free entries are the last of their bucket
        taken = nth < free[b]
        self._put(b[taken], self.hash.shape[1] - free[b[taken]] + nth[taken], rest[taken], items, hashes, counts)
        b, rest, nth = b[~taken], rest[~taken], (nth - free[b])[~taken]
        # the others vote against their bucket; the largest takes the place of the weakest entry that is outvoted
        np.add.at(self.against, b, counts[rest])
        best = nth == 0
        weakest = self.count[b].argmin(1)
        out = best & (self.against[b] >= VOTES * self.count[b, weakest])
        e, w = b[out], weakest[out]
        np.add.at(self.light, self._slot(self.hash[e, w]), self.count[e, w])
        self._put(e, w, rest[out], items, hashes, counts)
        self.against[e] = 0
        np.add.at(self.light, self._slot(hashes[rest[~out]]), counts[rest[~out]])

    def _put(self, bucket: np.ndarray, entry: np.ndarray, rows: np.ndarray, items: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hash[bucket, entry], self.item[bucket, entry], self.count[bucket, entry] = hashes[rows], items[rows], counts[rows]

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> 20) % len(self.light)


_PARTS = "kind int, slot int, item string, n bigint"


def heavy_light(rows: DataFrame, item_col: str, buckets: int = BUCKETS, entries: int = ENTRIES, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(heavy: bucket, item, n; light: slot, n), merged over all partitions; null items are left out.

    The count of an item is at least its n and at most n plus the light counter of its slot; an item that is not
    in heavy has at most the light counter. The tables hold at most buckets * entries and counters rows.
    """
    ship(rows.sparkSession)
    # buckets take the low bits of the hash, light slots the bits from the 20th on
    hashed = rows.select(rows[item_col].cast("string").alias("item")).where("item is not null").select("item", F.shiftrightunsigned(F.xxhash64("item"), 1).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, n = Sketch(buckets, entries, counters), [], 0

        def vote() -> None:
            t = pa.Table.from_batches(held).group_by(["item", "h"]).aggregate([([], "count_all")])
            sketch.add(t["item"].to_numpy(), t["h"].to_numpy(), t["count_all"].to_numpy())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS:
                vote()
                held, n = [], 0
        if held:
            vote()
        bucket, entry = np.nonzero(sketch.hash >= 0)
        slots = np.nonzero(sketch.light)[0]
        kind = pa.array(np.r_[np.zeros(len(bucket), np.int32), np.ones(len(slots), np.int32)])
        item = pa.array([*sketch.item[bucket, entry], *[None] * len(slots)], pa.string())
        yield pa.RecordBatch.from_arrays([kind, pa.array(np.r_[bucket, slots].astype(np.int32)), item, pa.array(np.r_[sketch.count[bucket, entry], sketch.light[slots]])], ["kind", "slot", "item", "n"])

    # some sketches a core, however many splits the rows have
    hashed = hashed.coalesce(SKETCHES * rows.sparkSession.sparkContext.defaultParallelism)
    parts = cut(hashed.mapInArrow(run, _PARTS).groupBy("kind", "slot", "item").agg(F.sum("n").alias("n")))
    best = Window.partitionBy("slot").orderBy(F.desc("n"), "item")
    ranked = parts.where("kind = 0").withColumn("nth", F.row_number().over(best))
    heavy = ranked.where(F.col("nth") <= entries).select(F.col("slot").alias("bucket"), "item", "n")
    fallen = ranked.where(F.col("nth") > entries).select(slot_of(F.col("item"), counters).alias("slot"), "n")
    light = parts.where("kind = 1").select("slot", "n").unionByName(fallen).groupBy("slot").agg(F.sum("n").alias("n"))
    return heavy, light


def slot_of(item, counters: int = COUNTERS):
    """Light slot of an item column."""
    return (F.shiftrightunsigned(F.xxhash64(item), 21) % counters).cast("int")


def bounds(heavy: DataFrame, light: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """item, low, high: bounds of the count of each heavy item."""
    h = heavy.withColumn("slot", slot_of(F.col("item"), counters)).join(light.select("slot", F.col("n").alias("more")), "slot", "left")
    return h.select("item", F.col("n").alias("low"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("high"))


def most_frequent(rows: DataFrame, item_col: str, k: int = 50, buckets: int = BUCKETS, entries: int = ENTRIES, counters: int = COUNTERS) -> DataFrame:
    """item, n, low, high of the k most frequent items, with exact counts n and the sketch's bounds.

    Of equal counts the smaller item comes first; null items are left out; with fewer than k items all come out.
    low is null for an item that the sketch didn't hold. Needs k of at most buckets * entries.
    """
    heavy, light = heavy_light(rows, item_col, buckets, entries, counters)
    heavy, light = cut(heavy), cut(light)
    known = cut(bounds(heavy, light, counters))
    # the k-th lower bound: some k items have at least that many rows, so has every item of the true top-k
    kth = known.orderBy(F.desc("low")).limit(k).agg(F.when(F.count("*") >= k, F.min("low")).otherwise(F.lit(0)).alias("least"))
    kth = kth.select(F.greatest("least", F.lit(1)).alias("least"))
    named = known.crossJoin(kth).where("high >= least").select("item")  # at most buckets * entries rows
    slots = light.crossJoin(kth).where("n >= least").select("slot")  # at most COUNTERS rows
    items = rows.select(rows[item_col].cast("string").alias("item")).where("item is not null").withColumn("slot", slot_of(F.col("item"), counters))
    by_name = items.join(F.broadcast(named), "item", "left_semi")
    # items that no bucket holds, in slots heavy enough to hide one of the top-k
    by_slot = items.join(F.broadcast(slots), "slot", "left_semi").join(F.broadcast(heavy.select("item")), "item", "left_anti")
    counted = by_name.select("item").unionByName(by_slot.select("item")).groupBy("item").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "item").limit(k)
    return top.join(known, "item", "left").select("item", "n", "low", F.coalesce("high", "n").alias("high")).orderBy(F.desc("n"), "item")
