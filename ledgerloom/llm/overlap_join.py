"""All similar pairs between set-valued records: a size-aware overlap join.

Two sets of sizes s <= t with Jaccard similarity at or above the threshold share at
least o(s, t) values. Small sets enumerate their subsets of that size: for each pair of
sizes, a shared subset already proves the pair, so the join yields results and no mere
candidates. Large sets have too many subsets; they scan the inverted lists of their
rarest values. Both ways are joined, checked exactly and expanded from distinct sets
to records.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small

#: Sets up to this size enumerate subsets, if their subsets leave out at most LEFT_OUT values.
SMALL, LEFT_OUT = 14, 2
#: Rows of a key that one task takes: the inverted list of a value, a subset or the records of a class with more are split into parts.
HOT = 20_000
#: Members of a class that one tile of pairs takes on a side; share of the sets on which hot subsets are looked for.
MEMBERS, SAMPLED = 1024, 1 / 64


def overlap_needed(s: int, t: int, threshold: Fraction) -> int:
    """Least number of shared values of sets of sizes s and t at the threshold."""
    return math.ceil(threshold * (s + t) / (1 + threshold))


def size_pairs(small: int, threshold: Fraction, left_out: int = LEFT_OUT) -> list[tuple[int, int, int]]:
    """(s, t, o) of all pairs of sizes that small sets can find by subsets."""
    out = []
    for s in range(1, small + 1):
        for t in range(s, small + 1):
            o = overlap_needed(s, t, threshold)
            if o <= s and t - o <= left_out:
                out.append((s, t, o))
    return out


def _subsets(left_out: int) -> Column:
    """Hashes of the subsets of column ``hs`` (hashes of the values) that leave out so many; ``x`` is the XOR of all."""
    hs, x = F.col("hs"), F.col("x")
    if left_out == 0:
        return F.array(x)
    if left_out == 1:
        return F.transform(hs, lambda h: x.bitwiseXOR(h))
    if left_out == 2:
        return F.flatten(F.transform(hs, lambda h, i: F.transform(F.slice(hs, i + 2, F.size(hs)), lambda g: x.bitwiseXOR(h).bitwiseXOR(g))))
    raise ValueError("subsets leave out two values at most")


def _by_subsets(sets: DataFrame, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs (set_a, set_b) of small distinct sets that share a subset of the size their pair needs."""
    sets = sets.withColumn("hs", F.transform("items", lambda v: F.xxhash64(v))).withColumn("x", F.aggregate("hs", F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(h)))

    # a key is the hash of a subset mixed with a number for its role, the pair of sizes; odd ones are of equal sizes
    numbers = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, len(pairs)) * 2
    role = {(s, t): int(r) + (s == t) for (s, t, _), r in zip(pairs, numbers)}

    def in_roles(subsets: Column, roles: list[int]) -> Column:
        return F.flatten(F.transform(subsets, lambda h: F.array(*[h.bitwiseAND(-2).bitwiseXOR(F.lit(r)) for r in roles])))

    def keyed(sets: DataFrame, side: int) -> DataFrame:
        """Keys of the subsets of each set in its roles: as the smaller set (side 0) or the larger one (side 1) of a pair of sizes."""
        by_size: dict[int, dict[int, list[int]]] = {}
        for s, t, o in pairs:
            own = (s, t)[side]
            by_size.setdefault(own, {}).setdefault(own - o, []).append(role[s, t])
        keys = F.array().cast("array<bigint>")
        for own, outs in by_size.items():
            parts = [in_roles(_subsets(k), roles) for k, roles in outs.items()]
            keys = F.when(F.col("n") == own, parts[0] if len(parts) == 1 else F.concat(*parts)).otherwise(keys)
        return sets.select("set_id", F.explode(keys).alias("key"))

    # subsets of very many sets show in a sample; their sets are spread over several tasks, which changes no result
    some = sets.where(F.shiftrightunsigned(F.xxhash64("set_id", F.lit("hot")), 12) / F.lit(float(1 << 52)) < SAMPLED)
    seen = keyed(some, 0).unionByName(keyed(some, 1)).groupBy("key").agg(F.count("*").alias("seen")).where(F.col("seen") > HOT * SAMPLED)
    hot = cut(seen.select("key", F.ceil(F.col("seen") / (HOT * SAMPLED)).cast("int").alias("parts")))
    a, b, by = keyed(sets, 0).withColumnRenamed("set_id", "a"), keyed(sets, 1).withColumnRenamed("set_id", "b"), ["key"]
    if not hot.isEmpty():
        hot, by, parts = small(hot), ["key", "part"], F.coalesce("parts", F.lit(1))
        a = a.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts")
        b = b.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    once = (F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & (F.col("key").bitwiseAND(1) == 0))
    return a.join(b, by).where(once).select(F.least("a", "b").alias("set_a"), F.greatest("a", "b").alias("set_b"))


def _by_lists(sets: DataFrame, threshold: Fraction, covered: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs that subsets don't cover, from inverted lists over the rarest values of each set.

    With the values of a set in order of rarity, a pair shares one of the first
    n - ceil(threshold * n) + 1 of each. A list longer than HOT is read in slices of that length by several tasks.
    """
    most = max((t for _, t, _ in covered), default=0)
    done = {(s, t) for s, t, _ in covered}
    # sets that can be in a pair of sizes that isn't covered
    open_sizes = [s for t in range(1, most + 1) for s in range(math.ceil(threshold * t), t + 1) if (s, t) not in done]
    reach = min([math.ceil(threshold * (most + 1)), *open_sizes])
    large = sets.where(F.col("n") >= reach)
    frequency = large.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df"))
    values = large.select("set_id", "n", F.explode("items").alias("item")).join(frequency, "item")
    ranked = values.groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("ranked"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(float(threshold)) - 1e-9).cast("int") + 1
    listed = ranked.select("set_id", "n", F.posexplode(F.slice("ranked", 1, first)).alias("pos", "r")).select("set_id", "n", "pos", F.col("r.item").alias("item"), F.col("r.df").alias("df"))
    # the larger set scans, the smaller one is listed; long lists are cut into slices that each scanner visits
    slices = F.ceil(F.col("df") / HOT).cast("int")
    scan = listed.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select("item", "slice", F.col("set_id").alias("b"), F.col("n").alias("t"), F.col("pos").alias("pb"))
    lists = listed.withColumn("slice", F.pmod(F.xxhash64("set_id"), slices).cast("int")).select("item", "slice", F.col("set_id").alias("a"), F.col("n").alias("s"), F.col("pos").alias("pa"))
    th = F.lit(float(threshold))
    need = F.ceil(th * (F.col("s") + F.col("t")) / (1 + th) - 1e-9)
    known = F.array(*[F.lit(s * 1000 + t) for s, t, _ in covered])
    ok = (F.col("s") >= F.col("t") * th - 1e-9) & ((F.col("s") < F.col("t")) | ((F.col("s") == F.col("t")) & (F.col("a") < F.col("b"))))
    ok &= F.least(F.col("s") - F.col("pa"), F.col("t") - F.col("pb")) >= need  # the shared values can only stand from here on
    if covered:
        ok &= (F.col("t") > most) | ~F.array_contains(known, F.col("s") * 1000 + F.col("t"))
    found = lists.join(scan, ["item", "slice"]).where(ok)
    return found.select(F.least("a", "b").alias("set_a"), F.greatest("a", "b").alias("set_b"))


def similar_sets(records: DataFrame, id_col: str, items_col: str, threshold: float = 0.8, least: int = 1, small_sets: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(classes: set_id, id, n; links: set_a, set_b, shared, similarity) of the distinct sets.

    ``items_col``: arrays of distinct strings; null sets, null values and sets of fewer than ``least``
    values are left out, repeated values and rows count once. Records with equal sets are one class, so
    copies don't multiply the work; links are between different sets only and lose none. Empty tables
    give no rows. The threshold is above 0.5 and at most 1, compared as an exact fraction.
    """
    th = Fraction(str(threshold))
    if not Fraction(1, 2) < th <= 1:
        raise ValueError("the threshold must be above 0.5 and at most 1")
    rows = records.select(records[id_col].alias("id"), F.array_sort(F.array_distinct(F.array_compact(records[items_col]))).alias("items")).where("id is not null and items is not null")
    rows = rows.withColumn("n", F.size("items")).where(F.col("n") >= max(least, 1))
    rows = cut(rows)
    # the number of a distinct set; kept, so that all who read it see the same
    sets = cut(rows.select("items", "n").distinct().withColumn("set_id", F.monotonically_increasing_id()))
    classes = rows.join(sets.select("items", "set_id"), "items").select("set_id", "id", "n").distinct()
    pairs = size_pairs(small_sets, th)
    found = _by_lists(sets, th, pairs)
    if pairs:
        found = found.unionByName(_by_subsets(sets.where(F.col("n") <= small_sets), pairs))
    found = small(cut(found.distinct()))
    a = sets.select(F.col("set_id").alias("set_a"), F.col("items").alias("items_a"))
    b = sets.select(F.col("set_id").alias("set_b"), F.col("items").alias("items_b"))
    shared = F.size(F.array_intersect("items_a", "items_b"))
    either = F.size("items_a") + F.size("items_b") - shared
    checked = found.join(a, "set_a").join(b, "set_b").select("set_a", "set_b", shared.alias("shared"), either.alias("either"))
    links = checked.where(F.col("shared") * th.denominator >= F.col("either") * th.numerator).select("set_a", "set_b", "shared", (F.col("shared") / F.col("either")).alias("similarity"))
    return classes, links


def similar_pairs(records: DataFrame, id_col: str, items_col: str, threshold: float = 0.8, least: int = 1, small_sets: int = SMALL) -> DataFrame:
    """id_a, id_b, similarity: each pair of different records once, the smaller id first.

    Expands :func:`similar_sets`: pairs of linked classes, and pairs of copies, whose number is
    that of the result.
    """
    classes, links = similar_sets(records, id_col, items_col, threshold, least, small_sets)
    ids = _chunks(classes.select("set_id", "id"))
    pairs = _expanded(small(cut(links.select("set_a", "set_b", "similarity"))), ids, ids).unionByName(_copies(ids))
    return pairs.select(F.least("one", "two").alias("id_a"), F.greatest("one", "two").alias("id_b"), "similarity")


def _chunks(members: DataFrame) -> DataFrame:
    """set_id, chunk, ids: the members (set_id, id) of each class in chunks of about MEMBERS; kept, a row a chunk."""
    large = cut(members.groupBy("set_id").agg(F.count("*").alias("size")).where(F.col("size") > MEMBERS))
    spread = members.withColumn("chunk", F.lit(0))
    if not large.isEmpty():
        parts = F.coalesce(F.ceil(F.col("size") / MEMBERS), F.lit(1))
        spread = members.join(small(large), "set_id", "left").withColumn("chunk", F.pmod(F.xxhash64("id"), parts).cast("int"))
    return cut(spread.groupBy("set_id", "chunk").agg(F.collect_list("id").alias("ids")))


def _expanded(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """one, two, similarity: the members of the linked classes (set_a, set_b), each pair of chunks by a task of its own."""
    a = left.select(F.col("set_id").alias("set_a"), F.col("chunk").alias("chunk_a"), F.col("ids").alias("ids_a"))
    b = right.select(F.col("set_id").alias("set_b"), F.col("chunk").alias("chunk_b"), F.col("ids").alias("ids_b"))
    tiles = links.join(a, "set_a").join(b, "set_b").repartition("set_a", "chunk_a", "set_b", "chunk_b")
    return tiles.select(F.explode("ids_a").alias("one"), "ids_b", "similarity").select("one", F.explode("ids_b").alias("two"), "similarity")


def _copies(ids: DataFrame) -> DataFrame:
    """one, two, similarity: pairs within the classes."""
    several = ids.where((F.size("ids") > 1) | (F.col("chunk") > 0))
    links = several.select(F.col("set_id").alias("set_a")).distinct().select("set_a", F.col("set_a").alias("set_b"), F.lit(1.0).alias("similarity"))
    return _expanded(links, ids, ids).where("one < two")


def similar_pairs_between(left: DataFrame, right: DataFrame, id_col: str, items_col: str, threshold: float = 0.8, least: int = 1, small_sets: int = SMALL) -> DataFrame:
    """left_id, right_id, similarity: the similar pairs between two tables (same conventions)."""
    tag = lambda df, side: df.select(F.struct(F.lit(side).alias("side"), df[id_col].cast("string").alias("key")).alias("id"), df[items_col].alias("items"))
    classes, links = similar_sets(tag(left, 0).unionByName(tag(right, 1)), "id", "items", threshold, least, small_sets)
    a = _chunks(classes.where("id.side = 0").select("set_id", F.col("id.key").alias("id")))
    b = _chunks(classes.where("id.side = 1").select("set_id", F.col("id.key").alias("id")))
    pairs = links.select("set_a", "set_b", "similarity")
    both = pairs.unionByName(pairs.select(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b"), "similarity"))
    same = a.select(F.col("set_id").alias("set_a")).distinct().select("set_a", F.col("set_a").alias("set_b"), F.lit(1.0).alias("similarity"))
    return _expanded(both.unionByName(same), a, b).select(F.col("one").alias("left_id"), F.col("two").alias("right_id"), "similarity")
