"""Overlap join, term bitmaps, heavy items and pair counts against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from ledgerloom.llm import heavy_items, overlap_join, pair_counts, term_index
from ledgerloom.llm.baskets import basket_items, baskets

CLASH = "item string, n int, set_id int, x string, h string"


def sets_frame(spark, sets):
    return spark.createDataFrame([(k, v, 1) for k, v in sets], "id string, items array<string>, n int")


def random_sets(seed, count, sizes, vocabulary, noise=2):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out, base = [], []
    for i in range(count):
        if base and rnd.random() < 0.6:
            s = set(rnd.choice(base))
            for _ in range(rnd.randint(0, noise)):
                s.discard(rnd.choice(sorted(s))) if s and rnd.random() < 0.5 else s.add(rnd.choice(words))
        else:
            s = {min(words[int(rnd.paretovariate(0.7)) % vocabulary], words[rnd.randrange(vocabulary)]) for _ in range(rnd.randint(*sizes))}
        base.append(s)
        out.append((f"o{i:04d}", sorted(s)))
    return out


def brute_pairs(sets, threshold, least):
    out = {}
    for (a, x), (b, y) in combinations(sorted((k, set(v)) for k, v in sets), 2):
        if len(x) >= least and len(y) >= least and len(x & y) / len(x | y) >= threshold - 1e-12:
            out[a, b] = len(x & y) / len(x | y)
    return out


@pytest.mark.parametrize("threshold,sizes,least", [(0.8, (1, 12), 5), (0.8, (8, 40), 1), (0.6, (1, 10), 1), (0.95, (5, 60), 1), (1.0, (1, 9), 1)])
def test_pairs_match_brute_force(spark, threshold, sizes, least):
    sets = random_sets(int(threshold * 100) + sizes[1], 160, sizes, 60)
    got = {(r.id_a, r.id_b): r.similarity for r in overlap_join.similar_pairs(sets_frame(spark, sets), "id", "items", threshold, least).collect()}
    want = brute_pairs(sets, threshold, least)
    assert got == pytest.approx(want) and want


def test_hot_lists_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(overlap_join, "HOT", 5)
    monkeypatch.setattr(overlap_join, "SAMPLED", 0.9)
    sets = random_sets(9, 120, (10, 30), 30) + [(f"s{i:03d}", ["a", "b", "c", "d", f"x{i}"]) for i in range(40)]
    got = {(r.id_a, r.id_b) for r in overlap_join.similar_pairs(sets_frame(spark, sets), "id", "items", 0.7, 1).collect()}
    assert got == set(brute_pairs(sets, 0.7, 1))


@pytest.mark.parametrize("members", [1024, 7])
def test_copies_are_one_class(spark, monkeypatch, members):
    monkeypatch.setattr(overlap_join, "MEMBERS", members)
    sets = [(f"c{i:03d}", ["a", "b", "c", "d", "e"]) for i in range(60)] + [("z", ["a", "b", "c", "d", "e", "f"])]
    df = sets_frame(spark, sets)
    classes, links = overlap_join.similar_sets(df, "id", "items", 0.8)
    assert classes.select("set_id").distinct().count() == 2 and links.count() == 1
    assert overlap_join.similar_pairs(df, "id", "items", 0.8).count() == 61 * 60 // 2


def test_set_edge_cases(spark):
    sets = [("a", ["x", "y", "y", None]), ("a", ["x", "y"]), ("b", ["y", "x"]), ("c", []), ("d", None), ("e", [None]), (None, ["x", "y"]), ("f", ["", "x"]), ("g", ["x", ""])]
    got = {(r.id_a, r.id_b) for r in overlap_join.similar_pairs(sets_frame(spark, sets), "id", "items").collect()}
    assert got == {("a", "b"), ("f", "g")}
    assert overlap_join.similar_pairs(sets_frame(spark, sets).limit(0), "id", "items").count() == 0
    with pytest.raises(ValueError):
        overlap_join.similar_pairs(sets_frame(spark, sets), "id", "items", 0.4)


def test_between_two_tables(spark):
    left, right = sets_frame(spark, random_sets(1, 80, (3, 9), 20)), sets_frame(spark, random_sets(2, 80, (3, 9), 20))
    got = {(r.left_id, r.right_id) for r in overlap_join.similar_pairs_between(left, right, "id", "items", 0.7).collect()}
    rows = lambda df: [(r.id, set(r["items"])) for r in df.collect()]
    want = {(a, b) for a, x in rows(left) for b, y in rows(right) if x | y and len(x & y) / len(x | y) >= 0.7 - 1e-12}
    assert got == want and want


def lines_frame(spark, rows):
    return spark.createDataFrame([(o, i, "x") for o, i in rows], "order_id string, item_id string, item string")


def random_lines(seed, orders=200, items=60, size=(1, 9)):
    rnd = random.Random(seed)
    rows = []
    for o in range(orders):
        for _ in range(rnd.randint(*size)):
            rows.append((f"o{o}", f"I{min(int(rnd.paretovariate(0.8)), items)}"))
    return rows + rows[:20]


def test_baskets(spark):
    rows = [("1", " a\t"), ("1", "A"), ("1", "b"), ("2", ""), ("2", " \t "), ("3", None), (None, "a"), ("4", "é ")]
    got = {r.order_id: r["items"] for r in baskets(lines_frame(spark, rows)).collect()}
    assert got == {"1": ["A", "B"], "4": ["É"]}
    assert basket_items(lines_frame(spark, rows)).count() == 3


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4096, 4097, 65536):
        a = np.sort(rng.choice(65536, n, replace=False))
        packed = term_index.pack(a)
        assert np.array_equal(term_index.unpack(packed), a) and term_index.cardinality(packed) == n and len(packed) <= 8193
    a, b = np.arange(0, 9000, 2), np.arange(0, 9000, 3)
    joined = term_index.union([term_index.pack(a), term_index.pack(b)])
    assert term_index.cardinality(joined) == len(set(a) | set(b))


def test_term_frequencies(spark, monkeypatch):
    rows = random_lines(3) + [(None, "I1"), (None, "LONE"), ("o1", None)]
    df = spark.createDataFrame([(o, i, 1, 2) for o, i in rows], "order_id string, item string, n int, term int")
    for size in (term_index.ROWS, 50):
        monkeypatch.setattr(term_index, "ROWS", size)
        got = {r.term: (r.occurrences, r.n_records, r.mark) for r in term_index.keyed_term_frequencies(df, "order_id", "item").collect()}
        records = {o for o, i in rows if o and i}
        want = {}
        for item in {i for _, i in rows if i}:
            held = len({o for o, i in rows if i == item and o})
            want[item] = (sum(i == item for _, i in rows), held, "rare" if 1 <= held < 3 else "common" if held > 0.2 * len(records) else "")
        assert got == want
    assert term_index.keyed_term_frequencies(df.limit(0), "order_id", "item").count() == 0


def test_bitmaps_merge_over_chunks(spark):
    n = 200_000
    df = spark.range(n).selectExpr("id record", "case when id % 3 = 0 then 'three' else 'other' end term", "cast(2 as bigint) occurrences").repartition(7)
    maps = term_index.term_bitmaps(df.unionByName(df))
    assert maps.groupBy("term").count().where("count > 4").count() == 0
    got = {r.term: (r.o, r.c) for r in maps.groupBy("term").agg({"occurrences": "sum", "cardinality": "sum"}).toDF("term", "o", "c").collect()}
    three = len(range(0, n, 3))
    assert got == {"three": (4 * three, three), "other": (4 * (n - three), n - three)}


def test_words(spark):
    rows = [(0, "Blue-box 2x blue"), (70_000, "BOX"), (2, ""), (3, None), (4, "…"), (None, "box"), (5, "naïve")]
    df = spark.createDataFrame(rows, "item_index bigint, item_name string")
    got = {r.term: (r.occurrences, r.n_records, r.mark) for r in term_index.text_term_frequencies(df, "item_index", "item_name", rare_below=2, common_above=0.4).collect()}
    assert got == {"blue": (2, 1, "rare"), "box": (2, 2, "common"), "2x": (1, 1, "rare"), "na": (1, 1, "rare"), "ve": (1, 1, "rare")}


@pytest.mark.parametrize("buckets,entries,counters", [(64, 4, 1024), (4, 2, 16), (1, 8, 1)])
def test_top_items_are_exact(spark, buckets, entries, counters):
    """Also where the sketch is far too small to hold them."""
    rnd = random.Random(buckets)
    items = [f"i{min(int(rnd.paretovariate(0.6)), 3000)}" for _ in range(20_000)] + [f"once{i}" for i in range(3000)]
    rnd.shuffle(items)
    df = spark.createDataFrame([(i, 1, 2) for i in [*items, None]], "v string, n int, slot int").repartition(5)
    got = heavy_items.most_frequent(df, "v", 8, buckets, entries, counters).collect()
    want = sorted(Counter(items).items(), key=lambda x: (-x[1], x[0]))[:8]
    assert [(r.item, r.n) for r in got] == want
    assert all((r.low or 0) <= r.n <= r.high for r in got)


def test_sketch_bounds(spark):
    rnd = random.Random(8)
    items = [f"i{min(int(rnd.paretovariate(0.7)), 5000)}" for _ in range(30_000)]
    truth = Counter(items)
    df = spark.createDataFrame([(i,) for i in items], "v string").repartition(6)
    heavy, light = heavy_items.heavy_light(df, "v", 32, 4, 256)
    rows = heavy_items.bounds(heavy, light, 256).collect()
    assert rows and len(rows) <= 128 and all(r.low <= truth[r.item] <= r.high for r in rows)
    total = sum(r.n for r in heavy.collect()) + sum(r.n for r in light.collect())
    assert total == len(items) and light.count() <= 256


def test_sketch_counts_nothing_twice(monkeypatch):
    """Blocks that fit, evict and collide: entries are lower bounds, nothing is lost."""
    rnd, truth = random.Random(4), Counter()
    sketch = heavy_items.Sketch(3, 2, 8)
    for block in range(60):
        some = Counter(f"i{min(int(rnd.paretovariate(0.5)), 60) + block // 20}" for _ in range(80))
        truth.update(some)
        items = np.array(list(some), object)
        hashes = np.array([hash(i) % 13 for i in items])  # also equal hashes of different items
        sketch.add(items, hashes, np.array(list(some.values())))
        held = {i: n for i, n in zip(sketch.item.ravel(), sketch.count.ravel()) if i is not None}
        assert all(n <= truth[i] for i, n in held.items())
        assert sum(held.values()) + sketch.light.sum() == sum(truth.values())


def test_top_items_edge_cases(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",), (None,)], "v string")
    assert [(r.item, r.n) for r in heavy_items.most_frequent(df, "v", 2).collect()] == [("a", 2), ("b", 2)]
    assert heavy_items.most_frequent(df, "v", 50).count() == 3
    assert heavy_items.most_frequent(df.limit(0), "v", 5).count() == 0


def brute_together(rows, least, lift):
    sets = {}
    for o, i in rows:
        if o and i:
            sets.setdefault(o, set()).add(i)
    single, pair = Counter(i for s in sets.values() for i in s), Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    n = len(sets)
    return {p: c for p, c in pair.items() if c >= least and c * n / (single[p[0]] * single[p[1]]) >= lift}


@pytest.mark.parametrize("segment,expanded,least,lift", [(2048, 4_000_000, 1, 0.0), (3, 4_000_000, 2, 0.0), (5, 7, 2, 1.2), (2048, 10, 3, 0.9)])
def test_pair_counts(spark, monkeypatch, segment, expanded, least, lift):
    monkeypatch.setattr(pair_counts, "SEGMENT", segment)
    monkeypatch.setattr(pair_counts, "EXPANDED", expanded)
    monkeypatch.setattr(pair_counts, "RECORD_BLOCK", 40)
    monkeypatch.setattr(pair_counts, "WIDTH", 7)
    rows = random_lines(6) + [(None, "I1"), ("o1", None)]
    df = spark.createDataFrame([(o, i, 1, 2) for o, i in rows], "order_id string, item string, code int, n int")
    got = {(r.item_a, r.item_b): r.n_ab for r in pair_counts.together(df, "order_id", "item", least, lift).collect()}
    assert got == brute_together(rows, least, lift) and got
    assert pair_counts.together(df.limit(0), "order_id", "item").count() == 0


def test_gram_of_ordinary_records(monkeypatch):
    """Records of a few items go through the products of item blocks, which give the Gram matrix."""
    monkeypatch.setattr(pair_counts, "EXPANDED", 50)
    rng = np.random.default_rng(3)
    x = rng.random((70, 30)) < 0.15
    record, codes = np.nonzero(x)
    calls = Counter()
    for name in ("transpose_product", "gram_triangle"):
        monkeypatch.setattr(pair_counts, name, lambda *a, f=getattr(pair_counts, name), n=name: (calls.update([n]), f(*a))[1])
    got = np.zeros((30, 30), int)
    for i, j, n in pair_counts.gram_tiles(record, codes, np.full(len(codes), 3), 8):
        assert len(set(zip(i.tolist(), j.tolist()))) == len(i)
        np.add.at(got, (i, j), n)
    assert np.array_equal(got, np.triu(x.astype(int).T @ x.astype(int), 1))
    assert calls == {"gram_triangle": 4, "transpose_product": 6}
    # a record in two halves: all pairs across them, none within
    side = np.where(codes < 11, 1, 2)
    got = np.zeros((30, 30), int)
    for i, j, n in pair_counts.gram_tiles(record, codes, side, 8):
        np.add.at(got, (i, j), n)
    want = np.triu(x.astype(int).T @ x.astype(int), 1)
    want[:11, :11] = want[11:, 11:] = 0
    assert np.array_equal(got, want)
    assert list(pair_counts.gram_tiles(record[:0], codes[:0], side[:0], 8)) == []


def test_dense_codes(spark):
    items = spark.createDataFrame([(f"i{k:04d}", k) for k in range(500)], "item string, more int").repartition(9)
    got = {r.item: r.code for r in pair_counts.dense_codes(items).collect()}
    assert got == {f"i{k:04d}": k for k in range(500)}
