"""Golden values and edge cases of the core operators."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom import api
from ledgerloom.errors import AnalysisError, ArrowError, ModelError, ValidationError, split_error
from ledgerloom.operators import clustering, forecast, iforest, itemsets, knn
from ledgerloom.operators.scaling import normalize_scores, scale
from ledgerloom.operators.validate import validate_features, validate_threshold
from ledgerloom.sources.arrow_ipc import read_features, read_forecast_batch, read_ipc, read_transactions, to_ipc
from ledgerloom.types import PredictionMode, ScalingMethod


def frame(spark, *columns, names=None):
    rows = [(f"o{i}", *map(float, r)) for i, r in enumerate(zip(*columns))]
    names = names or [f"f{i}" for i in range(len(columns))]
    return spark.createDataFrame(rows, "order_id string, " + ", ".join(f"{n} double" for n in names))


def column(df, name):
    return [r[name] for r in df.orderBy("order_id").collect()]


@pytest.mark.parametrize("values,minmax,standard", [([0, 5, 10], [0, 0.5, 1], None), ([5, 5, 5], [0, 0, 0], [0, 0, 0]), ([-10, 0, 10], [0, 0.5, 1], [-1.224744871, 0, 1.224744871])])
def test_scaling(spark, values, minmax, standard):
    df = frame(spark, values)
    assert column(scale(df, ["f0"], ScalingMethod.MIN_MAX), "f0") == pytest.approx(minmax, abs=1e-10)
    got = column(scale(df, ["f0"], 2), "f0")
    assert np.mean(got) == pytest.approx(0, abs=1e-9)
    if standard:
        assert got == pytest.approx(standard, abs=1e-9)
    assert column(scale(df, ["f0"], 9), "f0") == list(map(float, values))


@pytest.mark.parametrize("values,want", [([1, 2, 3, 4, 5], [0, 0.25, 0.5, 0.75, 1]), ([3, 3, 3], [0, 0, 0]), ([5], [0]), ([], [])])
def test_normalize(spark, values, want):
    assert column(normalize_scores(frame(spark, values), "f0"), "f0") == pytest.approx(want)


def test_scaling_by_group_and_names(spark):
    df = spark.createDataFrame([("a", 1.0, 9), ("a", 3.0, 9), ("b", 7.0, 9), (None, 2.0, 9)], "k string, v double, __by int")
    got = {(r.k, r.v) for r in scale(df.drop("__by"), ["v"], 1, by="k").collect()}
    assert got == {("a", 0.0), ("a", 1.0), ("b", 0.0), (None, 0.0)}


def series(spark, y):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t int, y double")


SINE = [math.sin(2 * math.pi * i / 4) for i in range(8)]


@pytest.mark.parametrize(
    "y,mode,want",
    [
        ([0, 2, 4, 6], PredictionMode(), [8, 10, 12]),
        ([0, 1, 4, 9, 16], PredictionMode("polynomial", 2), [25, 36]),
        (SINE, PredictionMode("seasonal", 1, 4), [0, 1, 0, -1]),
        ([i + v for i, v in enumerate(SINE)], PredictionMode("ensemble", 2, 4), [8, 10]),
        ([0, 1, 8, 27, 64], PredictionMode("polynomial", 3), [125, 216]),
        (range(14), PredictionMode.from_code(2, 0), [14]),
    ],
)
def test_forecast_golden(spark, y, mode, want):
    got = forecast.forecast_series(series(spark, y), ["t"], "y", len(want), mode).orderBy("step_index").collect()
    assert [r.step_index for r in got] == list(range(len(want)))
    assert [r.prediction for r in got] == pytest.approx(want, abs=1e-6)


def test_scaled_units_and_inverse(spark):
    df = series(spark, [0, 2, 4, 6])
    args = (["t"], "y", 3, PredictionMode(), ScalingMethod.MIN_MAX)
    assert [r.prediction for r in forecast.forecast_series(df, *args).orderBy("step_index").collect()] == pytest.approx([4 / 3, 5 / 3, 2])
    assert [r.prediction for r in forecast.forecast_series(df, *args, inverse_scale=True).orderBy("step_index").collect()] == pytest.approx([8, 10, 12])


def test_batch(spark):
    rows = [("A", 0.0, 100.0), ("A", 1.0, 110.0), ("A", 2.0, 120.0), ("B", 0.0, 50.0), ("B", 1.0, 55.0), ("B", 2.0, 60.0), ("C", 0.0, 1.0), ("D", 0.0, None), ("D", 1.0, 2.0), ("E", 0.0, 5.0), ("E", 1.0, 5.0), (None, 0.0, 1.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "sku_id string, time_index double, demand double, prediction string")
    got = {(r.sku_id, r.step_index): (r.prediction, r.error_code) for r in forecast.forecast_batch(df, 2).collect()}
    assert got[("A", 0)][0] == pytest.approx(130) and got[("A", 1)][0] == pytest.approx(140)
    assert got[("B", 0)][0] == pytest.approx(65) and got[("B", 1)][0] == pytest.approx(70)
    assert got[("C", None)] == (None, "ValidationError") and got[("D", None)] == (None, "ValidationError")
    assert got[("E", 0)][0] == pytest.approx(5) and len(got) == 8
    poly = {r.sku_id: r.error_code for r in forecast.forecast_batch(df, 1, "polynomial_2").collect()}
    assert poly["A"] is None and poly["E"] == "ModelError"
    flat = {r.sku_id: r.prediction for r in forecast.forecast_batch(df, 1, "linear", "standard").collect()}
    assert flat["E"] == 0.0
    assert forecast.forecast_batch(df.limit(0), 1).count() == 0
    for bad in (dict(steps=0), dict(steps=1, mode="cubic"), dict(steps=1, scaling="robust")):
        with pytest.raises(ValidationError):
            forecast.forecast_batch(df, **bad)


def test_time_is_position(spark):
    rows = [("S", t, v) for t, v in ((0.0, 100.0), (0.0, 105.0), (1.0, 110.0), (1.0, 115.0))]
    df = spark.createDataFrame(rows, "sku_id string, time_index double, demand double")
    assert forecast.forecast_batch(df, 1).first().prediction == pytest.approx(120)


def test_series_errors(spark):
    with pytest.raises(Exception, match="at least 2 data points"):
        forecast.forecast_series(series(spark, [1.0]), ["t"], "y", 1, PredictionMode()).collect()
    assert forecast.forecast_series(series(spark, []), ["t"], "y", 1, PredictionMode()).collect() == []
    with pytest.raises(ValidationError):
        forecast.forecast_series(series(spark, [1, 2]), ["t"], "y", 1, PredictionMode("seasonal", 1, 0))


def test_hot_series(spark, monkeypatch):
    """The range sort numbers a hot key as the window does."""
    rows = [("hot", float(i), float(i % 7)) for i in range(200)] + [("cold", float(i), float(i)) for i in range(5)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "sku_id string, time_index double, demand double")
    plain = sorted(map(tuple, forecast.positions(df, "sku_id", ["time_index"]).select("sku_id", "time_index", "t", "n").collect()))
    monkeypatch.setattr(forecast, "HOT", 50)
    assert sorted(map(tuple, forecast.positions(df, "sku_id", ["time_index"]).select("sku_id", "time_index", "t", "n").collect())) == plain
    assert all(t == i and n == (200 if k == "hot" else 5) for k, i, t, n in plain)


def test_matches_lstsq():
    rng = np.random.default_rng(3)
    n = np.array([30.0, 50.0])
    xs = [rng.normal(size=(int(m), 3)) for m in n]
    ys = [rng.normal(size=int(m)) for m in n]
    ok, c, b = forecast.solve(n, np.array([y.sum() for y in ys]), np.array([x.sum(0) for x in xs]), np.array([x.T @ x for x in xs]), np.array([x.T @ y for x, y in zip(xs, ys)]))
    for i in range(2):
        want = np.linalg.lstsq(np.c_[np.ones(len(ys[i])), xs[i]], ys[i], rcond=None)[0]
        assert ok[i] and np.allclose([c[i], *b[i]], want)


def test_linear_regression_x(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(1, 5)], "x double, y double")
    assert [r.prediction for r in forecast.linear_regression(df, "x", "y", 3).orderBy("step_index").collect()] == pytest.approx([10, 12, 14])


def own_baskets():
    """Forty baskets of up to seven of nine items, some items far more frequent than others."""
    rnd = random.Random(20)
    return [sorted({"klmnopqrs"[min(8, int(rnd.expovariate(0.45)))] for _ in range(rnd.randint(1, 7))}) for _ in range(40)]


def brute(baskets, least):
    items, out = sorted({i for b in baskets for i in b}), {}
    for k in range(1, len(items) + 1):
        for c in itertools.combinations(items, k):
            if (n := sum(set(c) <= set(b) for b in baskets)) >= least:
                out[c] = n
    return out


@pytest.mark.parametrize("least", [1, 2, 4, 9, 15, 30, 999])
def test_itemsets(spark, least):
    baskets = own_baskets()
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(baskets)], "order_id string, items array<string>")
    rows = itemsets.frequent_itemsets(df, least).collect()
    assert {tuple(sorted(r.pattern)): r.support for r in rows} == brute(baskets, least) and len(rows) == len(brute(baskets, least))


def test_items_of_other_types(spark):
    baskets = [[ord(i) for i in b] for b in own_baskets()]
    rows = itemsets.frequent_itemsets(spark.createDataFrame([(b,) for b in baskets], "items array<bigint>"), 5).collect()
    assert {tuple(sorted(r.pattern)): r.support for r in rows} == brute(baskets, 5) and isinstance(rows[0].pattern[0], int)
    none = itemsets.frequent_itemsets(spark.createDataFrame([([1],)], "items array<int>"), 2)
    assert none.count() == 0 and none.schema["pattern"].dataType.simpleString() == "array<int>"


def test_itemset_edges(spark):
    lines = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("2", "b"), (None, "a"), ("3", None)], "order_id string, item_id string")
    got = {tuple(r.pattern): r.support for r in itemsets.frequent_itemsets(itemsets.transactions(lines), 2).collect()}
    assert got == {("a",): 2, ("b",): 2, ("a", "b"): 2}
    with pytest.raises(ValidationError):
        itemsets.frequent_itemsets(itemsets.transactions(lines), 0)
    assert itemsets.frequent_itemsets(itemsets.transactions(lines.limit(0)), 1).count() == 0
    lost = itemsets.eliminated_baskets(spark.createDataFrame([("1", ["a", "x"]), ("2", ["a"])], "order_id string, items array<string>"), 2)
    assert [tuple(r) for r in lost.collect()] == [("1", 1)]


def test_kmeans(spark):
    df = frame(spark, [1, 1.5, 10, 10.5], [1, 1.5, 10, 10.5])
    seeded, centres = clustering.kmeans_farthest_first(df, ["f0", "f1"], 2, "order_id")
    assert column(seeded, "cluster_id") == [0, 0, 1, 1] and centres[1] == pytest.approx([10.25, 10.25])
    assert column(clustering.kmeans(df, ["f0", "f1"], 2), "cluster_id") == [0, 0, 1, 1]
    assert column(clustering.kmeans(df, ["f0", "f1"], 1), "cluster_id") == [0, 0, 0, 0]
    for k in (0, 5):
        with pytest.raises(ValidationError):
            clustering.kmeans(df, ["f0", "f1"], k)
        with pytest.raises(ValidationError):
            clustering.kmeans_farthest_first(df, ["f0", "f1"], k, "order_id")
    same = frame(spark, [2, 2, 2], [3, 3, 3])
    got, _ = clustering.kmeans_farthest_first(same, ["f0", "f1"], 2, "order_id")
    assert set(column(got, "cluster_id")) == {0}


def test_knn(spark):
    df = frame(spark, [0, 1, 10], [0, 1, 10])
    got = {r.id: r.score for r in knn.knn_scores(df, "order_id", ["f0", "f1"], 2).collect()}
    assert [got[f"o{i}"] for i in range(3)] == pytest.approx([7.778174593, 7.071067812, 13.435028843])
    assert knn.knn_scores(frame(spark, range(5), range(5)), "order_id", ["f0", "f1"], 10).count() == 5
    with pytest.raises(ValidationError, match="empty"):
        knn.knn_scores(df.limit(0), "order_id", ["f0", "f1"], 2)
    with pytest.raises(ValidationError, match="at least 2"):
        knn.knn_scores(df.limit(1), "order_id", ["f0", "f1"], 2)
    with pytest.raises(ValidationError, match="17"):
        knn.knn_scores(df, "order_id", ["f0"] * 17, 2)


def test_knn_in_blocks(spark, monkeypatch):
    """Several blocks, copies and ties against brute force."""
    from ledgerloom.operators import space

    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(300, 3)), rng.normal(size=(100, 3)) * 50, np.zeros((20, 3))].round(1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, z array<double>")
    monkeypatch.setattr(space.into_blocks, "__defaults__", (32,))
    got = {(r.id, r.nth): r.neighbour for r in knn.knn(df, "id", F.col("z"), 4).collect()}
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    for i in range(len(x)):
        want = [j for _, j in sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]]
        assert [d[i, got[i, k + 1]] for k in range(4)] == pytest.approx([d[i, j] for j in want])


def test_anomalies(spark):
    df = frame(spark, [1, 2, 3, 100], [2, 3, 4, 200])
    got = iforest.anomalies(df, 0.8).orderBy("order_id").collect()
    assert len(got) == 4 and got[3].abnormal_score > got[0].abnormal_score
    for width in (7, 11):
        assert iforest.anomalies(frame(spark, *[range(10)] * width), 0.5).count() == 10
    for bad in (frame(spark, *[range(10)] * 20), df.limit(0)):
        with pytest.raises(ValidationError):
            iforest.anomalies(bad, 0.5)
    with pytest.raises(ValidationError, match="threshold must be 0-1, got 1.5"):
        iforest.anomalies(df, 1.5)
    with pytest.raises(ValidationError):
        iforest.anomalies(frame(spark, *[range(5)] * 3), 0.5, strict_dims=True)
    s = iforest.anomaly_summary(iforest.anomalies(df, 0.0)).first()
    assert s.rows == 4 and s.anomalies == 4 and s.percent == 100.0


def test_anomalies_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, *rng.normal(size=(4, 600)))
    a = {r.order_id: r.abnormal_score for r in iforest.anomalies(df.repartition(1), 0.5, 2).collect()}
    b = {r.order_id: r.abnormal_score for r in iforest.anomalies(df.repartition(7), 0.5, 0).collect()}
    c = {r.order_id: r.abnormal_score for r in iforest.anomalies(df.repartition(5), 0.5, 0).collect()}
    assert b == c and set(a) == set(b)


def plain_forest_scores(x, sample, seed, trees):
    """The forest's scores by nested nodes and a walk for each row."""
    size = min(len(sample), iforest.SAMPLE)
    depth_most = max(1, math.ceil(math.log2(max(2, size))))

    def average(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def grow(rows, depth, rng):
        if depth >= depth_most or len(rows) <= 1 or (rows == rows[0]).all():
            return depth + average(len(rows))
        a = int(rng.integers(rows.shape[1]))
        b = int(rng.integers(rows.shape[1] - 1))
        b += b >= a
        w = rng.standard_normal(2)
        p = rng.uniform(rows.min(0)[[a, b]], rows.max(0)[[a, b]])
        at = float((p * w).sum())
        side = rows[:, a] * w[0] + rows[:, b] * w[1] <= at
        left = grow(rows[side], depth + 1, rng)
        return a, b, w, at, left, grow(rows[~side], depth + 1, rng)

    def walk(node, row):
        while isinstance(node, tuple):
            a, b, w, at, left, right = node
            node = left if row[a] * w[0] + row[b] * w[1] <= at else right
        return node

    total = np.zeros(len(x))
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        rows = sample[np.sort(rng.permutation(len(sample))[:size])]
        root = grow(rows, 0, rng)
        total += [walk(root, row) for row in x]
    return 2.0 ** (-(total / trees) / average(size))


def test_anomalies_by_a_plain_forest(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(700, 3)), rng.normal(size=(8, 3)) * 9]
    df = frame(spark, *x.T)
    ranked = df.select("order_id", "f0", "f1", "f2", (F.shiftrightunsigned(F.xxhash64("order_id", "f0", "f1", "f2", F.lit(5)), 12)).alias("rank")).orderBy("rank").collect()
    sample = np.array([r[1:4] for r in ranked[: 20 * iforest.SAMPLE]])
    got = {r.order_id: r.abnormal_score for r in iforest.anomalies(df, 0.6, seed=5, trees=20).collect()}
    assert [got[f"o{i}"] for i in range(len(x))] == pytest.approx(list(plain_forest_scores(x, sample, 5, 20)), abs=1e-9)
    assert sum(sorted(got, key=got.get, reverse=True)[i] in {f"o{j}" for j in range(700, 708)} for i in range(8)) >= 6  # the far ones


def test_anomalies_among_copies(spark):
    """Rows of which most are copies of one still give a sample and a score, at any number of rows."""
    df = frame(spark, [0.0] * 500 + [50.0], [0.0] * 500 + [-50.0]).withColumn("order_id", F.lit("same"))
    got = {round(r.f, 3) for r in iforest.anomalies(df, 0.5, trees=2).agg(F.max("abnormal_score").alias("f")).collect()}
    assert got and got != {0.0}


def test_validate(spark):
    for values in ([1, float("nan")], [1, float("inf")], []):
        with pytest.raises(ValidationError):
            validate_features(frame(spark, values), ["f0"])
    with pytest.raises(ValidationError):
        validate_features(frame(spark, [1]), [])
    validate_threshold(0)
    assert split_error("ModelError: a: b") == ("ModelError", "a: b") and split_error("odd") == ("ModelError", "odd")
    assert str(ModelError("x")) == "ModelError: x" and issubclass(ArrowError, AnalysisError)


def ipc(**columns):
    return pa_bytes(pa.table(columns))


def pa_bytes(table):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def test_api(spark):
    data = ipc(order_id=["a", "b", "c", "d"], f1=[1.0, 2.0, 3.0, 100.0], f2=[2.0, 3.0, 4.0, 200.0])
    got = pa.ipc.open_stream(api.detect_order_anomalies(spark, data, 0.6, 1)).read_all()
    assert got.column_names == ["order_id", "abnormal_score", "is_abnormal"] and got.num_rows == 4
    got = pa.ipc.open_stream(api.segment_customer_orders(spark, data, 2)).read_all().to_pydict()
    assert got["cluster_id"].count(0) == 3
    got = pa.ipc.open_stream(api.predict_inventory_demand(spark, ipc(order_id=["a", "b", "c"], t=[0.0, 1.0, 2.0], y=[1.0, 2.0, 3.0]), 2)).read_all().to_pydict()
    assert got["prediction"] == pytest.approx([4, 5])
    batch = ipc(sku_id=["A", "A", "B"], time_index=[0.0, 1.0, 0.0], demand=[1.0, 2.0, 3.0], more=[1, 2, 3])
    got = pa.ipc.open_stream(api.predict_inventory_demand_batch(spark, batch, 1)).read_all().to_pydict()
    assert got["sku_id"] == ["A", "B"] and got["error_code"] == [None, "ValidationError"]
    late = ipc(sku_id=["Z", "A", "Z", "M", "A", "M"], time_index=[0.0, 0.0, 1.0, 0.0, 1.0, 1.0], demand=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    got = pa.ipc.open_stream(api.predict_inventory_demand_batch(spark, late, 2)).read_all().to_pydict()
    assert got["sku_id"] == ["Z", "Z", "A", "A", "M", "M"] and got["step_index"] == [0, 1] * 3  # as they first appear
    got = pa.ipc.open_stream(api.find_association_patterns(spark, ipc(o=["1", "1", "2"], i=["x", "y", "x"]), 2)).read_all().to_pydict()
    assert got == {"pattern": [["x"]], "support": [2]}
    assert pa.ipc.open_stream(api.find_association_patterns(spark, ipc(o=["1"], i=["x"]), 9)).read_all().num_rows == 0
    assert api.get_version()


def test_ipc_errors(spark):
    for data in (b"", b"nonsense"):
        with pytest.raises(ArrowError):
            read_ipc(spark, data)
    with pytest.raises(ValidationError):
        read_features(spark, ipc(key=["a"], f=[1.0]))
    with pytest.raises(ArrowError):
        read_features(spark, ipc(order_id=["a"], f=[1]))
    with pytest.raises(ValidationError):
        read_features(spark, ipc(order_id=["a"]))
    with pytest.raises(ValidationError):
        read_features(spark, pa_bytes(pa.table({"order_id": pa.array([], pa.string()), "f": pa.array([], pa.float64())})))
    with pytest.raises(ValidationError):
        read_forecast_batch(spark, ipc(sku_id=["a"], demand=[1.0], time_index=[1.0]))
    with pytest.raises(ValidationError):
        read_transactions(spark, ipc(a=["a"], b=[1]))
    big = read_ipc(spark, pa_bytes(pa.table({"u": pa.array([7], pa.uint64())})))
    assert big.schema["u"].dataType.simpleString() == "bigint" and to_ipc(big)


def test_patterns_of_items_by_brute_force(spark):
    """The registered query finds every itemset in at least 20 per mille of the baskets."""
    from ledgerloom.plans import registry

    from .conftest import DATA

    baskets = {}
    for r in spark.read.parquet(f"{DATA}/basket_lines.parquet").select("order_id", "item_id").collect():
        item = (r.item_id or "").strip(" \t").upper()
        if r.order_id is not None and item:
            baskets.setdefault(r.order_id, set()).add(item)
    least = max(2, len(baskets) * 20 // 1000)
    want, held = {}, {}
    for i in {i for b in baskets.values() for i in b}:
        held[(i,)] = {o for o, b in baskets.items() if i in b}
    held = {p: o for p, o in held.items() if len(o) >= least}
    single = {p[0]: o for p, o in held.items()}
    while held:
        want |= {"|".join(p): len(o) for p, o in held.items()}
        held = {(*p, i): o & single[i] for p, o in held.items() for i in single if i > p[-1]}
        held = {p: o for p, o in held.items() if len(o) >= least}
    got = {r.pattern: r.support for r in registry.queries()["patterns_items"](spark, DATA).collect()}
    assert got == want and max(p.count("|") for p in got) >= 5


def test_registered_kmeans_is_steady(spark):
    """Each row is nearest to its own centre, and each centre is the mean of its rows."""
    from ledgerloom.plans import analytics, registry

    from .conftest import DATA

    cluster = {r.order_id: r.cluster_id for r in registry.queries()["kmeans_farthest_first"](spark, DATA).collect()}
    centres = np.array([[r.f0, r.f1] for r in registry.queries()["kmeans_centroids"](spark, DATA).orderBy("cluster_id").collect()])
    rows = analytics._square(spark, DATA).collect()
    x, c = np.array([[r.balance, r.nation] for r in rows]), np.array([cluster[r.order_id] for r in rows])
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (d[np.arange(len(x)), c] <= d.min(1) + 1e-5).all()
    assert np.allclose([x[c == k].mean(0) for k in range(3)], centres, atol=1e-5)
