"""Queries of scaling, forecasts, itemsets, clusters, neighbours and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, forecast, iforest, itemsets, knn
from ..operators.scaling import normalize_scores, scale
from ..operators.validate import feature_counts
from ..session import cut, table
from ..types import PredictionMode, ScalingMethod

Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    Q[name] = run
    if sql:
        SQL[name] = sql


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# -- scaling ---------------------------------------------------------------------------------------------------------


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("order_id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.lit(5.0).alias("same"))


_CUSTOMERS = "c AS (SELECT CAST(c_custkey AS VARCHAR) order_id, c_acctbal balance, CAST(c_nationkey AS DOUBLE) nation, 5.0::DOUBLE same FROM customer)"


def _scale_sql(method: int) -> str:
    def one(c: str) -> str:
        if method == 0:
            return f"round({c}, 6) {c}"
        shift, spread = (f"min({c}) OVER ()", f"(max({c}) OVER () - min({c}) OVER ())") if method == 1 else (f"avg({c}) OVER ()", f"stddev_pop({c}) OVER ()")
        return f"round(CASE WHEN abs({spread}) < 2.220446049250313e-16 THEN 0.0 ELSE ({c} - {shift}) / {spread} END, 6) {c}"

    return f"WITH {_CUSTOMERS} SELECT order_id, {one('balance')}, {one('nation')}, {one('same')} FROM c"


for _code, _name in ((0, "none"), (1, "minmax"), (2, "standard")):
    _add(f"scale_{_name}", lambda s, d, m=_code: _rounded(scale(_customers(s, d), ["balance", "nation", "same"], m), 6, "balance", "nation", "same"), _scale_sql(_code))
_add("scale_constant_column", lambda s, d: scale(_customers(s, d).select("order_id", "same"), ["same"], 2), "SELECT CAST(c_custkey AS VARCHAR) order_id, 0.0::DOUBLE same FROM customer")
_add(
    "normalize_scores",
    lambda s, d: _rounded(normalize_scores(_customers(s, d).select("order_id", "balance"), "balance"), 6, "balance"),
    f"WITH {_CUSTOMERS} SELECT order_id, round((balance - min(balance) OVER ()) / (max(balance) OVER () - min(balance) OVER ()), 6) balance FROM c",
)

_DAILY = 'd AS (SELECT event_type sku_id, CAST(ts AS DATE) AS "day", sum(value) y FROM events GROUP BY 1, 2)'


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("sku_id"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))


for _code, _name, _shift, _spread in ((1, "minmax", "min(y) OVER w", "max(y) OVER w - min(y) OVER w"), (2, "standard", "avg(y) OVER w", "stddev_pop(y) OVER w")):
    _add(
        f"scale_{_name}_per_sku",
        lambda s, d, m=_code: _rounded(scale(_daily(s, d), ["y"], m, by="sku_id"), 5, "y"),
        f"WITH {_DAILY} SELECT sku_id, \"day\", round(CASE WHEN abs({_spread}) < 2.220446049250313e-16 THEN 0.0 ELSE (y - {_shift}) / ({_spread}) END, 5) y FROM d WINDOW w AS (PARTITION BY sku_id)",
    )

_FRAME = [f"feature_{i}" for i in range(10)]


def _some_sql(test: str) -> str:
    return "count_if(" + " OR ".join(test.format(c=c) for c in _FRAME) + ")"


_add(
    "validate_features_counts",
    lambda s, d: feature_counts(table(s, d, "feature_frame"), _FRAME),
    f"SELECT count(*) AS \"rows\", {_some_sql('{c} IS NULL')} null_rows, {_some_sql('coalesce(isnan({c}), false)')} nan_rows, {_some_sql('coalesce(isinf({c}), false)')} infinite_rows FROM feature_frame",
)

# -- forecasts -------------------------------------------------------------------------------------------------------


def _forecast_sql(source: str, mode: PredictionMode, steps: int, scaling: int = 0, digits: int = 4, single: bool = False) -> str:
    """Independent of the operator's way: orthogonalises the features by windows over training and future rows."""
    period = mode.period
    x = {
        "linear": ["t"],
        "polynomial": ["t", "t * t", "t * t * t"][: mode.degree],
        "seasonal": ["t", f"sin(2 * pi() * t / {period})", f"cos(2 * pi() * t / {period})"],
        "ensemble": ["t", "t * t", f"sin(2 * pi() * t / {period})", f"cos(2 * pi() * t / {period})"],
    }[mode.kind]
    k = len(x)
    w = "OVER (PARTITION BY sku_id)"
    shift, spread = {0: ("0", "1"), 1: (f"min(y) {w}", f"max(y) {w} - min(y) {w}"), 2: (f"avg(y) {w}", f"stddev_pop(y) {w}")}[scaling]
    parts = [
        source,
        "r AS (SELECT sku_id, CAST(row_number() OVER (PARTITION BY sku_id ORDER BY o, y) - 1 AS DOUBLE) t, y, 1 tr FROM s)",
        f"u AS (SELECT * FROM r UNION ALL SELECT sku_id, CAST(n + i AS DOUBLE), NULL, 0 FROM (SELECT sku_id, count(*) n FROM r GROUP BY 1), range({steps}) q(i))",
        f"z AS (SELECT sku_id, t, tr, (y - ({shift})) / ({spread}) y FROM u)",
        "f AS (SELECT sku_id, t, tr, y, " + ", ".join(f"{e} x{i}" for i, e in enumerate(x)) + " FROM z)",
        "g0 AS (SELECT sku_id, t, tr, y, " + ", ".join(f"x{i} - avg(CASE WHEN tr = 1 THEN x{i} END) {w} x{i}" for i in range(k)) + " FROM f)",
    ]
    for j in range(k - 1):
        cols = [f"x{i}" for i in range(j + 1)] + [f"x{i} - x{j} * sum(CASE WHEN tr = 1 THEN x{i} * x{j} END) {w} / sum(CASE WHEN tr = 1 THEN x{j} * x{j} END) {w} x{i}" for i in range(j + 1, k)]
        parts.append(f"g{j + 1} AS (SELECT sku_id, t, tr, y, {', '.join(cols)} FROM g{j})")
    p = f"avg(y) {w}" + "".join(f" + x{j} * sum(CASE WHEN tr = 1 THEN y * x{j} END) {w} / sum(CASE WHEN tr = 1 THEN x{j} * x{j} END) {w}" for j in range(k))
    parts.append(f"p AS (SELECT sku_id, CAST(row_number() OVER (PARTITION BY sku_id, tr ORDER BY t) - 1 AS INT) step_index, round({p}, {digits}) prediction, tr FROM g{k - 1})")
    tail = "" if single else ", CAST(NULL AS VARCHAR) error_code, CAST(NULL AS VARCHAR) error_message"
    return f"WITH {', '.join(parts)} SELECT {'' if single else 'sku_id, '}step_index, prediction{tail} FROM p WHERE tr = 0"


_MODES = {"linear": PredictionMode(), "poly2": PredictionMode("polynomial", 2), "poly3": PredictionMode("polynomial", 3), "seasonal7": PredictionMode("seasonal"), "ensemble": PredictionMode("ensemble", 2)}
_DAY_SOURCE = _DAILY + ", s AS (SELECT sku_id, \"day\" o, y FROM d)"
for _name, _mode in _MODES.items():
    for _tail, _code in (("", 0), ("_minmax", 1), ("_standard", 2)):
        _add(
            f"forecast_batch_{_name}{_tail}",
            lambda s, d, m=_mode, c=_code: _rounded(forecast.forecast(_daily(s, d), "sku_id", ["day"], "y", 3, m, ScalingMethod(c)), 3, "prediction"),
            _forecast_sql(_DAY_SOURCE, _mode, 3, _code, 3),
        )

_MONTHS = "s AS (SELECT 'all' sku_id, date_trunc('month', o_orderdate) o, sum(o_totalprice) / 1e6 y FROM orders GROUP BY 2)"


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("o")).agg((F.sum("o_totalprice") / 1e6).alias("y"))


for _name, _mode in (("linear", _MODES["linear"]), ("poly2", _MODES["poly2"]), ("seasonal", PredictionMode("seasonal", 1, 12)), ("ensemble", PredictionMode("ensemble", 2, 12))):
    _add(f"forecast_single_{_name}", lambda s, d, m=_mode: _rounded(forecast.forecast_series(_monthly(s, d), ["o"], "y", 6, m), 4, "prediction"), _forecast_sql(_MONTHS, _mode, 6, 0, 4, True))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by part and line number, some series of a single point."""
    return table(spark, d, "lineitem").select(F.concat_ws("-", "l_partkey", "l_linenumber").alias("sku_id"), F.col("l_shipdate").alias("o"), F.col("l_quantity").alias("y"))


def _line_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast(_lines(spark, d), "sku_id", ["o"], "y", 2, _MODES["linear"])


_LINES = "s AS (SELECT l_partkey || '-' || l_linenumber sku_id, l_shipdate o, l_quantity y FROM lineitem)"
_LONG = _LINES.replace("s AS", "s0 AS") + ", n AS (SELECT sku_id FROM s0 GROUP BY 1 HAVING count(*) {}), s AS (SELECT * FROM s0 SEMI JOIN n USING (sku_id))"
_ERRORS = f"WITH {_LONG.format('= 1')} SELECT sku_id, 'ValidationError' error_code, 'prediction requires at least 2 data points' error_message FROM s"
_GOOD = _forecast_sql(_LONG.format("> 1"), _MODES["linear"], 2)
_add("forecast_success_rows", lambda s, d: _rounded(_line_forecast(s, d).where("error_code is null").select("sku_id", "step_index", "prediction"), 4, "prediction"), f"SELECT sku_id, step_index, prediction FROM ({_GOOD})")
_add("forecast_error_rows", lambda s, d: _line_forecast(s, d).where("error_code is not null").select("sku_id", "error_code", "error_message"), _ERRORS)
_add(
    "forecast_batch_errors",
    lambda s, d: _rounded(_line_forecast(s, d), 4, "prediction"),
    f"SELECT * FROM ({_GOOD}) UNION ALL SELECT sku_id, CAST(NULL AS INT), CAST(NULL AS DOUBLE), error_code, error_message FROM ({_ERRORS})",
)


def _demand(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each point."""
    rows = table(spark, d, "forecast_batch").where("sku_id is not null")
    return rows.groupBy("sku_id", "time_index").agg(F.max_by("demand", F.struct("loaded_ts", F.coalesce("demand", F.lit(-1.0)))).alias("demand"))


_DEMAND = "s0 AS (SELECT sku_id, time_index o, arg_max_null(demand, (loaded_ts, coalesce(demand, -1.0))) y FROM forecast_batch WHERE sku_id IS NOT NULL GROUP BY 1, 2), ok AS (SELECT sku_id FROM s0 GROUP BY 1 HAVING count(*) > 1 AND count(y) = count(*)), s AS (SELECT * FROM s0 SEMI JOIN ok USING (sku_id))"
def _series_of(rows: DataFrame, most: int) -> DataFrame:
    """Series of more than ``most`` points."""
    return rows.join(rows.groupBy("sku_id").agg(F.count("*").alias("points")).where(F.col("points") > most).select("sku_id"), "sku_id", "left_semi")


# an ensemble of four features is determined by five points, and by more than seven well so
for _name, _enough in (("linear", 1), ("ensemble", 7)):
    _add(
        f"forecast_skus_{_name}",
        lambda s, d, m=_MODES[_name], k=_enough: _rounded(forecast.forecast(_series_of(_demand(s, d), k) if k > 1 else _demand(s, d), "sku_id", ["time_index"], "demand", 4, m).where("error_code is null").select("sku_id", "step_index", "prediction"), 3, "prediction"),
        f"SELECT sku_id, step_index, prediction FROM ({_forecast_sql(_DEMAND.replace('count(*) > 1', f'count(*) > {_enough}'), _MODES[_name], 4, 0, 3)})",
    )
_add(
    "linear_regression_x",
    lambda s, d: _rounded(forecast.linear_regression(table(s, d, "lineitem"), "l_quantity", "l_discount", 3), 8, "prediction"),
    "WITH f AS (SELECT count(*) n, regr_slope(l_discount, l_quantity) b, regr_intercept(l_discount, l_quantity) a FROM lineitem) SELECT CAST(i AS INT) step_index, round(a + b * (n + 1 + i), 8) prediction FROM f, range(3) r(i)",
)

# -- itemsets --------------------------------------------------------------------------------------------------------


def _brand_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_orderkey").cast("string").alias("order_id"), F.col("p_brand").alias("item_id"))


def _sold(spark: SparkSession, d: str) -> DataFrame:
    item = F.upper(F.btrim("item_id", F.lit(" \t")))
    return table(spark, d, "basket_lines").select("order_id", item.alias("item_id")).where("order_id is not null and item_id <> ''")


_BRANDS = "b AS (SELECT DISTINCT l_orderkey o, p_brand i FROM lineitem JOIN part ON l_partkey = p_partkey)"
_SOLD = "b AS (SELECT DISTINCT order_id o, upper(trim(item_id, ' ' || chr(9))) i FROM basket_lines WHERE order_id IS NOT NULL AND upper(trim(item_id, ' ' || chr(9))) <> '')"


def _share(baskets: DataFrame, per_mille: int) -> int:
    return max(2, baskets.count() * per_mille // 1000)


def _patterns(lines: DataFrame, per_mille: int, size: int | None = None) -> DataFrame:
    baskets = cut(itemsets.transactions(lines))
    found = itemsets.frequent_itemsets(baskets, _share(baskets, per_mille))
    found = found if size is None else found.where(F.size("pattern") == size)
    return found.select(F.array_join(F.sort_array("pattern"), "|").alias("pattern"), "support")


def _patterns_sql(source: str, per_mille: int, size: int | None = None) -> str:
    """Itemsets of any size, each grown from one without its last item, with the baskets that hold it."""
    parts = [
        source,
        f"m AS (SELECT greatest(2, count(DISTINCT o) * {per_mille} // 1000) n FROM b)",
        "s AS (SELECT i, list(o) held FROM b GROUP BY 1 HAVING count(*) >= (SELECT n FROM m))",
        "r AS (SELECT 1 size, i pattern, i last_i, held FROM s UNION ALL SELECT size + 1, r.pattern || '|' || s.i, s.i, list_intersect(r.held, s.held) FROM r JOIN s ON s.i > r.last_i WHERE len(list_intersect(r.held, s.held)) >= (SELECT n FROM m))",
    ]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT pattern, CAST(len(held) AS BIGINT) support FROM r" + ("" if size is None else f" WHERE size = {size}")


_add("patterns_brand", lambda s, d: _patterns(_brand_lines(s, d), 5), _patterns_sql(_BRANDS, 5))
_add("patterns_pairs", lambda s, d: _patterns(_brand_lines(s, d), 5, 2), _patterns_sql(_BRANDS, 5, 2))
_add("patterns_items", lambda s, d: _patterns(_sold(s, d), 20), _patterns_sql(_SOLD, 20))
_add("item_support", lambda s, d: itemsets.item_support(_sold(s, d)), f"WITH {_SOLD} SELECT i item, count(*) support FROM b GROUP BY 1")
_add(
    "eliminated_baskets",
    lambda s, d: itemsets.eliminated_baskets(itemsets.transactions(_sold(s, d)), 3),
    f"WITH {_SOLD}, r AS (SELECT i FROM b GROUP BY 1 HAVING count(*) < 3) SELECT o order_id, count(*) lost FROM b SEMI JOIN r USING (i) GROUP BY 1",
)

# -- neighbours and clusters -----------------------------------------------------------------------------------------


def _square(spark: SparkSession, d: str) -> DataFrame:
    return scale(_customers(spark, d), ["balance", "nation"], 1)


_SQUARE = f"{_CUSTOMERS}, x AS (SELECT CAST(order_id AS BIGINT) seq, order_id, (balance - min(balance) OVER ()) / (max(balance) OVER () - min(balance) OVER ()) f0, (nation - min(nation) OVER ()) / (max(nation) OVER () - min(nation) OVER ()) f1 FROM c)"
_add(
    "knn_scores",
    lambda s, d: _rounded(knn.knn_scores(_square(s, d), "order_id", ["balance", "nation"], 5), 6, "score"),
    f"WITH {_SQUARE}, p AS (SELECT a.order_id id, sqrt((a.f0 - b.f0) ** 2 + (a.f1 - b.f1) ** 2) d FROM x a JOIN x b ON a.seq <> b.seq), r AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) k FROM p) SELECT id, round(avg(d), 6) score FROM r WHERE k <= 5 GROUP BY 1",
)
_add(
    "knn_topk",
    lambda s, d: _rounded(knn.knn(table(s, d, "embeddings"), "vec_id", F.col("embedding").cast("array<double>"), 5).select("id", F.col("nth").cast("int").alias("nth"), "neighbour", "distance"), 4, "distance"),
    "WITH p AS (SELECT a.vec_id id, b.vec_id neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) nth FROM p) SELECT id, CAST(nth AS INT) nth, neighbour, round(d, 4) distance FROM r WHERE nth <= 5",
)


def _kmeans_sql(k: int, iterations: int, out: str) -> str:
    """Lloyd's iterations as a recursion over one row of centres; ``out`` reads them from u, as they were at the last assignment."""
    d = "(x.f0 - {c}.f0) ** 2 + (x.f1 - {c}.f1) ** 2"
    parts = [_SQUARE, "s0 AS (SELECT f0, f1 FROM x ORDER BY seq LIMIT 1)"]
    for j in range(1, k):
        least = "least(" + ", ".join(d.format(c=f"s{i}") for i in range(j)) + ")"
        parts.append(f"s{j} AS (SELECT x.f0, x.f1 FROM x, {', '.join(f's{i}' for i in range(j))} ORDER BY {least} DESC, seq DESC LIMIT 1)")
    near = [f"(x.f0 - a{j}) ** 2 + (x.f1 - b{j}) ** 2" for j in range(k)]
    cluster = "CASE" + "".join(f" WHEN {near[j]} <= least({', '.join(near)}) THEN {j}" for j in range(k)) + " END"
    means = [f"coalesce(avg({f}) FILTER (WHERE c = {j}), 0)" for j in range(k) for f in ("f0", "f1")]
    old = [f"{c}{j}" for j in range(k) for c in "ab"]
    still = " AND ".join(f"abs({m} - any_value({o})) < 1e-6" for m, o in zip(means, old))
    seeds = ", ".join(f"s{j}.f0 a{j}, s{j}.f1 b{j}" for j in range(k))
    parts.append(f"r AS (SELECT 0 it, false still, {seeds} FROM {', '.join(f's{j}' for j in range(k))} UNION ALL SELECT it + 1, it > 0 AND {still}, {', '.join(means)} FROM (SELECT r.*, f0, f1, {cluster} c FROM r, x WHERE NOT still AND it < {iterations}) GROUP BY it)")
    parts.append("u AS (SELECT * FROM r ORDER BY it DESC LIMIT 1 OFFSET 1)")
    return f"WITH RECURSIVE {', '.join(parts)} {out.format(cluster=cluster)}"


def _seeded(spark: SparkSession, d: str, iterations: int = clustering.ITERATIONS) -> tuple[DataFrame, list[list[float]]]:
    rows = _square(spark, d).withColumn("seq", F.col("order_id").cast("bigint"))
    return clustering.kmeans_farthest_first(rows, ["balance", "nation"], 3, "seq", iterations)


_ASSIGNED = "SELECT order_id, CAST({cluster} AS BIGINT) cluster_id FROM x, u"
_add("kmeans_farthest_first", lambda s, d: _seeded(s, d)[0].select("order_id", "cluster_id"), _kmeans_sql(3, clustering.ITERATIONS, _ASSIGNED))
_add("kmeans_assign", lambda s, d: _seeded(s, d, 1)[0].select("order_id", "cluster_id"), _kmeans_sql(3, 1, _ASSIGNED))


def _centroids(spark: SparkSession, centres: list[list[float]]) -> DataFrame:
    rows = spark.createDataFrame([(i, float(c[0]), float(c[1])) for i, c in enumerate(centres)], "cluster_id bigint, f0 double, f1 double")
    return rows.select("cluster_id", F.round("f0", 6).alias("f0"), F.round("f1", 6).alias("f1"))


_add(
    "kmeans_centroids",
    lambda s, d: _centroids(s, _seeded(s, d)[1]),
    _kmeans_sql(3, clustering.ITERATIONS, " UNION ALL ".join(f"SELECT CAST({j} AS BIGINT) cluster_id, round(a{j}, 6) f0, round(b{j}, 6) f1 FROM u" for j in range(3))),
)


def _clean_frame(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "feature_frame").distinct()
    for c in _FRAME:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df


_add("kmeans_mllib", lambda s, d: clustering.kmeans(scale(_clean_frame(s, d), _FRAME, 2), _FRAME, 5))

# -- anomalies -------------------------------------------------------------------------------------------------------


def _line_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


_add("anomalies", lambda s, d: iforest.anomalies(_clean_frame(s, d), 0.6, 2))
_add("anomalies_lines", lambda s, d: iforest.anomalies(_line_features(s, d), 0.6, 2))
_add("anomaly_summary", lambda s, d: iforest.anomaly_summary(iforest.anomalies(_clean_frame(s, d), 0.6, 2)))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
