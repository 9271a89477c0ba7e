"""K-means: the library's, and a deterministic one with farthest-first seeds."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..session import cut
from .validate import validate_dims

ITERATIONS, TOLERANCE = 100, 1e-6


def _distance(x: list[Column], centre: list[float]) -> Column:
    out = None
    for c, v in zip(x, centre):
        d = (c - F.lit(float(v))) * (c - F.lit(float(v)))
        out = d if out is None else out + d
    return out


def assign(features: list[Column], centres: list[list[float]]) -> tuple[Column, Column]:
    """(cluster, squared distance) of the nearest centre; of equal ones the lowest number."""
    best = F.array_min(F.array(*[F.struct(_distance(features, c).alias("d"), F.lit(i).cast("bigint").alias("c")) for i, c in enumerate(centres)]))
    return best["c"], best["d"]


def farthest_first(df: DataFrame, features: list[str], order: str, k: int) -> list[list[float]]:
    """Seeds: the row that comes first by ``order``, then k-1 times the row farthest from its nearest seed (ties: the last)."""
    x = [F.col(f"`{c}`").cast("double") for c in features]
    row = F.array(*x)
    first = df.agg(F.min_by(row, F.col(order)).alias("x")).first().x
    centres = [list(first)]
    while len(centres) < k:
        _, d = assign(x, centres)
        centres.append(list(df.agg(F.max_by(row, F.struct(d, F.col(order))).alias("x")).first().x))
    return centres


def kmeans_farthest_first(df: DataFrame, features: list[str], k: int, order: str, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[list[float]]]:
    """(``df`` with cluster_id, centres): Lloyd's iterations from farthest-first seeds.

    ``order`` is a unique column that says which row is first. A cluster that gets no rows moves to the origin. Stops when
    no coordinate moves by ``tolerance`` after the first iteration; the assignment is that of the last assigning step.
    Each iteration is one scan with partial aggregates of k rows; the features stay in the cache, which executors spill.
    """
    if k < 1:
        raise ValidationError("n_clusters must be at least 1")
    own = df.select(F.col(order), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]).persist()
    try:
        n = own.count()
        if k > n:
            raise ValidationError(f"n_clusters is {k} but there are only {n} rows")
        names = [f"f{i}" for i in range(len(features))]
        x = [F.col(c) for c in names]
        centres = farthest_first(own, names, order, k)
        used = centres
        for i in range(iterations):
            used = centres
            cluster, _ = assign(x, used)
            got = {r.c: [r[c] for c in names] for r in own.groupBy(cluster.alias("c")).agg(*[F.avg(c).alias(c) for c in names]).collect()}  # k rows
            centres = [got.get(c, [0.0] * len(names)) for c in range(k)]
            if i > 0 and all(abs(a - b) < tolerance for p, q in zip(used, centres) for a, b in zip(p, q)):
                break
    finally:
        own.unpersist()
    cluster, _ = assign([F.col(f"`{c}`").cast("double") for c in features], used)
    return df.withColumn("cluster_id", cluster), used


def kmeans(df: DataFrame, features: list[str], k: int, id_col: str = "order_id", seed: int = 7, iterations: int = ITERATIONS) -> DataFrame:
    """id, cluster_id by the library's k-means; clusters are numbered by their least id, so numbers don't change with the run."""
    validate_dims(len(features))
    rows = cut(VectorAssembler(inputCols=features, outputCol="__x").transform(df).select(id_col, "__x"))  # read once an iteration
    n = rows.count()
    if not 1 <= k <= n:
        raise ValidationError(f"n_clusters must be 1 to {n}, got {k}")
    if k == 1:
        return rows.select(id_col, F.lit(0).cast("bigint").alias("cluster_id"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="__x", predictionCol="__c").fit(rows)
    out = model.transform(rows).select(id_col, "__c")
    least = {r["__c"]: r.least for r in out.groupBy("__c").agg(F.min(id_col).alias("least")).collect()}  # k rows
    number = {c: i for i, c in enumerate(sorted(least, key=least.get))}
    named = F.element_at(F.create_map(*[F.lit(v) for c, i in number.items() for v in (c, i)]), F.col("__c"))
    return out.select(id_col, named.cast("bigint").alias("cluster_id"))
