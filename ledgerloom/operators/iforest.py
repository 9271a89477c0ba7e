"""Anomaly scores by an extended isolation forest (Hariri, Carrasco Kind and Brunner 2019).

Trees split by random hyperplanes with two non-zero coordinates. They grow on a bounded
sample that is ranked by a hash of the key, so the result does not depend on how rows are
partitioned. Scoring is one narrow pass over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import reaches
from ..session import ship, spread
from ..types import ScalingMethod
from .scaling import scale
from .validate import validate_dims, validate_features, validate_threshold

TREES, SAMPLE = 100, 256


def average_path(n: float) -> float:
    """Average path length of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


class Forest:
    """Trees as flat arrays: two coordinates with weights and a threshold for each node, children (leaves are their own), path lengths."""

    def __init__(self, x: np.ndarray, seed: int, trees: int = TREES, sample: int = SAMPLE):
        self.size = min(len(x), sample)
        self.depth = max(1, math.ceil(math.log2(max(2, self.size))))
        self.trees = [self._grow(x, np.random.default_rng([seed, b])) for b in range(trees)]
        self.scale = average_path(self.size) or 1.0

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        x = x[np.sort(rng.permutation(len(x))[: self.size])]
        dims, weights, at, child, path = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            me = len(at)
            dims.append((0, 0))
            weights.append((0.0, 0.0))
            at.append(0.0)
            child.append((me, me))
            path.append(depth + average_path(len(rows)))
            part = x[rows]
            low, high = (part.min(0), part.max(0)) if len(part) else (0, 0)
            if depth >= self.depth or len(rows) <= 1 or not np.any(high > low):
                return me
            first = int(rng.integers(x.shape[1]))
            second = int(rng.integers(x.shape[1] - 1))
            d = [first, second + (second >= first)]
            w = rng.standard_normal(2)
            threshold = float((rng.uniform(low[d], high[d]) * w).sum())
            left = part[:, d] @ w <= threshold
            dims[me], weights[me], at[me] = tuple(d), tuple(w), threshold
            child[me] = (node(rows[left], depth + 1), node(rows[~left], depth + 1))
            return me

        node(np.arange(len(x)), 0)
        d, w = np.array(dims, np.int64).T.copy(), np.array(weights).T.copy()
        return d[0], d[1], w[0], w[1], np.array(at), np.array(child, np.int64).ravel(), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / average path), in 0..1, higher is more unusual."""
        flat, base, total = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
        for d0, d1, w0, w1, at, child, path in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                p = flat.take(base + d0.take(node)) * w0.take(node)
                p += flat.take(base + d1.take(node)) * w1.take(node)
                node = child.take(2 * node + (p > at.take(node)))
            total += path.take(node)
        return np.exp2(-total / len(self.trees) / self.scale)


def anomalies(df: DataFrame, threshold: float, scaling: ScalingMethod | int | str = ScalingMethod.NONE, id_col: str = "order_id", features: list[str] | None = None, seed: int = 11, validate: bool = True, strict_dims: bool = False, trees: int = TREES) -> DataFrame:
    """order_id, abnormal_score, is_abnormal of every row; a row is abnormal if its score reaches the threshold.

    Features must be free of nulls, NaN and infinities unless ``validate`` is off (then such a row's score may be
    anything, and NaN scores aren't abnormal). Repeated rows get the same score.
    """
    validate_threshold(threshold)
    features = features or [c for c in df.columns if c != id_col]
    validate_dims(len(features), strict_dims)
    ship(df.sparkSession)
    rows = validate_features(df, features) if validate else df.count()
    scaled = scale(spread(df).select(F.col(id_col).alias("order_id"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]), [f"f{i}" for i in range(len(features))], scaling)
    names = [f"f{i}" for i in range(len(features))]
    wanted = trees * SAMPLE
    ranked = scaled.withColumn("rank", F.shiftrightunsigned(F.xxhash64("order_id", *names, F.lit(seed)), 12) / F.lit(float(1 << 52)))

    def lowest(of: DataFrame) -> np.ndarray:
        return of.orderBy("rank", "order_id", *names).limit(wanted).select(*names).toPandas().to_numpy(float)

    # few rows from each partition have the lowest ranks; where copies share ranks, these few may be too few
    sample = lowest(ranked.where(F.col("rank") < 2.0 * wanted / max(1, rows)))
    if len(sample) < min(wanted, rows):
        sample = lowest(ranked)
    if not len(sample):
        return scaled.select("order_id", F.lit(0.0).alias("abnormal_score"), F.lit(False).alias("is_abnormal"))
    forest = Forest(sample, seed, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))]) if b.num_rows else np.empty((0, len(names)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.score(x))], ["order_id", "abnormal_score"])

    kind = scaled.schema["order_id"].dataType.simpleString()
    out = scaled.mapInArrow(run, f"order_id {kind}, abnormal_score double")
    return out.withColumn("is_abnormal", reaches(F.col("abnormal_score"), threshold))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """One row: least, greatest and mean score, number and percent of abnormal rows."""
    return scored.agg(
        F.count("*").alias("rows"),
        F.min("abnormal_score").alias("min_score"),
        F.max("abnormal_score").alias("max_score"),
        F.avg("abnormal_score").alias("avg_score"),
        F.count_if("is_abnormal").alias("anomalies"),
        (F.lit(100.0) * F.count_if("is_abnormal") / F.greatest(F.count("*"), F.lit(1))).alias("percent"),
    )
