"""Standardised vectors of a feature frame, and int8 product tiles of their distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, release

#: Decimals to which distances are rounded.
DECIMALS = 6
#: Pairs of a product tile.
TILE = 2_000_000


def vectors(frame: DataFrame, spec: DataFrame, id_col: str = "order_id") -> DataFrame:
    """id, z: the standardised vectors of the rows whose features are all present and finite.

    ``spec`` names the features, a row each (feature_name, center, scale; it is as long as a vector is wide). Rows
    delivered twice count once; of different vectors with one id the least counts; null ids are left out.
    """
    features = sorted((r.feature_name, r.center, r.scale) for r in spec.select("feature_name", "center", "scale").distinct().limit(10_000).collect())
    if not features:
        raise ValueError("feature_spec is empty")
    if any(not s for _, _, s in features):
        raise ValueError("a feature has scale 0")
    z = F.array(*[(frame[n].cast("double") - F.lit(float(c))) / F.lit(float(s)) for n, c, s in features])
    fine = frame[id_col].isNotNull()
    for n, _, _ in features:
        fine &= frame[n].isNotNull() & ~F.isnan(frame[n].cast("double")) & (F.abs(frame[n].cast("double")) != float("inf"))
    return frame.where(fine).select(frame[id_col].alias("id"), z.alias("z")).groupBy("id").agg(F.min("z").alias("z"))


def classes(vecs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points: pid, z, copies; members: id, pid): equal vectors are one point, numbered in the order of its least id; both kept."""
    vecs = cut(vecs)
    points = vecs.groupBy("z").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("copies"))
    points = cut(points.repartitionByRange("id").sortWithinPartitions("id").withColumn("pid", F.monotonically_increasing_id()).select("pid", "z", "copies"))
    members = cut(vecs.alias("v").join(points.alias("p"), F.col("v.z") == F.col("p.z")).select(F.col("v.id").alias("id"), "pid"))
    release(vecs)
    return points, members


class Tiles:
    """Int8 codes of the vectors of a cell, for product tiles with an error bound."""

    def __init__(self, base: np.ndarray, margin: float | None = None):
        """``margin``: how far from the cell's box a query may lie to have codes of its own; those beyond it are all compared in float."""
        self.base = base
        low, high = base.min(0), base.max(0)
        self.middle, half = (low + high) / 2, float((high - low).max()) / 2
        self.step = max(half + (half if margin is None else margin) + 1e-6, 1e-12) / 127
        self.codes = np.rint((base - self.middle) / self.step).astype(np.int8).astype(np.float32)  # products of bytes are exact in single precision
        self.squares = (self.codes * self.codes).sum(1)
        # each coordinate of both vectors is off by half a step at most
        self.error = np.sqrt(base.shape[1]) * self.step * 1.0001

    def near(self, queries: np.ndarray, reach: np.ndarray | float, k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query row, base row, distance) of all pairs within each query's reach; with ``k`` at least the k nearest of those."""
        n = len(self.base)
        rows = max(1, TILE // n)
        reach = np.broadcast_to(reach, len(queries))
        for at in range(0, len(queries), rows):
            q, most = queries[at : at + rows], reach[at : at + rows]
            c = np.rint((q - self.middle) / self.step)
            beyond = (np.abs(c) > 127).any(1)
            c = np.where(beyond[:, None], 0, c).astype(np.int8).astype(np.float32)
            d2 = (c * c).sum(1)[:, None] + self.squares[None, :] - 2 * (c @ self.codes.T)
            limit = most + 1e-6
            if k is not None and n > k:
                kth = np.sqrt(np.partition(d2, k - 1, axis=1)[:, k - 1].astype(np.float64)) * self.step
                limit = np.where(beyond, limit, np.minimum(limit, kth + self.error + 1e-6))  # also those that tie after rounding
            i, j = np.nonzero((d2 <= (((limit + self.error) / self.step) ** 2 + 1e-3)[:, None]) | beyond[:, None])
            for s in range(0, len(i), TILE):  # survivors in float
                a, b = i[s : s + TILE], j[s : s + TILE]
                d = np.round(np.sqrt(((q[a] - self.base[b]) ** 2).sum(1)), DECIMALS)
                fine = d <= most[a]
                yield at + a[fine], b[fine], d[fine]
