"""Exact k nearest neighbours, and their mean distance as an anomaly score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..session import cut, release
from .space import Cells, Products, by_block, into_blocks, matrix, nearest, with_visitors
from .validate import MAX_FEATURES

#: A reach that has no end; its square is still finite.
ENDLESS = 1e150
#: Neighbours of points: lists in order, as the tasks give them.
_LISTS = "pid bigint, near array<struct<dist:double,nbr:bigint>>"


def lists(q: np.ndarray, p: np.ndarray, d: np.ndarray, n: int) -> pa.ListArray:
    """The neighbours of each of n queries as a list column; rows in order of the query."""
    ends = np.r_[0, np.cumsum(np.bincount(q, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(p, pa.int64())], ["dist", "nbr"]))


def nearest_lists(points: DataFrame, k: int, screen: Callable = Products, radius: float = ENDLESS, slack: float = 1e-12, visits: int | None = None) -> DataFrame:
    """pid, near: the k nearest other points of each point (pid, z) within ``radius``, in order of (distance, pid).

    Spatial blocks bound the work: the home block gives each point an upper bound of its k-th distance, and the point
    then visits only blocks that are nearer than that. Lists of all blocks are merged. This is exact; with ``visits`` a point
    visits at most so many other blocks, which bounds what is shuffled in any dimension and may miss neighbours. ``screen`` makes the object that
    compares queries with a cell's rows, see :func:`space.nearest`.
    """
    blocks = into_blocks(points)

    def start(rows: pa.RecordBatch) -> tuple:
        z = matrix(rows.column(3))
        cells = Cells(z)
        return cells, [screen(z[r]) for r in cells.rows], np.asarray(rows.column(2))

    def at_home(rows: pa.RecordBatch) -> tuple:
        state, z, pid = start(rows), matrix(rows.column(3)), np.asarray(rows.column(2))
        q, p, d = nearest(*state, z, pid, np.full(len(z), radius), k, slack)
        far, held = np.full(len(z), -1.0), np.bincount(q, minlength=len(z))
        np.maximum.at(far, q, d)
        reach = np.where(held >= k, np.minimum(far + slack, radius), radius)
        return None, [pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(reach), lists(q, p, d, len(z))], ["block", "pid", "z", "reach", "near"])]

    def hold(rows: pa.RecordBatch) -> tuple:
        return start(rows), []

    def visit(state: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z, pid = matrix(rows.column(3)), np.asarray(rows.column(2))
        q, p, d = nearest(*state, z, pid, np.asarray(rows.column(4)), k, slack)
        hit = np.unique(q)  # a visit that finds nothing gives no row
        yield pa.RecordBatch.from_arrays([rows.column(2).take(pa.array(hit)), lists(np.searchsorted(hit, q), p, d, len(hit))], ["pid", "near"])

    own = blocks.select("block", F.lit(0).alias("role"), "pid", "z")  # already spread and sorted by block
    home = cut(own.mapInArrow(lambda b: by_block(b, at_home, lambda state, rows: iter(())), f"block int, pid bigint, z array<double>, reach double, {_LISTS.split(', ', 1)[1]}"))
    release(blocks)
    away = with_visitors(home.select("block", "pid", "z", "reach"), "reach", ["reach"], visits).mapInArrow(lambda b: by_block(b, hold, visit), _LISTS)
    every = home.select("pid", "near").unionByName(away)
    return every.groupBy("pid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def knn(df: DataFrame, id_col: str, vector: Column, k: int, visits: int | None = None) -> DataFrame:
    """id, neighbour, distance, nth: the k nearest other rows of each row (ids are unique; ties by id; k is clamped to the rows there are).

    See :func:`nearest_lists` for how the work is bounded, and for ``visits``.
    """
    if k < 1:
        raise ValidationError("k must be at least 1")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("z")).where("id is not null")
    points = cut(rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("pid", F.monotonically_increasing_id()))
    near = nearest_lists(points.select("pid", "z"), k, visits=visits).select("pid", F.posexplode("near").alias("pos", "n"))
    near = near.select("pid", (F.col("pos") + 1).alias("nth"), F.col("n.nbr").alias("nbr"), F.col("n.dist").alias("dist"))
    name = points.select("pid", "id")
    return near.join(name, "pid").join(name.select(F.col("pid").alias("nbr"), F.col("id").alias("neighbour")), "nbr").select("id", "neighbour", F.col("dist").alias("distance"), "nth")


def knn_scores(df: DataFrame, id_col: str, features: list[str], k: int) -> DataFrame:
    """id, score: the mean distance to the k nearest other rows; higher is more unusual."""
    if len(features) > MAX_FEATURES:
        raise ValidationError(f"{len(features)} features, at most {MAX_FEATURES} are supported")
    n = df.count()
    if n == 0:
        raise ValidationError("the feature matrix is empty")
    if n < 2:
        raise ValidationError("at least 2 samples are needed")
    z = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    return knn(df, id_col, z, min(k, n - 1)).groupBy("id").agg(F.avg("distance").alias("score"))
