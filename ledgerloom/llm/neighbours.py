"""Most similar vectors for every vector: a block matrix join.

Within a cell of a block, products of int8 codes give all distances with a quantisation error
bound; pairs that the bound can't exclude from a vector's k nearest are computed again in
float. The home block gives a vector an upper bound of its k-th distance, with which it
visits only blocks and cells that are nearer; its lists merge to the k nearest overall.
The result is exact: the loss of accuracy is 0. Where that is not needed, the visits of a vector
can be bounded; the tests measure the recall.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.knn import ENDLESS, nearest_lists
from ..session import release, ship
from .vectors import Tiles, classes

#: What rounding to 6 decimals may take off a distance.
ROUNDING = 1e-6


def nearest_points(points: DataFrame, k: int, radius: float | None = None, visits: int | None = None) -> DataFrame:
    """pid, near ARRAY<STRUCT<dist, nbr>>: the k nearest other points of each point (within ``radius``, if there is one); of equal distances the smaller pid is nearer."""
    ship(points.sparkSession)
    screen = Tiles if radius is None else partial(Tiles, margin=float(radius))
    return nearest_lists(points, k, screen, ENDLESS if radius is None else float(radius), ROUNDING, visits)


def nearest_vectors(vecs: DataFrame, k: int = 5, radius: float | None = None, visits: int | None = None) -> DataFrame:
    """id, neighbours ARRAY<STRUCT<dist, id>>: the k nearest other vectors of each, nearest first.

    ``vecs``: id, z as :func:`vectors.vectors` gives them. Of equal distances (rounded to 6 decimals) the smaller
    id is nearer. With a ``radius`` only others within it count, and vectors with fewer than k of them have fewer. Equal vectors are searched once.
    With ``visits`` a vector meets the rows of at most so many blocks beside its own: bounded work, and neighbours may be
    missed. An empty table gives no rows.
    """
    points, members = classes(vecs)
    near = nearest_points(points, k, radius, visits)
    release(points)
    near = near.select("pid", F.explode("near").alias("n")).select("pid", "n.nbr", "n.dist")
    # k + 1 members of a point are enough for anyone's k nearest, also for its own members'
    few = members.withColumn("nth", F.row_number().over(Window.partitionBy("pid").orderBy("id"))).where(F.col("nth") <= k + 1).select("pid", F.col("id").alias("other"))
    own = few.select("pid", F.lit(0.0).alias("dist"), "other")
    others = near.join(few.withColumnRenamed("pid", "nbr"), "nbr").select("pid", "dist", "other")
    best = Window.partitionBy("pid").orderBy("dist", "other")
    best = own.unionByName(others).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = best.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("dist", F.col("other").alias("id")))).alias("near"))
    mine = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return members.join(lists, "pid").select("id", mine.alias("neighbours"))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """id_a, id_b, dist: each pair of which one is among the other's neighbours, once, the smaller id first."""
    p = neighbours.select("id", F.explode("neighbours").alias("n"))
    return p.select(F.least("id", "n.id").alias("id_a"), F.greatest("id", "n.id").alias("id_b"), F.col("n.dist").alias("dist")).distinct()
