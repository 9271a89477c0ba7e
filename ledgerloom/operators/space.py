"""Spatial blocks: median splits, exact bounding boxes, and visits of near blocks.

A tree of median splits, fitted on a bounded sample, gives every point a home block. The
bounding boxes, exact over all rows, tell which other blocks a point must visit to meet all
points within its reach. A task cuts its block again, into cells of a fixed size with boxes
of their own: a point is shipped once a block and compared once a cell, so the work of a
visit does not grow with the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: Points of a block aimed at, most points of a cell within it, most blocks of a tree, points of the sample that it is fitted on.
BLOCK, CELL, MOST_BLOCKS, SAMPLE = 8192, 512, 4096, 60_000
#: Distances that a task holds at once.
TILE = 2_000_000


class Tree:
    """Median splits in a complete binary tree; leaf numbers are the blocks."""

    def __init__(self, sample: np.ndarray, rows: int, block: int = BLOCK, most: int = MOST_BLOCKS):
        depth = 0
        while (1 << depth) < min(most, rows / block) and (2 << depth) <= max(1, len(sample)):
            depth += 1
        self.depth = depth
        self.dim, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            part = parts.pop(node)
            if len(part):
                self.dim[node] = d = int(np.argmax(part.max(0) - part.min(0)))
                self.at[node] = np.median(part[:, d])
            right = part[:, self.dim[node]] >= self.at[node]
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]

    def leaf(self, z: np.ndarray) -> np.ndarray:
        node, rows = np.ones(len(z), np.int64), np.arange(len(z))
        for _ in range(self.depth):
            node = 2 * node + (z[rows, self.dim[node]] >= self.at[node])
        return node - (1 << self.depth)


class Cells:
    """The rows of a block in cells of at most ``cell`` rows, by exact median splits, with their bounding boxes."""

    def __init__(self, z: np.ndarray, cell: int | None = None):
        most = cell or CELL
        todo, self.rows = [np.arange(len(z))], []
        while todo:
            rows = todo.pop()
            if len(rows) > most:
                part = z[rows]
                d = int(np.argmax(part.max(0) - part.min(0)))
                order = np.argpartition(part[:, d], len(rows) // 2)
                todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
            elif len(rows):
                self.rows.append(np.sort(rows))
        self.low = np.array([z[r].min(0) for r in self.rows]).reshape(len(self.rows), -1)
        self.high = np.array([z[r].max(0) for r in self.rows]).reshape(len(self.rows), -1)

    def apart(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query from the box of each cell."""
        return box_distances(q, self.low, self.high)


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes; a little small at most, so that a box that a reach touches is met."""
    d2 = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        x = q[:, d : d + 1]
        d2 += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return d2 * (1 - 1e-9)


class Products:
    """Distances from the rows of a cell by one matrix product; those that rounding could decide are summed again by coordinate."""

    def __init__(self, base: np.ndarray):
        self.base, self.squares = base, (base * base).sum(1)

    def near(self, queries: np.ndarray, reach: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query row, base row, distance) of pairs within each query's reach, among them its k nearest of those."""
        n = len(self.base)
        rows = max(1, TILE // n)
        for at in range(0, len(queries), rows):
            q, most = queries[at : at + rows], reach[at : at + rows] ** 2
            own = (q * q).sum(1)[:, None]
            d2 = own + self.squares[None, :] - 2 * (q @ self.base.T)
            off = 1e-12 * (own + self.squares[None, :]) + 1e-300
            if n > k:
                most = np.minimum(most, np.partition(d2 + off, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(d2 - off <= most[:, None] * (1 + 1e-9))
            for s in range(0, len(i), TILE):
                a, b = i[s : s + TILE], j[s : s + TILE]
                yield at + a, b, np.sqrt(((q[a] - self.base[b]) ** 2).sum(1))


def nearest(cells: Cells, screens: list, base_pid: np.ndarray, q: np.ndarray, pid: np.ndarray, reach: np.ndarray, k: int, slack: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, neighbour, distance): of each query the k nearest of a block's rows within its reach, itself left out, by (distance, number).

    ``screens`` has for each cell an object with ``near(queries, reach, k)`` as that of :class:`Products`. A query
    first meets the cell it is nearest to; what it finds there shortens its reach for the others. ``slack`` is what
    rounding may take off a distance.
    """
    apart, reach = cells.apart(q), reach.copy()
    first = apart.argmin(1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(c: int, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j, d in screens[c].near(q[rows], reach[rows], k + 1):  # one more, as a query may be a row itself
            i, p = rows[i], base_pid[cells.rows[c][j]]
            other = pid[i] != p
            yield _least(i[other], p[other], d[other], k)

    for c in range(len(cells.rows)):
        for i, p, d in meet(c, np.nonzero(first == c)[0]):
            found.append((i, p, d))
            full = np.nonzero(np.bincount(i, minlength=len(q)) == k)[0]
            last = np.r_[np.nonzero(np.diff(i))[0], len(i) - 1] if len(i) else np.empty(0, np.int64)
            worst = np.full(len(q), np.inf)
            worst[i[last]] = d[last]
            reach[full] = np.minimum(reach[full], worst[full] + slack)
    limit = (reach * (1 + 1e-9) + slack) ** 2
    for c in range(len(cells.rows)):
        found.extend(meet(c, np.nonzero((apart[:, c] <= limit) & (first != c))[0]))
    i, p, d = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*found)) or [[], [], []]))
    return _least(i, p, d.astype(float), k)


def _least(i: np.ndarray, p: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each i, by (d, p)."""
    order = np.lexsort((p, d, i))
    i, p, d = i[order], p[order], d[order]
    first = np.r_[0, np.nonzero(np.diff(i))[0] + 1] if len(i) else np.empty(0, np.int64)
    keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
    return i[keep], p[keep], d[keep]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.empty((0, 0))


def into_blocks(points: DataFrame, block: int = BLOCK, *, extra: Sequence[str] = ()) -> DataFrame:
    """block, pid, z and the columns ``extra`` of ``points``: spread by home block, sorted by block and pid, and kept."""
    ship(points.sparkSession)
    rows = points.count()
    share = min(1.0, SAMPLE / max(1, rows))
    part = F.shiftrightunsigned(F.xxhash64("pid", F.lit("tree")), 12) / F.lit(float(1 << 52))
    sample = points.where(part < share).select("z").limit(2 * SAMPLE).toPandas()["z"]  # bounded by SAMPLE
    tree = Tree(np.array(sample.tolist()) if len(sample) else np.empty((0, 1)), rows, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.leaf(matrix(b.column(1))) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *b.columns], ["block", "pid", "z", *extra])

    kinds = "".join(f", {c} {points.schema[c].dataType.simpleString()}" for c in extra)
    return cut(points.select("pid", "z", *extra).mapInArrow(run, f"block int, pid bigint, z array<double>{kinds}").repartition("block").sortWithinPartitions("block", "pid"))


def boxes(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block numbers, lower corners, upper corners), exact over all rows; MOST_BLOCKS rows at most."""
    width = blocks.select(F.size("z").alias("w")).limit(1).collect()
    if not width:
        return np.empty(0, np.int64), np.empty((0, 1)), np.empty((0, 1))
    z = [F.col("z")[i] for i in range(width[0].w)]
    got = blocks.groupBy("block").agg(F.array(*map(F.min, z)).alias("low"), F.array(*map(F.max, z)).alias("high")).collect()
    return np.array([r.block for r in got]), np.array([r.low for r in got]), np.array([r.high for r in got])


def with_visitors(blocks: DataFrame, reach: float | str, extra: list[str] | None = None, visits: int | None = None) -> DataFrame:
    """block, role, pid, z and the columns ``extra``: each row at home (role 0) and in every other block within its reach (role 1).

    ``reach`` is a distance, or a column with one for each row. With ``visits`` a row goes to at most so many other blocks,
    those whose boxes are nearest. Spread by block, sorted by block and role.
    """
    extra = list(extra or [])
    own = reach if isinstance(reach, str) else None
    carried = extra + ([own] if own and own not in extra else [])
    numbers, low, high = boxes(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            home, z = np.asarray(b.column(0)), matrix(b.column(2))
            limit = (np.asarray(b.column(3 + carried.index(own))) if own else np.full(len(z), float(reach))) + 1e-6
            step = max(1, TILE // max(1, len(numbers)))
            rows, where = [np.arange(len(z))], [home]
            for at in range(0, len(z), step):
                apart = box_distances(z[at : at + step], low, high)
                near = apart <= (limit[at : at + step] ** 2)[:, None]
                if visits is not None and visits + 1 < len(numbers):
                    far = np.argpartition(apart, visits + 1, axis=1)[:, visits + 1 :]  # the home block is at distance 0
                    np.put_along_axis(near, far, False, axis=1)
                r, k = np.nonzero(near)
                other = numbers[k] != home[at + r]
                rows.append(at + r[other])
                where.append(numbers[k[other]])
            take = pa.array(np.concatenate(rows))
            role = np.r_[np.zeros(len(z), np.int32), np.ones(len(take) - len(z), np.int32)]
            kept = [b.column(i).take(take) for i in range(1, 3 + len(extra))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(where).astype(np.int32)), pa.array(role), *kept], ["block", "role", "pid", "z", *extra])

    kinds = "".join(f", {c} {blocks.schema[c].dataType.simpleString()}" for c in extra)
    spread = blocks.select("block", "pid", "z", *carried).mapInArrow(run, f"block int, role int, pid bigint, z array<double>{kinds}")
    return spread.repartition("block").sortWithinPartitions("block", "role", "pid")


def by_block(batches: Iterator[pa.RecordBatch], start: Callable, visit: Callable) -> Iterator[pa.RecordBatch]:
    """Walks rows sorted by (block, role): ``start(rows)`` gets a block's own rows and gives its state and outputs, ``visit(state, rows)`` each batch of visitors.

    Only a block's own rows are held; visitors stream past them.
    """
    block, own, state = None, [], None

    def begin() -> Iterator[pa.RecordBatch]:
        nonlocal state, own
        if own:
            state, out = start(pa.Table.from_batches(own).combine_chunks().to_batches()[0])
            own = []
            yield from out

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(0)).astype(np.int64) * 2 + np.asarray(b.column(1))
        edges = np.r_[0, np.nonzero(np.diff(keys))[0] + 1, len(keys)]
        for a, z in zip(edges[:-1], edges[1:]):
            part, (blk, role) = b.slice(a, z - a), divmod(int(keys[a]), 2)
            if blk != block:
                yield from begin()
                block, state = blk, None
            if role == 0:
                own.append(part)
            else:
                yield from begin()
                yield from visit(state, part)
    yield from begin()
