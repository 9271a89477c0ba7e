"""Similarity clusters by Markov clustering, and the connected groups they join to.

Vectors within half the link distance of a leader form a ball; all of a ball are linked to
each other; a ball counts as its vectors, with the mean of their weights. The balls and their
links are the similarity graph. Markov clustering alternates squaring of its column-stochastic matrix
(a distributed sparse product of packed columns), inflation and pruning of small entries, until the
matrix is steady; the attractor rows of a column define its cluster.

Groups are the top of a hierarchy of such clusterings: the clusters are the nodes of the next
graph, linked by the weight between them, and are clustered again, until no link joins two of
them. Flow never leaves a connected group, so the top is the connected groups exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.space import Cells, by_block, into_blocks, matrix, with_visitors
from ..session import cut, release, ship, stored
from .vectors import Tiles, classes

#: Inflation power, entries of a column below this are pruned, chaos at which a matrix counts as steady.
INFLATION, PRUNE, STEADY = 2.0, 1e-3, 1e-3
#: Entries of columns that are summed at once.
ENTRIES = 1_000_000
#: A matrix whose sum of squares moves by less than this (of itself) stands still; one that still moves after so many rounds is an error.
STILL, PATIENCE = 1e-9, 200


def _balls(z: np.ndarray, radius: float) -> np.ndarray:
    """Row of the leader of each vector: the first unclaimed one claims all unclaimed within ``radius``."""
    leader = np.full(len(z), -1)
    free = np.arange(len(z))
    while len(free):
        first = free[0]
        near = ((z[free] - z[first]) ** 2).sum(1) <= radius * radius
        near[0] = True
        leader[free[near]] = first
        free = free[~near]
    return leader


def ball_links(points: DataFrame, distance: float, flow: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors: pid, ball, flow; balls: node, n, own; links: a, b, weight, mass with a < b of balls with linked vectors).

    ``points``: pid, z, copies: copies vectors are equal to the point. The weight of two linked vectors is
    exp(-(dist / distance)^2), that of others 0; of two balls, and within one (own), it is the mean over all pairs of
    vectors, their mass is the sum. A vector's flow is what it attracts in the column-stochastic matrix of all vectors' weights, the loops
    included: exact, whatever the balls are. It costs a second search of the links; without ``flow`` it is left out.
    """
    ship(points.sparkSession)
    blocks = into_blocks(points, extra=["copies"])
    release(points)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start(rows: pa.RecordBatch) -> tuple:
            pid, z = np.asarray(rows.column(2)), matrix(rows.column(3))
            ball = np.empty(len(pid), np.int64)
            for r in Cells(z).rows:
                ball[r] = pid[r[_balls(z[r], distance / 2)]]
            return None, [pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), rows.column(4), pa.array(ball)], ["block", "pid", "z", "copies", "ball"])]

        yield from by_block(batches, start, lambda state, rows: iter(()))

    own = blocks.select("block", F.lit(0).alias("role"), "pid", "z", "copies")  # already spread and sorted by block
    balls = cut(own.mapInArrow(lead, "block int, pid bigint, z array<double>, copies double, ball bigint"))
    release(blocks)

    def pulls(vectors: DataFrame) -> DataFrame:
        """pid, ball, copies, other, pull: for each vector and ball the sum of ``share`` times the weight over the ball's vectors."""

        def start(rows: pa.RecordBatch) -> tuple:
            z = matrix(rows.column(3))
            names, code = np.unique(np.asarray(rows.column(4)), return_inverse=True)
            cells = Cells(z)
            state = cells, [Tiles(z[r], distance) for r in cells.rows], names, code, np.asarray(rows.column(6))
            return state, visit(state, rows)

        def visit(state: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            cells, tiles, names, code, share = state
            z = matrix(rows.column(3))
            apart = cells.apart(z)
            for c, r in enumerate(cells.rows):
                near = np.nonzero(apart[:, c] <= (distance + 1e-6) ** 2)[0]
                for i, j, d in tiles[c].near(z[near], distance):
                    if not len(i):  # bincount would give integers
                        continue
                    i, j = near[i], r[j]
                    keys, at = np.unique(i * len(names) + code[j], return_inverse=True)
                    pull = np.bincount(at, share[j] * np.exp(-((d / distance) ** 2)), len(keys))
                    row = pa.array(keys // len(names))
                    yield pa.RecordBatch.from_arrays([rows.column(2).take(row), rows.column(4).take(row), rows.column(5).take(row), pa.array(names[keys % len(names)]), pa.array(pull)], ["pid", "ball", "copies", "other", "pull"])

        return with_visitors(vectors, distance, ["ball", "copies", "share"]).mapInArrow(lambda batches: by_block(batches, start, visit), "pid bigint, ball bigint, copies double, other bigint, pull double")

    first = cut(pulls(balls.withColumn("share", F.col("copies"))))
    own_flow = balls.select("pid", "ball")
    if flow:
        total = first.groupBy("pid").agg(F.sum("pull").alias("total"))
        second = pulls(balls.join(total, "pid").withColumn("share", F.col("copies") / F.col("total")))
        # equal flows are equal whatever the order of their sums
        own_flow = second.groupBy("pid", "ball").agg(F.round(F.sum("pull"), 9).alias("flow"))
    sizes = balls.groupBy("ball").agg(F.sum("copies").alias("n"))
    between = cut(first.where("ball <= other").groupBy("ball", "other").agg(F.sum(F.col("copies") * F.col("pull")).alias("sum")))
    inner = between.where("ball = other").select("ball", "sum")
    nodes = cut(sizes.join(inner, "ball").select(F.col("ball").alias("node"), "n", (F.col("sum") / (F.col("n") * F.col("n"))).alias("own")))
    a, b = nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    links = between.where("ball < other").select(F.col("ball").alias("a"), F.col("other").alias("b"), "sum").join(a, "a").join(b, "b")
    return own_flow, nodes, cut(links.select("a", "b", (F.col("sum") / (F.col("na") * F.col("nb"))).alias("weight"), F.col("sum").alias("mass")))


_COLUMNS = "j bigint, w double, i array<bigint>, n array<double>, v array<double>, chaos double"


def _inflate(power: float, prune: float) -> Callable:
    """Kernel over the parts (j, w, y, i, n, v) of columns, sorted by j: the sum of y * v, raised to a power, pruned and made to sum to 1.

    An entry stands for n equal ones, of the vectors of its row; w is the n of the column's own node. The largest entry
    of a column stays whatever it is. A column's chaos is its greatest entry less the sum of squares, over that entry:
    0 where it has one entry or equal ones. A column has at most 1 / prune entries and as many parts, so what is held is bounded.
    """

    def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        flat = lambda c: np.asarray(t.column(c).combine_chunks().flatten())
        j, lengths = np.asarray(t.column("j")), np.asarray(t.column("i").combine_chunks().value_lengths())
        column = np.cumsum(np.r_[0, j[1:] != j[:-1]])
        begin = np.r_[0, np.nonzero(np.diff(column))[0] + 1]
        of, i, n = np.repeat(column, lengths), flat("i"), flat("n")
        v = flat("v") * np.repeat(np.asarray(t.column("y")), lengths)
        order = np.lexsort((i, of))
        of, i, n, v = of[order], i[order], n[order], v[order]
        new = np.nonzero(np.r_[True, (of[1:] != of[:-1]) | (i[1:] != i[:-1])])[0]
        of, i, n, v = of[new], i[new], n[new], np.add.reduceat(v, new) ** power
        edge = np.r_[0, np.nonzero(np.diff(of))[0] + 1]
        total, most = np.add.reduceat(n * v, edge), np.maximum.reduceat(v, edge)
        stay = (n * v >= prune * total[of]) | (v == most[of])
        of, i, n, v = of[stay], i[stay], n[stay], v[stay]
        edge = np.r_[0, np.nonzero(np.diff(of))[0] + 1]
        kept = np.add.reduceat(n * v, edge)
        v = v / kept[of]
        chaos = 1.0 - np.add.reduceat(n * v * v, edge) / (most / kept)
        ends = pa.array(np.r_[edge, len(of)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (i, n, v)]
        first = pa.array(begin)
        return pa.RecordBatch.from_arrays([pa.array(j[begin]), t.column("w").combine_chunks().take(first), *lists, pa.array(chaos)], ["j", "w", "i", "n", "v", "chaos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            j, entries = np.asarray(batch.column(0)), np.cumsum(np.asarray(batch.column(3).value_lengths()))
            if held and held[-1].column(0)[-1].as_py() != j[0]:
                yield finish(held)
                held = []
            ends, at = np.nonzero(j[1:] != j[:-1])[0] + 1, 0  # the last column may go on in the next batch
            some = entries[ends - 1] // ENTRIES
            for end in ends[np.r_[some[1:] != some[:-1], True][: len(ends)]]:  # columns of about as many entries at once
                yield finish([*held, batch.slice(at, end - at)])
                held, at = [], end
            held.append(batch.slice(at))
        if held:
            yield finish(held)

    return run


def _columns(parts: DataFrame, power: float, prune: float) -> tuple[DataFrame, float, float]:
    """(columns of a stochastic matrix, its greatest chaos, its sum of squares) from the parts (j, w, y, k, i, n, v) of the columns.

    The columns are stored; sums are taken in the order of k.
    """
    columns = parts.repartition("j").sortWithinPartitions("j", "k").select("j", "w", "y", "i", "n", "v").mapInArrow(_inflate(power, prune), _COLUMNS)
    m = stored(columns)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    seen = m.agg(F.max("chaos").alias("chaos"), F.sum(squares).alias("squares")).first()
    return m, seen.chaos or 0.0, seen.squares or 0.0


def steady_matrix(edges: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, steady: float = STEADY, nodes: DataFrame | None = None) -> DataFrame:
    """j, w, i, n, v, chaos: the columns of the graph's flow when expansion and inflation no longer change it.

    Ends when no column's chaos reaches ``steady`` or when the matrix stands still (as that of a ring of equal links does);
    one that does neither within PATIENCE rounds is a RuntimeError. See :func:`markov_clusters` for the arguments.
    """
    ship(edges.sparkSession)
    both = edges.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("weight").alias("v")).unionByName(edges.select(F.col("b").alias("i"), F.col("a").alias("j"), F.col("weight").alias("v")))
    loops = both.groupBy("j").agg(F.max("v").alias("v")).select(F.col("j").alias("i"), "j", "v")
    if nodes is None:
        entries = both.unionByName(loops).withColumns({"n": F.lit(1.0), "w": F.lit(1.0)})
    else:
        of = nodes.select(F.col("node").alias("i"), "n", "own")
        entries = both.join(of.drop("own"), "i").unionByName(loops.drop("v").join(of, "i").withColumnRenamed("own", "v"))
        entries = entries.join(of.select(F.col("i").alias("j"), F.col("n").alias("w")), "j")
    packed = entries.select("j", "w", F.lit(1.0).alias("y"), F.col("i").alias("k"), F.array("i").alias("i"), F.array("n").alias("n"), F.array("v").alias("v"))
    m, _, before = _columns(packed, 1.0, prune)
    for _ in range(PATIENCE):
        # column j of the square: the columns k of its entries, each by its entry
        entry = m.select("j", "w", F.explode(F.arrays_zip("i", "n", "v")).alias("e")).select("j", "w", F.col("e.i").alias("k"), (F.col("e.n") * F.col("e.v")).alias("y"))
        square = entry.join(m.select(F.col("j").alias("k"), "i", "n", "v"), "k")
        replaced = m
        m, chaos, now = _columns(square, inflation, prune)
        release(replaced)
        if chaos < steady or abs(now - before) <= STILL * now:
            return m
        before = now
    raise RuntimeError(f"the flow is not steady after {PATIENCE} rounds")


def _attractors(m: DataFrame) -> DataFrame:
    """node, cluster of each column: attractors that share their flow are one system, named by its least node."""
    most = F.array_max("v")
    strong = m.select(F.col("j").alias("node"), F.transform(F.filter(F.arrays_zip("i", "v"), lambda e: e["v"] >= most / 2), lambda e: e["i"]).alias("strong"))
    named = strong.select("node", F.array_min("strong").alias("cluster"))
    pairs = strong.select("node", F.explode("strong").alias("at"))
    odd = pairs.join(named, "node").join(named.select(F.col("node").alias("at"), F.col("cluster").alias("other")), "at").where("cluster <> other")
    if odd.isEmpty():
        return named
    # columns that share only a part of their attractors
    systems = connected(pairs.select(F.col("at").alias("a"), F.col("node").alias("b")))
    return strong.select("node").join(systems, "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))


def markov_clusters(edges: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, steady: float = STEADY, nodes: DataFrame | None = None) -> DataFrame:
    """node, cluster, drawn: the attractor of each node of the graph, and the flow that the node draws as a row.

    ``edges``: a, b, weight > 0, undirected, each once, no loops. ``nodes``: node, n, own: a node stands for n vectors
    with the same edges, linked to each other by own; the flow is then that of the graph of the vectors. Without it a
    node is one vector, its loop its greatest weight. The rows with the most flow in a node's column are its
    attractors; nodes that share attractors are a cluster. An empty graph has no rows.
    """
    m = steady_matrix(edges, inflation, prune, steady, nodes)
    flow = m.select("w", F.explode(F.arrays_zip("i", "v")).alias("e")).groupBy(F.col("e.i").alias("node")).agg(F.round(F.sum(F.col("w") * F.col("e.v")), 9).alias("drawn"))
    return _attractors(m).join(flow, "node", "left").select("node", "cluster", F.coalesce("drawn", F.lit(0.0)).alias("drawn"))


def cluster_groups(edges: DataFrame, inflation: float = INFLATION, prune: float = PRUNE) -> DataFrame:
    """node, root: the nodes of ``edges`` (a, b, weight; each once) by the top of the hierarchy of Markov clusterings.

    The clusters of a level are the nodes of the next, linked by the sum of the weights between them; the last level has no
    link. Where the flow of a level joins nothing, the next try has half the inflation above 1, so that flow spreads
    farther; a graph that no flow joins is a RuntimeError.
    """
    edges = stored(edges.select("a", "b", "weight"))
    top, power = None, inflation
    while not edges.isEmpty():
        level = stored(markov_clusters(edges, power, prune).select("node", "cluster"))
        r = level.agg(F.count("*").alias("nodes"), F.count_distinct("cluster").alias("clusters")).first()
        if r.clusters == r.nodes:
            power = 1 + (power - 1) / 2
            if power < 1.2:
                raise RuntimeError("the flow of the graph joins no nodes")
            continue
        power = inflation
        up = level.select(F.col("node").alias("root"), "cluster")
        top = level.withColumnRenamed("cluster", "root") if top is None else top.join(up, "root", "left").select("node", F.coalesce("cluster", "root").alias("root"))
        top = stored(top)
        replaced, edges = edges, stored(between(edges, level))
        release(replaced)
    return top if top is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def between(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """a, b, weight: the links (a, b, weight) of nodes as links of their clusters (node, cluster), summed; a < b."""
    a, b = clusters.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), clusters.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    both = edges.join(a, "a").join(b, "b").where("ca <> cb")
    return both.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight"))


def connected(edges: DataFrame) -> DataFrame:
    """node, root of each node of ``edges`` (a, b): the least node connected with it, by alternating stars until they are unchanged."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e)
    before = None
    while True:
        # each node's larger neighbours point at its least neighbour or itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # each node and its smaller neighbours point at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        replaced, e = e, stored(small)
        release(replaced)
        now = tuple(e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def similarity_clusters(vecs: DataFrame, distance: float = 1.0, inflation: float = INFLATION, prune: float = PRUNE, flow: bool = True) -> DataFrame:
    """id, cluster, drawn, flow (if asked for), group_no of each vector (id, z): its Markov cluster and its connected group.

    Two vectors are linked if their distance is at most ``distance``. A vector without links is a cluster and a
    group of its own. Equal vectors are always together. ``drawn`` is what the vector's ball draws as a row of the steady
    matrix, ``flow`` what the vector itself attracts, see :func:`ball_links`. An empty table gives no rows.
    """
    points, members = classes(vecs)
    vectors, nodes, links = ball_links(points, distance, flow)
    found = stored(markov_clusters(links, inflation, prune, nodes=nodes))
    roots = cluster_groups(between(links.select("a", "b", F.col("mass").alias("weight")), found), inflation, prune).select(F.col("node").alias("cluster"), "root")
    named = found.join(roots, "cluster", "left").select(F.col("node").alias("ball"), "cluster", "drawn", F.coalesce("root", "cluster").alias("group_no"))
    kept = ["flow"] if flow else []
    of = vectors.join(named, "ball", "left").select("pid", F.coalesce("cluster", "ball").alias("cluster"), F.coalesce("drawn", F.lit(0.0)).alias("drawn"), *kept, F.coalesce("group_no", "ball").alias("group_no"))
    return members.join(of, "pid").select("id", "cluster", "drawn", *kept, "group_no")


def describe_clusters(clustered: DataFrame, by: str = "cluster", members: int = 3, strength: tuple[str, ...] = ("drawn", "flow")) -> DataFrame:
    """cluster, first_id, size, typical: the size of each cluster and its members with the strongest flow.

    Members rank by ``strength``: first those of the attractors, by what these draw, then by their own flow (ties: the smaller id).
    """
    best = Window.partitionBy(by).orderBy(*[F.desc(c) for c in strength if c in clustered.columns], "id")
    top = clustered.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= members).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]).alias("typical"))
    return clustered.groupBy(by).agg(F.count("*").alias("size"), F.min("id").alias("first_id")).join(top, by).select(F.col(by).alias("cluster"), "first_id", "size", "typical")


def compare_clusters(clustered: DataFrame, labels: DataFrame, id_col: str, label_col: str, by: str = "cluster") -> DataFrame:
    """cluster, label, both, in_cluster, in_label: overlaps of the clusters with an older labelling of the same ids.

    Repeated labels of an id count once each; ids without a label have label null.
    """
    old = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("id is not null").distinct()
    rows = clustered.select("id", F.col(by).alias("cluster"))
    both = rows.join(old, "id", "left").groupBy("cluster", "label").agg(F.count("*").alias("both"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("in_cluster"))
    labelled = old.groupBy("label").agg(F.count("*").alias("in_label"))
    return both.join(sizes, "cluster").join(labelled, "label", "left").select("cluster", "label", "both", "in_cluster", F.coalesce("in_label", F.lit(0)).alias("in_label"))
