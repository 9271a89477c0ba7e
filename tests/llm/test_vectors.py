"""Neighbours and clusters of vectors against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import clusters, neighbours, vectors
from ledgerloom.operators import space


def data(seed, groups=12, size=30, noise=80, width=4):
    rng = np.random.default_rng(seed)
    parts = [rng.uniform(-60, 60, width) + rng.normal(size=(rng.integers(2, size), width)) * rng.uniform(0.05, 0.5) for _ in range(groups)]
    x = np.concatenate([*parts, rng.uniform(-60, 60, (noise, width))])
    x = np.r_[x, x[:15], np.repeat(x[:1], 9, axis=0)]  # copies
    return x.round(3)[rng.permutation(len(x))]


def frame(spark, x):
    return spark.createDataFrame([(f"o{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, z array<double>")


def distances(x):
    return np.round(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2)), 6)


@pytest.fixture(params=[(2048, 512), (24, 512), (100, 9)], ids=["one block", "many blocks", "many cells"])
def blocks(request, monkeypatch):
    block, cell = request.param
    monkeypatch.setattr(space.into_blocks, "__defaults__", (block,))
    monkeypatch.setattr(space, "CELL", cell)


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours(spark, blocks, seed):
    x = data(seed)
    got = {r.id: [n.id for n in r.neighbours] for r in neighbours.nearest_vectors(frame(spark, x), 5, 3.0).collect()}
    d = distances(x)
    for i in range(len(x)):
        want = [f"o{j:04d}" for dist, j in sorted((d[i, j], j) for j in range(len(x)) if j != i)[:5] if dist <= 3.0]
        assert got[f"o{i:04d}"] == want


def components(d, limit):
    n, label = len(d), list(range(len(d)))
    for i in range(n):
        todo = [i] if label[i] == i else []
        while todo:
            a = todo.pop()
            for b in np.nonzero(d[a] <= limit)[0]:
                if label[b] > i:
                    label[b] = i
                    todo.append(b)
    return label


@pytest.mark.parametrize("seed", [3, 4])
def test_groups(spark, blocks, seed):
    x = data(seed)
    rows = clusters.similarity_clusters(frame(spark, x), 1.0).collect()
    assert len(rows) == len(x)
    label = components(distances(x), 1.0)
    group, of = {}, {}
    for r in rows:
        i = int(r.id[1:])
        assert group.setdefault(r.group_no, label[i]) == label[i] and of.setdefault(label[i], r.group_no) == r.group_no
    cluster = {}
    for r in rows:  # clusters lie within groups
        assert cluster.setdefault(r.cluster, r.group_no) == r.group_no


def test_chain_is_one_group(spark):
    x = np.array([[0.9 * i, 0.0] for i in range(60)])
    rows = clusters.similarity_clusters(frame(spark, x), 1.0).collect()
    assert len({r.group_no for r in rows}) == 1 and len({r.cluster for r in rows}) > 1


def test_markov_clusters_of_two_cliques(spark):
    edges = [(a, b, 1.0) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(4, 10, 0.1)]
    got = {r.node: r.cluster for r in clusters.markov_clusters(spark.createDataFrame(edges, "a bigint, b bigint, weight double")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]
    assert clusters.markov_clusters(spark.createDataFrame([], "a bigint, b bigint, weight double")).count() == 0


def test_connected(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(40)]
    got = {r.node: r.root for r in clusters.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {v: find(v) for v in parent}


def graph(kind):
    if kind == "ring":
        return [(i, (i + 1) % 14, 1.0) for i in range(14)]
    if kind == "path":
        return [(i, i + 1, 1.0) for i in range(24)]
    if kind == "star":
        return [(0, i, 1.0) for i in range(1, 30)]
    if kind == "grid":
        return [(6 * r + c, 6 * r + c + d, 1.0) for r in range(6) for c in range(6) for d in (1, 6) if (d == 6 and r < 5) or (d == 1 and c < 5)]
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 90, (110, 2)) if p[0] != p[1]}
    return [(a, b, float(w)) for (a, b), w in zip(sorted(pairs), rng.pareto(0.5, len(pairs)) + 0.01)]


@pytest.mark.parametrize("kind", ["ring", "path", "star", "grid", "random"])
def test_hierarchy_joins_what_is_connected(spark, kind):
    edges = [(min(a, b), max(a, b), w) for a, b, w in graph(kind)] + [(500, 501, 1.0), (501, 502, 0.2)]
    got = {r.node: r.root for r in clusters.cluster_groups(spark.createDataFrame(edges, "a bigint, b bigint, weight double")).collect()}
    nodes = sorted({v for e in edges for v in e[:2]})
    d = np.full((len(nodes), len(nodes)), 9.0)
    for a, b, _ in edges:
        d[nodes.index(a), nodes.index(b)] = d[nodes.index(b), nodes.index(a)] = 0.0
    np.fill_diagonal(d, 0.0)
    label = dict(zip(nodes, components(d, 1.0)))
    assert set(got) == set(nodes) and {(a, b): got[a] == got[b] for a in nodes for b in nodes} == {(a, b): label[a] == label[b] for a in nodes for b in nodes}


def test_groups_come_from_the_clusters(spark, monkeypatch):
    """Without the flow there are no groups: a clustering that joins nothing is an error, not another way to the same rows."""
    monkeypatch.setattr(clusters, "markov_clusters", lambda edges, *a, **k: edges.selectExpr("a node").union(edges.selectExpr("b")).distinct().selectExpr("node", "node cluster", "0d drawn"))
    with pytest.raises(RuntimeError, match="joins no nodes"):
        clusters.similarity_clusters(frame(spark, np.array([[0.9 * i, 0.0] for i in range(8)])), 1.0)


def test_an_unsteady_flow_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(clusters, "PATIENCE", 2)
    with pytest.raises(RuntimeError, match="not steady"):
        clusters.steady_matrix(spark.createDataFrame(graph("random"), "a bigint, b bigint, weight double"))


def dense_flow(nodes, edges):
    """The steady matrix by dense products."""
    at = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        m[at[a], at[b]] = m[at[b], at[a]] = w
    np.fill_diagonal(m, m.max(0))
    m /= m.sum(0)
    for _ in range(60):
        m = (m @ m) ** 2
        m[(m < 1e-3 * m.sum(0)) & (m < m.max(0))] = 0
        m /= m.sum(0)
    return m


def test_clusters_are_those_of_the_dense_flow(spark):
    edges = graph("random")
    nodes = sorted({v for e in edges for v in e[:2]})
    m = dense_flow(nodes, edges)
    want = {}
    for j, v in enumerate(nodes):
        want[v] = tuple(np.nonzero(m[:, j] >= m[:, j].max() / 2)[0])
    rows = clusters.markov_clusters(spark.createDataFrame(edges, "a bigint, b bigint, weight double")).collect()
    got = {r.node: r.cluster for r in rows}
    same = {(a, b): bool(set(want[a]) & set(want[b])) for a in nodes for b in nodes}
    assert {(a, b): got[a] == got[b] for a in nodes for b in nodes} == same
    drawn = {r.node: r.drawn for r in rows}
    assert np.allclose([drawn[v] for v in nodes], m.sum(1), atol=1e-2) and sum(drawn.values()) == pytest.approx(len(nodes))


def test_columns_do_not_depend_on_batches(monkeypatch):
    """Columns that go on over batches, and batches cut by their entries, give the same sums."""
    rng = np.random.default_rng(0)
    rows = []
    for j in range(50):
        for _ in range(rng.integers(1, 6)):
            i = sorted(set(rng.integers(0, 30, rng.integers(1, 8)).tolist()))
            rows.append({"j": j, "w": 1.0, "y": float(rng.random()), "i": i, "n": [2.0] * len(i), "v": rng.random(len(i)).tolist()})
    parts = pa.Table.from_pylist(rows)

    def run(batch, entries):
        monkeypatch.setattr(clusters, "ENTRIES", entries)
        return pa.Table.from_batches(list(clusters._inflate(2.0, 1e-3)(iter(parts.to_batches(max_chunksize=batch))))).to_pylist()

    whole = run(10_000, 10**6)
    assert [r["j"] for r in whole] == list(range(50))
    for r in whole:
        assert sum(n * v for n, v in zip(r["n"], r["v"])) == pytest.approx(1.0) and r["chaos"] <= 1
    assert all(run(batch, entries) == whole for batch in (1, 3, 64) for entries in (1, 40, 10**6))


def test_sizes_and_typical_members_of_planted_clusters(spark, blocks):
    """Far apart blobs are the clusters; their typical members are those of the attractors with the most flow of their own."""
    rng = np.random.default_rng(8)
    sizes = [3, 17, 60, 41]
    x = np.concatenate([[30.0 * i, 0, 0] + rng.normal(size=(n, 3)) * 0.14 for i, n in enumerate(sizes)]).round(4)
    label = np.repeat(range(len(sizes)), sizes)
    found = clusters.similarity_clusters(frame(spark, x), 1.0)
    told = {tuple(sorted(r.typical)): (r.size, r.first_id) for r in clusters.describe_clusters(found).collect()}
    w = np.where(distances(x) <= 1.0, np.exp(-(distances(x) ** 2)), 0.0)
    flow = (w / w.sum(0)).sum(1).round(9)
    drawn = {int(r.id[1:]): r.drawn for r in found.collect()}
    for k, n in enumerate(sizes):
        of = np.nonzero(label == k)[0]
        best = sorted(of, key=lambda i: (-drawn[i], -flow[i], i))[:3]
        assert told[tuple(sorted(f"o{i:04d}" for i in best))] == (n, f"o{of[0]:04d}")
        assert max(drawn[i] for i in of) in (0.0, pytest.approx(max(drawn[i] for i in best)))


def test_describe_and_compare(spark):
    rows = [("a", 1, 0.9, 1), ("b", 1, 0.5, 1), ("c", 1, 0.9, 1), ("d", 2, 0.0, 2)]
    c = spark.createDataFrame(rows, "id string, cluster bigint, flow double, group_no bigint")
    told = {r.cluster: (r.size, r.typical) for r in clusters.describe_clusters(c, members=2).collect()}
    assert told == {1: (3, ["a", "c"]), 2: (1, ["d"])}
    old = spark.createDataFrame([("a", 7), ("a", 7), ("b", 7), ("c", 8), ("x", 8), (None, 9)], "order_id string, cluster_id bigint")
    got = {(r.cluster, r.label): (r.both, r.in_cluster, r.in_label) for r in clusters.compare_clusters(c, old, "order_id", "cluster_id").collect()}
    assert got == {(1, 7): (2, 3, 2), (1, 8): (1, 3, 2), (2, None): (1, 1, 0)}


def test_vectors_of_a_frame(spark):
    spec = spark.createDataFrame([("f1", 10.0, 2.0), ("f0", 0.0, 1.0)], "feature_name string, center double, scale double")
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, 12.0, 5), ("a", 1.0, 12.0, 5), ("b", nan, 1.0, 5), ("c", inf, 1.0, 5), ("d", None, 1.0, 5), ("e", -inf, 1.0, 5), (None, 1.0, 1.0, 5), ("f", 3.0, 10.0, 5), ("f", 2.0, 10.0, 5)]
    df = spark.createDataFrame(rows, "order_id string, f0 double, f1 double, z int")
    assert {r.id: r.z for r in vectors.vectors(df, spec).collect()} == {"a": [1.0, 1.0], "f": [2.0, 0.0]}
    none = vectors.vectors(df.limit(0), spec)
    assert neighbours.nearest_vectors(none).count() == 0 and clusters.similarity_clusters(none).count() == 0
    one = vectors.vectors(df.where("order_id = 'a'"), spec)
    assert neighbours.nearest_vectors(one).first().neighbours == [] and clusters.similarity_clusters(one).count() == 1
    with pytest.raises(ValueError):
        vectors.vectors(df, spec.limit(0))


def test_tiles_lose_nothing():
    rng = np.random.default_rng(11)
    for spread in (1e-7, 0.3, 40.0):
        base = rng.normal(size=(400, 10)) * spread
        q = base[:50] + rng.normal(size=(50, 10)) * spread * 0.1
        d = np.round(np.sqrt(((q[:, None] - base[None]) ** 2).sum(2)), 6)
        got = {(int(a), int(b)) for i, j, _ in vectors.Tiles(base, 1.0).near(q, 1.0) for a, b in zip(i, j)}
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 1.0))))
        far = {(int(a), int(b)) for i, j, _ in vectors.Tiles(base, 0.0).near(q * 3, 1.0) for a, b in zip(i, j)}  # queries beyond the codes
        assert far == set(zip(*map(np.ndarray.tolist, np.nonzero(np.round(np.sqrt(((q[:, None] * 3 - base[None]) ** 2).sum(2)), 6) <= 1.0))))
        some = {(int(a), int(b)) for i, j, _ in vectors.Tiles(base, 1.0).near(q, 1.0, 5) for a, b in zip(i, j)}
        for a in range(50):
            assert {(a, b) for _, b in sorted((d[a, b], b) for b in range(400))[:5] if d[a, b] <= 1.0} <= some


def test_flow_is_that_of_the_vectors(spark, blocks):
    """Each vector's flow from its own weights, also within one ball, and the most typical members by it."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(40, 4)) * 0.12, [40.0, 0, 0, 0] + rng.normal(size=(50, 4)) * 0.4, [[90.0, 0, 0, 0]]]).round(3)
    x = np.r_[x, x[:2], x[60:61]]  # copies
    rows = clusters.similarity_clusters(frame(spark, x), 1.0)
    d = distances(x)
    w = np.where(d <= 1.0, np.exp(-d * d), 0.0)
    want = (w / w.sum(0)).sum(1)
    got = {int(r.id[1:]): r for r in rows.collect()}
    assert np.allclose([got[i].flow for i in range(len(x))], want, atol=1e-8)
    assert len({got[i].cluster for i in range(40)}) == 1
    told = {r.cluster: r.typical for r in clusters.describe_clusters(rows).collect()}
    of = got[0].cluster
    assert told[of] == [f"o{i:04d}" for i in sorted((i for i in got if got[i].cluster == of), key=lambda i: (-round(want[i], 9), i))[:3]] != ["o0000", "o0001", "o0002"]


def test_balls_weigh_as_their_vectors(spark):
    """A node of n vectors is clustered as n nodes with the same edges."""
    # node 1 lies between a large and a small node, a little nearer to the small one
    n, own, edges = {0: 30, 1: 1, 2: 2}, 1.0, [(0, 1, 0.5), (1, 2, 0.6)]
    nodes = spark.createDataFrame([(k, float(v), own) for k, v in n.items()], "node bigint, n double, own double")
    got = {r.node: r.cluster for r in clusters.markov_clusters(spark.createDataFrame(edges, "a bigint, b bigint, weight double"), nodes=nodes).collect()}
    first = {0: 0, 1: 30, 2: 31}
    of = [k for k, v in n.items() for _ in range(v)]
    weight = {frozenset(e[:2]): e[2] for e in edges}
    m = np.array([[own if a == b else weight.get(frozenset((a, b)), 0.0) for b in of] for a in of])
    m /= m.sum(0)
    for _ in range(30):
        m = (m @ m) ** 2
        m /= m.sum(0)
    side = {k: of[int(np.argmax(m[:, first[k]]))] for k in n}
    assert {(a, b): got[a] == got[b] for a in n for b in n} == {(a, b): side[a] == side[b] for a in n for b in n}
    assert got[0] == got[1] != got[2]


def test_neighbours_without_a_radius(spark, blocks):
    x = data(6)
    got = {r.id: [(n.id, n.dist) for n in r.neighbours] for r in neighbours.nearest_vectors(frame(spark, x), 5).collect()}
    d = distances(x)
    for i in range(len(x)):
        want = [(f"o{j:04d}", dist) for dist, j in sorted((d[i, j], j) for j in range(len(x)) if j != i)[:5]]
        assert got[f"o{i:04d}"] == want


def test_recall_of_bounded_visits(spark, monkeypatch):
    """In one dense region, where the exact way has vectors visit most blocks, some visits find nine of ten neighbours."""
    monkeypatch.setattr(space.into_blocks, "__defaults__", (128,))
    x = np.random.default_rng(12).normal(size=(4000, 10)).round(4)
    df = frame(spark, x)
    exact = {r.id: {n.id for n in r.neighbours} for r in neighbours.nearest_vectors(df, 5).collect()}
    some = {r.id: {n.id for n in r.neighbours} for r in neighbours.nearest_vectors(df, 5, visits=12).collect()}
    asked = sorted(i for i in exact if int(i[1:]) % 20 == 0)
    d = np.sqrt(((x[::20, None, :] - x[None, :, :]) ** 2).sum(2))
    for row, i in enumerate(asked):
        want = np.argsort(d[row], kind="stable")[1:6]
        assert exact[i] == {f"o{j:04d}" for j in want}
    assert sum(len(some[i] & exact[i]) for i in asked) / (5 * len(asked)) >= 0.9
