import numpy as np
import pytest

from pointweave.operators import components as comp
from pointweave.operators import proximity


def groups(n, edges):
    root = list(range(n))

    def up(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return [up(x) for x in range(n)]


def test_components_of_chains_hubs_and_random_links(spark):
    r = np.random.default_rng(1)
    order = r.permutation(10_000)
    chain = list(zip(order[:-1].tolist(), order[1:].tolist()))
    hub = [(20_000, 20_001 + k) for k in range(3000)]
    some = [tuple(x) for x in r.integers(30_000, 32_000, (1500, 2)).tolist()]
    edges = chain + hub + some + [(7, 7), chain[0], chain[0]]
    root = groups(32_000, edges)
    want = {x: root[x] for e in edges for x in e if root[x] != x}
    df = spark.createDataFrame(edges, "a long, b long")
    for last in (comp.LAST, 0):
        got = {x.node: x.root for x in comp.components(df.repartition(16), last=last).collect()}
        assert {k: v for k, v in got.items() if k != v} == want
    before, comp.HELD = comp.HELD, 50  # a part that is worked through a little at a time
    try:
        got = {x.node: x.root for x in comp.components(df, last=0).collect()}
    finally:
        comp.HELD = before
    assert {k: v for k, v in got.items() if k != v} == want
    assert comp.components(df.where("false")).count() == 0


def test_numbers_without_one_task(spark):
    keys = spark.createDataFrame([(x,) for x in np.random.default_rng(2).permutation(5000).tolist()], "k long")
    got = {r.k: r.n for r in comp.numbered(keys.repartition(9), "k", "n").collect()}
    assert got == {k: k for k in range(5000)}
    assert comp.numbered(keys.where("false"), "k", "n").count() == 0


def cloud(spark, x):
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "pid long, x double, y double, z double")


def test_pairs_and_neighbours_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = np.vstack((r.random((150, 3)) * 10, r.random((5, 3)) * 1000, np.full((4, 3), 2.5)))
    d2 = ((x[:, None] - x) ** 2).sum(2)
    df = cloud(spark, x)
    bad = spark.createDataFrame([(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0), (902, float("inf"), 1.0, 1.0)], df.schema)
    full = df.union(bad)
    got = {(p.a, p.b) for p in proximity.radius_pairs(full, 1.5).collect()}
    assert got == {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if d2[a, b] <= 2.25}
    assert proximity.radius_pairs(full, 1.5).count() == len(got)
    for k, others, first in ((4, True, None), (3, False, 0.01), (500, True, None)):
        near = proximity.knn_join(full, full, k, first, others).collect()
        by = {}
        for n in near:
            by.setdefault(n.qid, []).append((n.rank, n.pid, n.d2))
        assert set(by) == set(range(len(x)))
        for q, rows in by.items():
            want = sorted((d2[q, p], p) for p in range(len(x)) if not (others and p == q))[:k]
            rows.sort()
            assert [p for _, p, _ in rows] == [p for _, p in want] and np.allclose([d for *_, d in rows], [d for d, _ in want])
    assert proximity.knn_join(full, full.where("pid >= 900"), 3).count() == 0
    assert proximity.knn_join(df.where("pid = 3"), df.where("pid = 3"), 2).count() == 1


@pytest.mark.parametrize("size", [400])
def test_clusters_against_brute_force(spark, size):
    r = np.random.default_rng(4)
    x = r.random((size, 3)) * 12
    x[:60] = np.outer(np.arange(60), [0.9, 0, 0]) + [0, 40, 0]  # a chain
    d2 = ((x[:, None] - x) ** 2).sum(2)
    df = cloud(spark, x).repartition(7)
    root = groups(size, [(a, b) for a in range(size) for b in range(size) if a < b and d2[a, b] <= 1])
    for least in (1, 3):
        ok = sorted({v for v in root if root.count(v) >= least})
        got = {p.pid: p.label for p in proximity.euclidean_clusters(df, 1.0, least).collect()}
        assert got == {k: ok.index(v) if v in ok else -1 for k, v in enumerate(root)}
    near = [np.flatnonzero(d2[k] <= 1.44) for k in range(size)]
    core = [len(n) >= 5 for n in near]
    root = groups(size, [(a, b) for a in range(size) for b in near[a] if core[a] and core[b]])
    ok = sorted({root[k] for k in range(size) if core[k]})
    label = {k: ok.index(root[k]) for k in range(size) if core[k]}
    want = {k: label[k] if core[k] else min((label[n] for n in near[k] if core[n]), default=-1) for k in range(size)}
    assert {p.pid: p.label for p in proximity.dbscan(df, 1.2, 5).collect()} == want
    assert -1 in want.values() and len(ok) > 2
