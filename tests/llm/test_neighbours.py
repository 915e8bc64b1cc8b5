import numpy as np

from pointweave.llm.neighbours import nearest


def test_recall_scores_and_edges(spark):
    r = np.random.default_rng(3)
    x = (r.standard_normal((1500, 16)) * r.uniform(0.5, 2, (1500, 1))).astype(np.float32).astype(float)
    x[40:70] = x[40]  # copies
    rows = [(k, v.tolist(), 1.0) for k, v in enumerate(x)] + [(3000, None, 1.0), (3020, [0.0] * 16, 1.0), (3040, [None] * 16, 1.0), (3060, [float("nan")] * 16, 1.0), (3080, [1.0], 1.0)]
    df = spark.createDataFrame(rows + [rows[7]], "vec_id long, embedding array<float>, score double")
    got = {}
    for leaf in (100, 8192):
        for q in nearest(df, leaf=leaf).collect():
            got.setdefault((leaf, q.query_id), []).append(q)
        hit = 0
        for k in range(0, 1500, 20):
            s = x @ x[k]
            s[k] = -np.inf
            best = sorted(range(1500), key=lambda i: (-round(s[i], 9), i))[:20]
            mine = sorted(got[leaf, k], key=lambda q: q.rank)
            assert [q.rank for q in mine] == list(range(1, 21))
            assert all(abs(q.score - s[q.vec_id]) < 1e-9 for q in mine)
            hit += len({q.vec_id for q in mine} & set(best))
            if k == 60:
                assert {q.vec_id for q in mine} == set(best)
            if leaf > 1500:
                assert [q.vec_id for q in mine] == best
        assert hit / 1500 > 0.9
    assert {q for _, q in got} == set(range(0, 1500, 20))
    assert nearest(df.where("false")).count() == 0
    assert [q.vec_id for q in nearest(df.where("vec_id in (0, 1)")).collect()] == [1]


def test_strings_that_no_bit_tells_apart_are_split(spark):
    """Near copies in the thousands, in one direction: nodes stay bounded or are met in parts; nothing is lost."""
    r = np.random.default_rng(5)
    x = np.vstack((np.outer(1 + np.arange(600) / 1e6, np.ones(8)), r.standard_normal((200, 8))))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, leaf=50, target=1.0, probed=40).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hit = sum(q.vec_id in set(np.argsort(-s[q.query_id], kind="stable")[:20]) for q in got)
    assert len(got) == 40 * 20 and hit > 0.95 * len(got)


def test_trie_levels_and_routes():
    from pointweave.llm.neighbours import Forest, Tree

    r = np.random.default_rng(2)
    x = r.standard_normal((700, 12))
    x[200:260] = x[200]  # no symbol tells these apart
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:9]
    f = Forest(x, 2, 4)
    for t in range(2):
        z = x @ f.turn[t]
        s = f.strings(x, t)
        for n in (0, 5, 210):  # a string lists the axes from the longest on
            axis = np.argsort(-np.abs(z[n]))[: f.symbols]
            assert [int(f.symbol(s[n], k)) for k in range(f.symbols)] == [2 * a + (z[n, a] < 0) for a in axis]
        block = np.searchsorted(f.edges[t], s, "right")
        routed = f.routes(f.signed(q, t), t, 0.25)
        for b in np.unique(block):
            m = np.flatnonzero(block == b)
            tree = Tree(f, t, s[m], m, x[m], 3)
            assert tree.size.sum() == len(m) and ((tree.size <= 3) | (tree.node_depth == f.symbols)).all()
            for i, c in tree.candidates(q, 0.25):
                want = set()
                for at, size, d in zip(tree.begin, tree.size, tree.node_depth):
                    w = f.weight[:d]
                    sym = [int(f.symbol(tree.strings[at], k)) for k in range(d)]
                    level = sum(w[k] * f.signed(q, t)[i, sym[k]] for k in range(d)) / np.sqrt((w**2).sum())
                    assert abs(level - 0.25) > 1e-6
                    if level >= 0.25:
                        want |= set(range(at, at + size))
                assert set(c.tolist()) == want
                assert routed[i, b] or not want  # a block that a query skips holds nothing for it


def test_a_share_of_all_vectors_is_scored(spark):
    """The forest decides at every size: below one node's worth, below one block, over several blocks."""
    r = np.random.default_rng(4)
    for n, block in ((30, 1 << 16), (3000, 1 << 16), (3000, 700)):
        centre = r.standard_normal((40, 24))
        x = centre[np.arange(n) % 40] + 0.3 * r.standard_normal((n, 24))
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        got = nearest(df, block=block).collect()
        hit = sum(q.vec_id in set(np.argsort(-s[q.query_id], kind="stable")[:20]) for q in got)
        asked = len(range(0, n, 20))
        assert len(got) == 20 * asked and hit >= 0.9 * len(got)
        if n == 3000:
            scored = nearest(df, block=block, effort=True).toPandas().scored
            assert scored.mean() < 0.4 * n, scored.mean()
