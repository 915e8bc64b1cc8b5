import numpy as np
import xxhash

from pointweave.llm import simhash


def brute(text):
    w = (text or "").lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [None, "", "One", "a b", "a B c d", "x y z " * 500]:
        assert simhash.fingerprint(t) == brute(t) == simhash.fingerprint(t, 7)


def close(fps, pairs):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {f: root(f) for f in fps}


def test_links_find_all_within_two_bits(spark):
    r = np.random.default_rng(5)
    fps = set(r.integers(-(2**63), 2**63, 60).tolist())
    for f in list(fps):
        for n in r.integers(1, 5, 6):
            fps.add(int(np.uint64(f & (2**64 - 1)) ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, n, False).astype(np.uint64)).astype(np.uint64)) - 0)
    fps = sorted({int(np.array(f & (2**64 - 1), np.uint64).view(np.int64)) for f in fps})
    want = close(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for cap in (simhash.CAP, 2):
        got = [(x.a, x.b) for x in simhash.links(df, cap).collect()]
        assert close(fps, got) == want


def test_rows_and_components(spark):
    t = [(5, "a b c d e"), (3, "a b c d e"), (9, None), (2, ""), (2, ""), (7, "q r s t u v")]
    d = spark.createDataFrame([(*x, "z") for x in t], "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(d).collect())
    f = lambda x: f"{brute(x):016x}"
    assert got == [(2, "0" * 16, 2), (2, "0" * 16, 2), (3, f("a b c d e"), 3), (5, f("a b c d e"), 3), (7, f("q r s t u v"), 7), (9, "0" * 16, 2)]
    assert simhash.near_duplicates(d.where("false")).count() == 0
