import numpy as np

from pointweave.llm import near_copies, simhash


def test_groups_against_brute_force(spark):
    r = np.random.default_rng(3)
    texts = [None, "", "One two", "one TWO ", "one three"]
    for n in (6, 20, 60, 200):
        for _ in range(6):
            base = [f"w{k}" for k in r.integers(0, 5000, n)]
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, 5):
                w = list(base)
                for k in r.integers(0, n, edits):
                    w[k] = f"x{r.integers(0, 99)}"
                texts.append(" ".join(w))
    base = [f"v{k}" for k in range(150)]  # one large group; its members are further from each other than from its base
    for k in range(60):
        texts.append(" ".join(x if j not in (k, 149 - k) else f"y{k}" for j, x in enumerate(base)))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()})
    root = list(range(len(texts)))
    near = [(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for _ in range(len(texts)):
        before = list(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(d).collect()}
    assert got == dict(enumerate(root))
    by_bits = {x.doc_id: x.component_id for x in simhash.near_duplicates(d, similarity=None).collect()}
    assert len(set(by_bits.values())) > len(set(root))


def test_bands_meet():
    r = np.random.default_rng(4)
    missed = 0
    for _ in range(300):
        s = r.integers(0, 2**63, 1000).astype(np.uint64)
        a, b = np.unique(s[:900]), np.unique(np.append(s[:800], s[900:]))
        assert abs(near_copies.jaccard(a, b) - 0.8) < 1e-9
        missed += not set(near_copies.bands(a).tolist()) & set(near_copies.bands(b).tolist())
    assert missed == 0


def test_band_of_texts_alike_by_half(spark):
    """Texts that share half of their words meet in bands without being copies; two of them have a copy each. No pair but
    the links leaves a task, whichever blocks a band has."""
    base, texts = [f"b{k}" for k in range(120)], []
    for k in range(90):
        texts.append(" ".join(base + [f"o{k}-{j}" for j in range(30)]))
    for k in (11, 47):
        w = texts[k].split()
        w[130 + k // 10] = "else"
        texts.append(" ".join(w))
    keys = [near_copies.shingles(t) for t in texts]
    named = spark.createDataFrame([(n, 5, n) for n in range(len(keys))], "key long, band long, root long")
    sets = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in enumerate(keys)], "key long, s binary")
    want = {(a, b) for b in range(len(keys)) for a in range(b) if near_copies.jaccard(keys[a], keys[b]) >= 0.8}
    assert (11, 90) in want and (47, 91) in want
    before = near_copies.BLOCK
    try:
        for near_copies.BLOCK in (before, 20):
            got = near_copies._links_of_bands(named, sets, 0.8).collect()
            assert len(got) == len(want) and {(x.a, x.b) for x in got} == want
    finally:
        near_copies.BLOCK = before


def test_fingerprints_give_candidates(spark):
    """The named method's part: two texts within 2 bits are a pair to verify."""
    words = [f"w{k}" for k in range(400)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "else where"), (4, "ELSE where")], "doc_id long, text string")
    fp = simhash._sketched(d, "doc_id", "text")
    bits = {x.doc_id: x.fp for x in fp.collect()}
    key = {x.doc_id: x.key for x in fp.collect()}
    want = {tuple(sorted((key[1], key[2])))} if bin((bits[1] ^ bits[2]) & (1 << 64) - 1).count("1") <= 2 else set()
    assert want and {tuple(sorted((x.a, x.b))) for x in simhash._near_keys(fp).collect()} == want
