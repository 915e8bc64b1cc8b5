from itertools import combinations

from pointweave.llm import decontaminate
from pointweave.llm.common import hashed_words

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_hits(spark):
    w = ITEM.split()
    other = [f"w{k}" for k in range(40)]
    changed = [x if k not in (5, 13) else "other" for k, x in enumerate(w)]
    docs = {1: ITEM, 2: " ".join([*other, *changed, *other]).upper(), 3: " ".join(other), 4: None, 5: "", 6: " ".join([*other, "one two three four five six", *other]), 7: " ".join(w[:9]), 8: " ".join([*(f"x{k}" for k in range(60000)), *w])}
    d = spark.createDataFrame([(k, t, "q") for k, t in docs.items()] + [(1, ITEM, "q")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(10, ITEM), (11, "One two three four five six"), (12, "alpha beta"), (13, None)], "item_id long, text string")
    got = sorted((r.doc_id, tuple(r.item_ids), r.contaminated) for r in decontaminate.contamination(d, b).collect())
    want = {1: (10,), 2: (10,), 6: (11,), 8: (10,)}
    assert got == sorted((k, want.get(k, ()), k in want) for k in [*docs, 1])
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [3, 4, 5, 7]
    assert decontaminate.contamination(d, b.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(d.where("false"), b).count() == 0


def test_every_substitution_the_share_allows(spark):
    for size in range(5, 22):
        item = [f"w{k}" for k in range(size)]
        index = decontaminate.Index([(1, " ".join(item))])
        window = min(size, decontaminate.WINDOW)
        need = next(n for n in range(window) if n >= decontaminate.SHARE * window)
        for places in combinations(range(window), window - need):
            text = " ".join([*"abcdefgh", *(f"x{k}" if k in places else w for k, w in enumerate(item[:window])), *(f"y{k}" for k in range(size - window)), *"ijklmnop"])
            assert index.overlaps(hashed_words(text.encode())[2]), (size, places)
        text = " ".join(["a", *(f"x{k}" if k <= window - need else w for k, w in enumerate(item[:window])), *(f"y{k}" for k in range(size - window)), "b"])
        assert not index.overlaps(hashed_words(text.encode())[2])
    every_fifth = [f"x{k}" if k % 5 == 4 else w for k, w in enumerate(f"w{k}" for k in range(40))]
    d = spark.createDataFrame([(1, " ".join(every_fifth)), (2, "some other text of no item at all")], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(40)))], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.clean(d, b).collect()] == [2]


def test_against_brute_force(spark):
    """Random texts with edited passages: every window of every item against every place of every text."""
    r = __import__("random").Random(3)
    vocab = [f"v{k}" for k in range(30)]
    items = [(k, " ".join(r.choices(vocab, k=r.choice([1, 2, 3, 4, 5, 6, 8, 11, 16, 20, 40])))) for k in range(60)]
    prompt = " ".join(f"p{k}" for k in range(25))
    items += [(100 + k, f"{prompt} {' '.join(r.choices(vocab, k=6))}") for k in range(40)]  # a prompt that many share
    items += [(150, "what is the capital city of france"), (151, "two plus two equals"), (152, "Yes")]
    docs = []
    for k in range(150):
        w = r.choices([f"o{k}" for k in range(50)], k=r.randrange(30))
        t = r.choice(items)[1].split()
        s = r.randrange(len(t)) if r.random() < 0.2 else 0
        t = [x if r.random() > 0.12 else "edit" for x in t[s:]]
        docs.append((k, " ".join([*w, *t, *w[:3]])))
    docs += [(200, "so what is the large city of france then"), (201, "as two plus two EQUALS five"), (202, "yes"), (203, "yes yes"), (None, "two plus two equals"), (204, None), (201, "as two plus two EQUALS five"), (201, "clean")]

    def overlap(text, item):
        a, b = (text or "").lower().split(), item.lower().split()
        n = min(16, len(b))
        if n <= 2:
            return a == b and n > 0
        return any(sum(x == y for x, y in zip(a[p : p + n], b[s : s + n])) >= 0.8 * n - 1e-9 for s in range(len(b) - n + 1) for p in range(len(a) - n + 1))

    d = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, words double")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, tuple(r.item_ids), r.contaminated, r.n_items) for r in decontaminate.contamination(d, b).collect()), key=str)
    want = [(k, tuple(sorted(i for i, x in items if overlap(t, x)))) for k, t in docs]
    assert got == sorted(((k, w, bool(w), len(w)) for k, w in want), key=str)
    kept = [k for (k, _), (_, w) in zip(docs, want) if not w]
    assert sorted((r.doc_id for r in decontaminate.clean(d, b).collect()), key=str) == sorted(kept, key=str)
    assert len(kept) < len(docs) - 40
