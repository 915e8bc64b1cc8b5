import binascii
import math
import re
from collections import Counter

from pointweave.llm.brown import score


def test_counts_and_probabilities(spark):
    texts = ["the cat Sat", "the dog sat", "a  cat\tran the dog", None, "", "unseen words here zz"] * 6 + ["the cat sat on the mat " * 3000]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(0, texts[0], 0)]
    held = lambda k: binascii.crc32(str(k).encode()) % 7 == 2
    tok = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w] + [None]
    c = Counter(w for k, t, _ in rows if not held(k) for w in tok(t))
    n, v = sum(c.values()), len(c)
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    for share in (4e-6, 1e-3):
        got = score(df, share).collect()
        assert len(got) == len(rows)
        for r in got:
            w = tok(texts[r.doc_id])
            base = sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        assert sum(r.base_score for r in got) < sum(r.score for r in got)  # word order tells more than counts
    assert score(df.where("false")).count() == 0


def test_score_against_brute_force(spark):
    """Class bigrams and shares counted anew from the classes; the objective rises; probabilities sum to one."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from pointweave.llm import brown

    r = random.Random(3)
    near = {a: r.choices("the a cat dog sat ran Élan mat on of zz qq".split(), k=3) for a in "the a cat dog sat ran Élan mat on of zz qq".split()}

    def text():
        w = [r.choice(list(near))]
        while r.random() < 0.95:
            w.append(r.choice(near.get(w[-1], near["the"])) if r.random() < 0.9 else f"rare{r.randrange(300)}")
        return " ".join(w)

    rows = [(k, text() if k % 9 else None) for k in range(300)] + [(7, "the cat"), (7, "the cat"), (None, "a dog")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda k: k is not None and binascii.crc32(str(k).encode()) % 7 == 2
    d = df.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"))
    for words in (1 << 16, 5):
        m = brown.train(d.where(~F.col("held_out")).select("text"), 10, words, 6, 4)
        assert len(m.word) == min(words, len(m.word)) and m.history == sorted(m.history) and len(m.history) > 1
        train = [brown.tokens(t) for k, t in rows if not held(k)]
        numbers = [m.numbers(h) for h in train]
        matrix, count = np.zeros((5, 5)), Counter()
        for n in numbers:
            g = m.group[n]
            np.add.at(matrix, (np.append(4, g[:-1]), g), 1)
            count.update(n.tolist())
        assert (matrix == m.matrix).all() and m.group[-1] == 4
        own = Counter(x for h in train for x in h.tolist())
        kinds = range(len(m.word), len(m.word) + brown.KINDS)
        share = {n: count[n] + (n in kinds) for n in range(len(m.group) - 1)}
        for g in range(4):
            assert math.isclose(sum(10 ** m.emit[n] for n in share if m.group[n] == g), 1) or not any(m.group[n] == g for n in share)
        mass = [sum(share[n] for n in share if m.group[n] == g) for g in range(4)]
        rare = {k: [x for x in own if x != brown.END and int(m.numbers(np.array([x, brown.END]))[0]) == k] for k in kinds}
        got = [(x.doc_id, x.n_tokens, x.score, x.perplexity) for x in brown.scored(d, m).collect()]
        want = []
        for k, t in rows:
            h, total, last = brown.tokens(t), 0.0, 4
            for x, n in zip(h.tolist(), m.numbers(h).tolist()):
                g = int(m.group[n])
                p = (matrix[last, g] + 0.1) / (matrix[last].sum() + 0.5)
                if g < 4:
                    p *= share[n] / mass[g]
                if n in rare:
                    p *= (own[x] + 1) / (sum(own[y] for y in rare[n]) + len(rare[n]) + 1)
                total += math.log10(p)
                last = g
            want.append((k, len(h), total, 10 ** (-total / len(h))))
        for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
            assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9) and math.isclose(a[3], b[3], rel_tol=1e-9)


def test_only_six_blanks_and_ascii_case(spark):
    from pointweave.llm import brown

    a, b = brown.tokens("Éa b\u0085c ABC"), brown.tokens("éa b\u0085c abc")
    assert len(a) == len(b) == 3 and a[0] != b[0] and a[1] == b[1] and a[2] == brown.END
