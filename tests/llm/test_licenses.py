import re

from pointweave.llm import licenses


def test_against_brute_force(spark):
    texts = [None, "", "MIT License", "x\nReleased under the MIT license.\ny cc by cc by", "GNU general, public license é", "licensed under the apache license version 3 0", "this work licensed under gnu general public license version 3 0", "a b " * 50000 + "mit license", "Mit LicenseX mit\nlicense"]
    rows = [(k, t, "q") for k, t in enumerate(texts)] + [(2, texts[2], "q")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for r in got:
        w = word.findall(low(texts[r.doc_id]))
        at = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        base = {x for _, x in at}
        best, labels = 0.0, set(base)
        for line in low(texts[r.doc_id]).split("\n"):
            b = set(word.findall(line))
            for label, t, *_ in licenses.TEMPLATES:
                s = set(word.findall(low(t)))
                if len(b & s) / len(s) >= licenses.THRESHOLD:
                    labels.add(label)
                    best = max(best, len(b & s) / len(s))
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(labels)))
        assert abs(r.score - best) < 1e-12
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = licenses.TEMPLATES[7][1]


def test_notices_over_line_ends(spark):
    """Windows over line ends against brute force: every run of words of the allowed width."""
    wrap = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    grant, bsd, mpl = (licenses.TEMPLATES[k][1] for k in (4, 5, 6))
    texts = [wrap(grant, 9), f"x y z\n{wrap(bsd, 5)}\nmore", wrap(mpl, 4).replace("Form", "thing"), wrap(MIT, 11), "// " + wrap(MIT, 8).replace("\n", "\n// "), "released under the great\nlicense", "released under the\nMIT license", "RELEASED\nnot\nnot\nnot\nunder the mit license", grant[:60], "", None, " ".join(["Permission", "granted"] * 40) + wrap(grant, 3), "licensed under cc\nby nc 4 0 and cc by nc"]
    r = __import__("random").Random(1)
    words = " ".join(t for _, t, _ in licenses.TEMPLATES[:7]).split()
    texts += ["\n".join(" ".join(r.choices(words, k=r.randrange(1, 9))) for _ in range(12)) for _ in range(60)]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for k, t in enumerate(texts):
        low = (t or "").lower()
        w = word.findall(low)
        labels, best = set(), 0.0
        for label, text, key in licenses.TEMPLATES:
            all_words = word.findall(text.lower())
            of, n = set(all_words), -(-5 * len(all_words) // 4)
            blocks = [set(w[s : s + n]) for s in range(max(1, len(w) - n + 1))] + [set(word.findall(line)) for line in low.split("\n")]
            top = max((len(of & b) / len(of) for b in blocks if set(key.split()) <= b), default=0)
            if top >= licenses.THRESHOLD - 1e-12:
                labels.add(label)
                best = max(best, top)
        base = {label for p, label in licenses.PHRASES if f" {p} " in f" {' '.join(w)} "}
        assert got[k].labels == ",".join(sorted(labels | base)) and abs(got[k].score - best) < 1e-12, t
    assert "mit-grant" in got[0].labels and got[0].score == 1 and "mit-text" in got[3].labels and "mit-text" in got[4].labels
    assert "mit-notice" not in got[5].labels and "mit-notice" in got[6].labels


def test_templates_from_a_table(spark):
    docs = spark.createDataFrame([(1, "ours is\nthe house licence of two"), (2, "nothing")], "doc_id long, text string")
    own = spark.createDataFrame([("house", "the house licence", 1), (None, "x", 2), ("none", None, 3), ("blank", "--", 4)], "label string, text string, n int")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs, own).collect()}
    assert got == {1: ("house", 1.0), 2: ("", 0.0)}
    assert [r.labels for r in licenses.scan(docs, own.where("false")).collect()] == ["", ""]
