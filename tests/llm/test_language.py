import binascii

import numpy as np

from pointweave.llm import language


def rows():
    r = np.random.default_rng(1)
    words = {"en": "the and of with that this over street".split(), "de": "der und von mit dass diese über straße".split()}
    out = []
    for k in range(120):
        lang = ("en", "de")[k % 2]
        out.append((k, " ".join(r.choice(words[lang], 12)), lang))
    return [*out, (900, None, "en"), (901, "", "de"), (902, "123 $$", "en"), (902, "123 $$", None), (903, "the und " * 30000, None)]


def test_held_out_and_undetermined(spark):
    d = spark.createDataFrame(rows(), "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    got = language.op7_language_id.__globals__["identify"](d, language.fit(d)).collect()
    assert len(got) == len(rows())
    want = {k: lang for k, _, lang in rows() if k < 120}
    for r in got:
        assert r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id in want:
            assert r.lang_pred == want[r.doc_id]
        elif r.doc_id < 903:
            assert (r.lang_pred, r.score) == ("und", 0)


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(d, language.fit(d)).collect()] == ["und"]
    assert language.identify(d.where("false"), language.fit(d)).count() == 0


def test_kernel_equals_sets():
    texts = [b"abcabc", b"abd", b"zz"]
    f = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    k = language.Kernel(texts)
    for got in (k.rows(texts), k.rows(texts, 2)):
        want = [[len(f(a) & f(b)) / (len(f(a)) * len(f(b))) ** 0.5 for b in texts] for a in texts]
        assert np.allclose(got, want, atol=1e-6)


def test_long_texts_are_learned(spark):
    words = {"en": "the and of with that this over street", "de": "der und von mit dass diese über straße"}
    d = spark.createDataFrame([(k, f"{words[lang]} " * 600, lang) for k, lang in enumerate(["en", "de"] * 20)], "doc_id long, text string, lang string")
    assert d.where("length(text) <= 20000").count() == 0
    model = language.fit(d)
    assert model.langs == ["de", "en"]
    assert all(r.lang_pred == ("en", "de")[r.doc_id % 2] for r in language.identify(d, model).collect())


def test_documents_stay_if_nothing_is_learned(spark):
    d = spark.createDataFrame([(1, "some text", None), (2, "12 $", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in language.with_language(d, language.fit(d)).collect()] == [1]
