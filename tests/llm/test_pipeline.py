import random
import re

import corpus_pipeline as p
from pointweave.llm import decontaminate, language, simhash


def test_stages_take_effect(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet").limit(10**9)
    kept = docs
    for name, stage in p.STAGES[:3]:
        before = kept
        stage(spark, kept, base).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns
        if name == "language_id":
            gone = language.identify(before, language.fit(before)).where("lang_pred = 'und'").count()
        elif name == "simhash_dedup":
            gone = before.count() - simhash.near_duplicates(before).select("component_id").distinct().count()
            assert gone > 0
        else:
            gone = decontaminate.contamination(before, spark.read.parquet(f"{base}/benchmark.parquet")).where("contaminated").count()
        assert before.count() - kept.count() == gone
    packed = p.run(spark, base)
    assert packed.select("doc_id").distinct().count() == kept.count()


def brute_groups(texts):
    """Least index of each group of texts whose 5-word shingle sets are 0.8 alike."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", low(t)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_against_brute_force_on_hard_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, equal texts with and without ids."""
    r = random.Random(2)
    words = {"en": "the of and thing tion with from this that ing".split(), "de": "der und nicht sch für ein über ich zu ge".split()}
    line = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "s", "x"]) for _ in range(n))
    bench = [(k, line("en", 24)) for k in range(5)] + [(None, "x"), (9, None)]
    rows = [(k, line(lang, r.randrange(6, 60)), lang if k % 7 else None, "s", 1) for k, lang in enumerate(["en", "de"] * 40)]
    long = line("en", 60_000)
    w = rows[3][1].split()
    rows += [(200, None, "en", None, None), (201, "", None, "s", 0), (202, "12 34 !!", "de", "s", 1), (203, long, "en", "s", 1), (204, long, "de", "s", 1)]
    rows += [(205, " ".join([*w, "end"]) if len(w) > 12 else "kurz und gut für", "de", "s", 1), rows[5], rows[5], (None, rows[6][1], "en", "s", 1), (None, "only here and without an id at all", "en", "s", 1), (None, "only here and without an id at all", "en", "s", 1)]
    rows += [(210 + k, f"{line('de', 8)} {b} {line('de', 5)}", "de", "s", 1) for k, (_, b) in enumerate(bench[:5])]
    r.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    kept = p.language_stage(spark, docs, str(tmp_path)).collect()
    lettered = [x for x in rows if x[1] and any(c.isalpha() for c in x[1])]
    assert sorted(map(str, ((x.doc_id, x.text, x.source, x.n_chars) for x in kept))) == sorted(map(str, ((x[0], x[1], x[3], x[4]) for x in lettered)))
    model = {(x.doc_id, x.lang_pred) for x in language.identify(docs, language.fit(docs)).collect()}
    assert all((x.doc_id, x.lang) in model for x in kept) and {x.lang for x in kept} == {"en", "de"}
    only = language.with_language(docs, language.fit(docs), ("de",)).collect()
    assert only and {x.lang for x in only} == {"de"}

    from_there = spark.createDataFrame([tuple(x) for x in rows], schema)
    stay = p.dedup_stage(spark, from_there, str(tmp_path)).collect()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    groups = brute_groups([rows[k][1] for k in order])
    want = sorted(str(rows[order[k]][0]) for k in set(groups))
    assert sorted(str(x.doc_id) for x in stay) == want and p.dedup_stage(spark, from_there, "").columns == docs.columns

    packed = p.run(spark, str(tmp_path))
    ids = sorted({x.doc_id for x in packed.collect()}, key=str)
    bad = set(range(210, 215))
    lettered.sort(key=lambda x: (x[0] is None, x[0] or 0))
    final = {lettered[k][0] for k in set(brute_groups([x[1] for x in lettered]))} - bad
    assert ids == sorted(final, key=str)


def test_no_rows_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fingerprint int, start string, component_id int, key double"
    d = spark.createDataFrame([(1, "some words to keep here", None, "s", 1, 1, "a", 2, 0.5), (2, "some words to keep here", None, "s", 1, 2, "b", 3, 0.5)], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n, frame in (("one", d), ("none", d.where("false"))):
        base = f"{tmp_path}/{n}"
        frame.write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        kept = frame
        for _, stage in p.STAGES[:3]:
            kept = stage(spark, kept, base)
            assert kept.columns == d.columns
        assert [x.doc_id for x in kept.collect()] == ([1] if n == "one" else [])
        assert {x.doc_id for x in p.run(spark, base).collect()} == ({1} if n == "one" else set())
