import zlib

import numpy as np
from tokenizers import Tokenizer

from pointweave.llm.packing import fill, pack_documents
from pointweave.llm.tokens import count_tokens, vocabulary

TEXTS = [None, "", "a", "aaaaaaa bb", "Éauouon le <|endoftext|> x  \n\n y", "don't 123 $$$%%%  ", "é" * 300, "to be or not " * 900, "to be or not " * 900]


def frame(spark):
    return spark.createDataFrame([(k, t, k) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")


def test_counts_equal_the_library(spark):
    lib = Tokenizer.from_file(vocabulary())
    got = {r.doc_id: r for r in count_tokens(frame(spark), vocabulary()).collect()}
    for k, t in enumerate(TEXTS):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 1024)


def test_no_rows(spark):
    assert count_tokens(frame(spark).where("false"), vocabulary()).count() == 0
    assert pack_documents(frame(spark).where("false"), vocabulary()).count() == 0


def test_packing_round_trip(spark):
    lib = Tokenizer.from_file(vocabulary())
    rows = pack_documents(frame(spark), vocabulary()).collect()
    bins, docs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for k, t in enumerate(TEXTS):
        ids, at = lib.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(docs[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_fill_keeps_every_limit():
    v = np.array([[10, 1, 0, 50], [3, 1, 3, 40], [100, 1, 90, 7]])
    limits = np.array([128, 9, 100])
    bins = fill(v, limits)
    assert all((sum(v[k, :3] * n for k, n in b) <= limits).all() for b in bins)
    assert [sum(n for b in bins for k, n in b if k == j) for j in range(3)] == [50, 40, 7]
