import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pointweave.llm import packing
from pointweave.llm.tokens import fast_encoder, merger, vocabulary


def obeys(rows, loss, length, segments, most):
    """Brute force: gapless offsets from 0, all three limits, each piece once."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and len(b) <= segments and sum(loss[r.doc_id, r.start] for r in b) <= most
    return bins


def test_three_limits_bind(spark):
    r = random.Random(1)
    rows = [(k, 0, (n := r.choice([1, 2, 5, 60, r.randrange(1, 128)])), k, n, r.randrange(min(n, 60) + 1) if k % 3 else min(n, 40)) for k in range(3000)]
    df = spark.createDataFrame(rows, packing.PIECE)
    loss = {(x[0], 0): x[5] for x in rows}
    for limits in ((128, 4, 64), (128, 1024, 128), (200, 3, 128), (128, 1024, 64)):
        got = packing.pack(df, *limits, group=700).collect()
        assert sorted(x.doc_id for x in got) == list(range(3000))
        bins = obeys(got, loss, *limits)
        need = max(sum(x[2] for x in rows) / limits[0], len(rows) / limits[1], sum(x[5] for x in rows) / limits[2])
        assert len(bins) < 1.25 * need + 8, limits  # the scarcest limit sets a bound that no packing goes below
    for bad in ((126, 4, 64), (128, 0, 128), (128, 4, 39)):
        with pytest.raises(ValueError):
            packing.pack(df, *bad).collect()


def test_conversations(spark):
    lib = Tokenizer.from_file(vocabulary())
    r = random.Random(4)
    word = lambda n: " ".join(r.choice(["to", "be", "Éa", "12", "plöp"]) for _ in range(n))
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", word(r.randrange(1, 90)), 0) for c in range(60) for t in range(r.randrange(1, 7))]
    turns += [(99, 0, "user", None, 0), (99, 1, "assistant", word(3000), 0), (98, 0, "assistant", "", 1), (98, 0, "assistant", "", 2)]
    got = packing.pack_conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, length int"), vocabulary(), 512, 5, 100).collect()
    ids, bears = {}, {}
    for c, t, role, text, _ in sorted(turns, key=lambda x: (x[0], x[1])):
        own = lib.encode(text or "", add_special_tokens=False).ids + [1]
        ids.setdefault(c, []).extend(own)
        bears.setdefault(c, []).extend([role == "assistant"] * len(own))
    loss, at = {}, {}
    for x in sorted(got, key=lambda x: (x.doc_id, x.start)):
        assert x.start == at.get(x.doc_id, 0)
        at[x.doc_id] = x.start + x.length
        assert x.ids_crc32 == zlib.crc32(np.array(ids[x.doc_id][x.start : at[x.doc_id]], "<u4").tobytes())
        loss[x.doc_id, x.start] = sum(bears[x.doc_id][x.start + 1 : at[x.doc_id]])
    assert at == {c: len(v) for c, v in ids.items()}
    obeys(got, loss, 512, 5, 100)


def test_ids_equal_the_library(spark):
    """Whole texts of the smallest tables, random bytes as text, and runs that take the array merger."""
    lib = Tokenizer.from_file(vocabulary())
    texts = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [x.html or "" for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").limit(40).collect()]
    r = random.Random(3)
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 800), r.randrange(0x3000, 0x3100), 10, 9, 0x1F600])) for _ in range(r.randrange(200))) for _ in range(400)]
    texts += ["a" * 2500, " " * 2500 + "x" * 98000, "<|endoftext|>" * 3, "word " * 21000 + "y" * 2100, "1234567 " * 13000]
    assert fast_encoder(vocabulary()) is not None and any(len(t) > packing.LONG and packing.RUN.search(t) for t in texts)
    m = merger(vocabulary(), "count")
    for t, ids in zip(texts, packing._encoded(vocabulary(), texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert m.counts([t]) == [len(want)]


def test_rows_that_repeat_and_names_that_clash(spark):
    text = "one two three"
    df = spark.createDataFrame([(1, text, 7, 8, 9), (1, text, 7, 8, 9), (None, None, 0, 0, 0)], "doc_id long, text string, start int, length int, offset int")
    got = packing.pack_documents(df, vocabulary()).collect()
    n = len(Tokenizer.from_file(vocabulary()).encode(text).ids) + 1
    assert sorted((str(r.doc_id), r.start, r.length) for r in got) == [("1", 0, n), ("1", 0, n), ("None", 0, 1)]
    obeys(got, {(r.doc_id, r.start): r.length - 1 for r in got}, 2048, 256, 2048)
