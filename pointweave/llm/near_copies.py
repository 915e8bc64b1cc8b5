"""Links between texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share a band of min-hashes: 20 bands of 3, so that a pair at 0.8 exactly shares none with a probability of
6e-7. Every candidate is then verified on the two sets themselves."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, hashed_words, mix, record_batch, slices
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 3
#: Of a band with more texts than this not all pairs are made at once.
CAP = 16
#: Texts of a band that one task holds against as many others; bytes of a signature, and the share of them that pairs at
#: the similarity have in common but for 1 in 10 million.
BLOCK, SIGNED, SLACK = 1024, 512, 5.3
_ODD = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, a wordless one has none."""
    h = hashed_words((text or "").encode("utf-8", "surrogatepass"))[2]
    n = min(words, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _ODD[0] + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def key_of(s: np.ndarray) -> int:
    """Names a set of shingles; the empty set is 0."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0


def bands(s: np.ndarray) -> np.ndarray:
    if not len(s):
        return np.zeros(0, np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        least = np.array([((s ^ x) * a).min() for x, a in zip(_ODD[::2], _ODD[1::2])], np.uint64).reshape(ROWS, BANDS)
        for row in least:
            out = mix(out * _ODD[0] + row)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n / (len(a) + len(b) - n)


def signature(s: np.ndarray) -> np.ndarray:
    """A byte of each of SIGNED min-hashes."""
    x = mix(np.arange(10_000, 10_000 + 2 * SIGNED, dtype=np.uint64))
    least = np.full(SIGNED, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 256):
            least = np.minimum(least, ((s[k : k + 256, None] ^ x[:SIGNED]) * (x[SIGNED:] | np.uint64(1))).min(0))
    return (mix(least) & np.uint64(255)).astype(np.uint8)


def _links_of_bands(named: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of texts (key, band, root) of one band and different roots. A band is dealt to blocks of about BLOCK
    texts and two blocks meet in one task, which compares signatures and verifies what may pass on the sets: only links
    leave it. Rows are repeated once for each block of their band."""
    blocks = named.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = named.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("key", "band"), F.col("blocks")))
    each = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.select("band", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "key", "root").join(sets, "key")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    share = similarity - SLACK * (similarity * (1 - similarity) / SIGNED) ** 0.5

    def run(t: pa.Table) -> pa.Table:
        key, root, own = (t[c].to_numpy() for c in ("key", "root", "own"))
        s = [np.frombuffer(x, np.uint64) for x in t["s"].to_pylist()]
        sign, n = np.array([signature(x) for x in s]), np.array(list(map(len, s)))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        right, out = np.flatnonzero(own == j), []
        for x in np.flatnonzero(own == i):
            y = right[(root[right] != root[x]) & (np.minimum(n[right], n[x]) >= (similarity - 1e-9) * np.maximum(n[right], n[x]))]
            y = y[key[y] > key[x]] if i == j else y
            y = y[(sign[y] == sign[x]).mean(1) >= share]
            out += [(min(key[x], key[k]), max(key[x], key[k])) for k in y if jaccard(s[x], s[k]) >= similarity - 1e-12]
        return pa.Table.from_batches([record_batch(schema, list(zip(*out)) if out else [[], []])])

    return each.select("band", "i", "j", "own", "key", "root", "s").groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in slices(batches, 64):
            near = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity - 1e-12 for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist())]
            yield record_batch(schema, [t.column(0), t.column(1)]).filter(pa.array(near, pa.bool_()))

    return cut(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def roots(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, near: DataFrame | None = None) -> DataFrame:
    """(node, root) of the keys that link to others. docs: (id, text); classes: (key, least, bands, n), least being the
    smallest id with that key, n the number of shingles: sets whose sizes differ by more than the similarity lets pass
    are no pair. near: further candidates (a, b). Of a band with many texts two are held against all others first; where
    it then still has several groups, texts of different groups are held against each other by blocks."""
    rep = cut(classes.select("key", "least", "n", F.explode("bands").alias("band")))
    size = cut(rep.groupBy("band").agg(F.count("*").alias("rows"), F.min("key").alias("one"), F.min(F.struct("least", "key"))["key"].alias("two")).where("rows > 1"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in slices(batches, 4096):
            out = [(a["key"], b["key"]) for f in t.column(0).to_pylist() for a, b in combinations(sorted(f, key=lambda x: x["key"]), 2) if min(a["n"], b["n"]) >= (similarity - 1e-9) * max(a["n"], b["n"])]
            yield record_batch(schema, list(zip(*out)) if out else [[], []])

    pairs = rep.join(size.where(F.col("rows") <= CAP).select("band"), "band").groupBy("band").agg(F.collect_list(F.struct("key", "n")).alias("f")).select("f").mapInArrow(run, "a long, b long")
    large = cut(rep.join(size.where(F.col("rows") > CAP).select("band", "one", "two"), "band"))
    for hub in ("one", "two"):
        pairs = pairs.unionByName(large.where(F.col(hub) != F.col("key")).select(F.least(hub, "key").alias("a"), F.greatest(hub, "key").alias("b")))
    if near is not None:
        pairs = pairs.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    pairs = cut(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).unionByName(large.select("key")).distinct()
    ids = classes.select("key", "least").join(wanted, "key").select(F.col("least").alias("i")).distinct()
    both = pa.schema([("key", pa.int64()), ("s", pa.binary())])

    def sets_of(batches):
        for t in slices(batches):
            s = [shingles(x) for x in t.column(0).to_pylist()]
            yield record_batch(both, [np.array([key_of(x) for x in s], np.uint64).view(np.int64), [x.tobytes() for x in s]])

    text = docs.join(ids, docs[docs.columns[0]].cast("long").eqNullSafe(F.col("i")), "left_semi").select(docs.columns[1])
    sets = cut(text.mapInArrow(sets_of, "key long, s binary").join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    links = _verified(pairs, sets, similarity)
    found = cut(components(links))
    if large.isEmpty():
        return found
    named = cut(large.select("key", "band").join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "band", F.coalesce("root", "key").alias("root")))
    mixed = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    named = cut(named.join(mixed, "band"))
    if named.isEmpty():
        return found
    return cut(components(links.unionByName(_links_of_bands(named, sets, similarity))))
