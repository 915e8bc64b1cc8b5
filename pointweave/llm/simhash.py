"""SimHash near-duplicates by anchor-point covering.

The 64 bits are a direct sum of perfect codes: Golay [23,12] twice, Hamming [15,11], repetition [3,1]. Its 2^36 code
words are the anchors; every word lies within R = 8 of one. Two fingerprints at distance 2 or less have a word z
within 1 of both, and z's anchor lies within R + 1 of both: so each fingerprint goes to the anchors of the words
within 1 of it (17 on average), and every link meets at some anchor."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import near_copies
from .common import cut, record_batch, slices, table
from .components import components

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: An anchor with more fingerprints than this is refined by the finest covering (every word an anchor of its own).
CAP = 256


def fingerprint(text: str | None, block: int = 50_000) -> int:
    """Over 3-word shingles with repeats, in blocks of a bounded size."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(UPPER).split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for s in range(0, n, block):
        part = words[s : s + block + 2]
        grams = map(b" ".join, zip(part, part[1:], part[2:])) if len(part) > 2 else [b" ".join(part)]
        h = np.fromiter((digest(g, 42) for g in grams), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):
            ones += bits[at : at + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _syndromes(n: int, generator: int, check: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of n bits its nearest code word's index, for a cyclic code: word without its error pattern."""
    def rest(x: int) -> int:
        for k in range(n - 1, check - 1, -1):
            if x >> k & 1:
                x ^= generator << (k - check)
        return x

    unit = np.array([rest(1 << k) for k in range(n)])
    error = np.zeros(1 << check, np.int64)
    seen = {0}
    layer = [(0, 0, -1)]
    for _ in range(radius):
        layer = [(w | 1 << k, s ^ int(unit[k]), k) for w, s, last in layer for k in range(last + 1, n)]
        for w, s, _k in layer:
            error[s] = w
            seen.add(s)
    assert len(seen) == 1 << check  # a perfect code
    x = np.arange(1 << n, dtype=np.int64)
    syn = np.zeros(1 << n, np.int64)
    for k in range(n):
        syn ^= np.where(x >> k & 1, unit[k], 0)
    return x ^ error[syn], error


@lru_cache(1)
def _codes() -> list[tuple[int, int, np.ndarray]]:
    golay = _syndromes(23, 0b101011100011, 11, 3)[0].astype(np.int32)
    hamming = _syndromes(15, 0b10011, 4, 1)[0].astype(np.int32)
    repeat = _syndromes(3, 0b111, 2, 1)[0].astype(np.int32)
    return [(0, 23, golay), (23, 23, golay), (46, 15, hamming), (61, 3, repeat)]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for each fingerprint (uint64): its own anchor and those of the words one bit away, distinct."""
    own = np.zeros(len(fps), np.uint64)
    parts = []
    for shift, n, code in _codes():
        w = ((fps >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int64)
        near = np.sort(np.stack([code[w], *(code[w ^ (1 << k)] for k in range(n))]), axis=0)
        parts.append((shift, code[w], near))
        own |= code[w].astype(np.uint64) << np.uint64(shift)
    rows, found = [np.arange(len(fps))], [own]
    for shift, home, near in parts:
        fresh = np.vstack((np.ones((1, len(fps)), bool), near[1:] != near[:-1])) & (near != home)
        k, r = np.nonzero(fresh)
        rows.append(r)
        found.append(own[r] ^ ((home[r] ^ near[k, r]).astype(np.uint64) << np.uint64(shift)))
    return np.concatenate(rows), np.concatenate(found)


def balls(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The finest covering: all words within one bit."""
    flip = np.append(np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64))
    return np.repeat(np.arange(len(fps)), 65), (fps[:, None] ^ flip).ravel()


def _replicated(fps: DataFrame, how) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in slices(batches, 4096):
            f = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            r, a = how(f.view(np.uint64))
            yield record_batch(schema, [a.view(np.int64), f[r]])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect what lies within 2 bits. A bucket gives a
    tree of its local components, not all its pairs. Buckets over the cap are settled exactly by balls: words within
    one bit of a common word are within 2 of each other, so each links to the least of its ball."""
    rep = cut(_replicated(fps, anchors))
    size = rep.groupBy("anchor").count().where("count > 1")
    size = cut(size)
    small = rep.join(size.where(F.col("count") <= cap).select("anchor"), "anchor").groupBy("anchor").agg(F.collect_list("fp").alias("fps")).select("fps")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in slices(batches, 4096):
            out: list[tuple[int, int]] = []
            for f in b.column(0).to_pylist():
                x = np.sort(np.array(f, np.int64))
                near = np.bitwise_count(x.view(np.uint64)[:, None] ^ x.view(np.uint64)) <= 2
                label = np.arange(len(x))
                while True:
                    new = np.where(near, label, len(x)).min(1)
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                out += [(int(x[r]), int(v)) for v, r in zip(x, label) if x[r] != v]
            yield record_batch(schema, list(zip(*out)) if out else [[], []])

    found = small.mapInArrow(run, "a long, b long")
    large = rep.join(size.where(F.col("count") > cap).select("anchor"), "anchor").select("fp").distinct()
    ball = _replicated(large, balls)
    least = ball.groupBy("anchor").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("anchor", "a")
    return found.unionByName(ball.join(least, "anchor").where("fp != a").select("a", F.col("fp").alias("b"))).distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = pa.schema([(id_col, pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield record_batch(schema, [b.column(0), fp.view(np.int64)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"{id_col} long, fp long")


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, key, bands): also what the links by shared shingles need, in the same pass."""
    schema = pa.schema([(id_col, pa.int64()), ("fp", pa.int64()), ("key", pa.int64()), ("bands", pa.list_(pa.int64())), ("n", pa.int64())])

    def run(batches):
        for b in slices(batches):
            text = b.column(1).to_pylist()
            fp = np.array([fingerprint(t) for t in text], np.uint64)
            sets = [near_copies.shingles(t) for t in text]
            key = np.array([near_copies.key_of(s) for s in sets], np.uint64)
            yield record_batch(schema, [b.column(0), fp.view(np.int64), key.view(np.int64), [near_copies.bands(s).view(np.int64) for s in sets], list(map(len, sets))])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"{id_col} long, fp long, key long, bands array<long>, n long")


def _near_keys(fp: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints lie within 2 bits, as trees: keys of one fingerprint hang on the least,
    the least keys of fingerprints on each other as `links` has them."""
    each = cut(fp.select("fp", "key").distinct())
    head = cut(each.groupBy("fp").agg(F.min("key").alias("head")))
    same = each.join(head, "fp").select(F.col("head").alias("a"), F.col("key").alias("b"))
    near = links(head.select("fp")).join(head.select(F.col("fp").alias("a"), F.col("head").alias("ka")), "a").join(head.select(F.col("fp").alias("b"), F.col("head").alias("kb")), "b")
    return same.unionByName(near.select(F.col("ka").alias("a"), F.col("kb").alias("b"))).where("a != b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = near_copies.SIMILARITY) -> DataFrame:
    """(id, fingerprint, component_id) for each row. Texts link if their 5-word shingles have a Jaccard similarity of
    `similarity` or more: candidates are fingerprints within 2 bits, and for what those miss bands of min-hashes, each
    verified; with None, if their fingerprints lie within 2 bits, as op1 asks. Null, empty and wordless
    texts have fingerprint zero and link like any other; equal texts form one class before any replication, so copies
    cost nothing further; repeated rows stay; component_id is the smallest id reachable; a null id stays a row and
    never names a component unless it has no other. An empty table gives an empty result."""
    by = "fp" if similarity is None else "key"
    fp = cut(fingerprints(docs, id_col, text_col) if similarity is None else _sketched(docs, id_col, text_col))
    least = F.min(id_col).alias("least")
    classes = cut(fp.groupBy(by).agg(*([least] if similarity is None else [least, F.first("bands").alias("bands"), F.first("n").alias("n")])))
    roots = cut(components(links(classes))) if similarity is None else near_copies.roots(docs.select(id_col, text_col), classes, similarity, _near_keys(fp))
    named = classes.join(roots.withColumnRenamed("node", by), by, "left").select(by, "least", F.coalesce("root", by).alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(by, "component_id")
    return fp.join(named, by).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), similarity=None)
