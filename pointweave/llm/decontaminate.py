"""Benchmark decontamination by spaced seeds: masks that ignore some token positions, then a verified overlap.

Seeds of the test items lie in a table, each with the context around it; equal contexts of many items (a prompt they
share) are one row. A Bloom filter of the seeds, of a bounded size, goes to every worker; the seeds of documents that
pass it are joined with the table in Spark, and the two contexts of each pair are compared. Nothing that grows with the
benchmark is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, hashed_words, mix, record_batch, slices, table

WINDOW, SHARE = 16, 0.8
#: Masks by the fewest tokens of an item they serve; a one is a compared token. Within any window of that many tokens
#: with as many substitutions as SHARE lets pass, the longer items' included, some mask meets no substitution. Items of
#: one and two words are sought only as whole texts.
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11101", "11011", "10111"),
    7: ("11111", "111011", "110111"),
    10: ("111011", "11010011", "11111"),
    15: ("1111011", "11001000111", "11010110001"),
}
WHOLE = 2
ALL = sorted({m for ms in MASKS.values() for m in ms}, key=lambda m: (len(m), m))
#: A context: a seed's span with a window less one on both sides.
SPAN = max(map(len, ALL))
WIDE = 2 * (WINDOW - 1) + SPAN
#: Bits of the filter for each seed, and in all at most (64 MB); beyond, more seeds pass and the join decides.
BITS_EACH, BITS = 32, 1 << 29
_PAD = np.uint64(0)


def words_of(text: str | None) -> np.ndarray:
    return hashed_words((text or "").encode("utf-8", "surrogatepass"))[2]


def _seed(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15 * (ALL.index(mask) + 1) & (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                out += h[k : k + n] * np.uint64(2 * k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
        return mix(out)


def _contexts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of WIDE words: those from WINDOW - 1 before each place on; zeros outside the text."""
    room = np.concatenate((np.zeros(WINDOW - 1, np.uint64), h, np.zeros(WIDE, np.uint64)))
    return room[at[:, None] + np.arange(WIDE)]


def masks_of(words: int) -> tuple[str, ...]:
    """Masks that serve an item of so many words."""
    return MASKS[max(n for n in MASKS if n <= words)] if words else ()


def postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of an item's words and their contexts."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros((0, WIDE), np.uint64)
    seeds = [_seed(h, m) for m in masks_of(len(h))]
    return np.concatenate(seeds), np.concatenate([_contexts(h, np.arange(len(s))) for s in seeds])


class Filter:
    """Blocked Bloom filter: three bits of one 64-bit word for each seed; the number of words is a power of two."""

    def __init__(self, words: np.ndarray, masks: list[str]):
        self.words, self.masks = words, masks

    @staticmethod
    def size(seeds: int) -> int:
        """Words for so many seeds."""
        return 1 << max(4, min(BITS, BITS_EACH * seeds) // 64).bit_length() - 1

    @staticmethod
    def word(seeds: np.ndarray, size: int) -> np.ndarray:
        return (seeds >> np.uint64(18) & np.uint64(size - 1)).astype(np.int64)

    @staticmethod
    def bits(seeds: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        return one << (seeds & np.uint64(63)) | one << (seeds >> np.uint64(6) & np.uint64(63)) | one << (seeds >> np.uint64(12) & np.uint64(63))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seeds of a text that pass, and where they stand."""
        seeds, places = [], []
        for m in self.masks:
            if len(m) <= WHOLE and len(h) != len(m):
                continue
            s = _seed(h, m)
            if len(s):
                held = self.words[self.word(s, len(self.words))]
                ok = np.flatnonzero(held >> (s & np.uint64(63)) & np.uint64(1))  # one bit first, the others of few
                bits = self.bits(s[ok])
                ok = ok[held[ok] & bits == bits]
                seeds.append(s[ok])
                places.append(ok)
        return (np.concatenate(seeds), np.concatenate(places)) if seeds else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def verified(text: np.ndarray, item: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two contexts: the best window's matching words if it agrees in SHARE or more, else 0, and where it
    starts. A window is `size` words that lie in both the text and the item."""
    best, start = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    same, both = (text == item) & (item != _PAD), (text != _PAD) & (item != _PAD)
    for n in np.unique(size):
        r = np.flatnonzero(size == n)
        s, b = (np.pad(np.cumsum(x[r], axis=1), ((0, 0), (1, 0))) for x in (same, both))
        run = np.where(b[:, n:] - b[:, :-n] == n, s[:, n:] - s[:, :-n], -1)
        at = run.argmax(1)
        got = run[np.arange(len(r)), at]
        best[r], start[r] = np.where(got >= SHARE * n - 1e-9, got, 0), at
    return best, start


class Index:
    """The same search over a few items in memory, for single texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, words = [i for i, _ in items], [words_of(t) for _, t in items]
        found = [postings(h) for h in words]
        self.seeds, self.contexts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        self.of = np.repeat(np.arange(len(items)), [len(f[0]) for f in found])
        self.size = np.array([min(WINDOW, len(h)) for h in words])[self.of]
        bloom = np.zeros(Filter.size(len(self.seeds)), np.uint64)
        np.bitwise_or.at(bloom, Filter.word(self.seeds, len(bloom)), Filter.bits(self.seeds))
        self.filter, self.order = Filter(bloom, sorted({m for h in words for m in masks_of(len(h))})), np.argsort(self.seeds, kind="stable")

    def overlaps(self, words: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """item index -> (matching words, first word, end word) of its best verified window."""
        seeds, places = self.filter.hits(words)
        lo, hi = (np.searchsorted(self.seeds[self.order], seeds, side) for side in ("left", "right"))
        row = np.repeat(np.arange(len(seeds)), hi - lo)
        hit = self.order[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])] if len(row) else np.zeros(0, int)
        best, start = verified(_contexts(words, places[row]), self.contexts[hit], self.size[hit])
        out: dict[int, tuple[int, int, int]] = {}
        for r in np.flatnonzero(best):
            first = int(places[row[r]] - (WINDOW - 1) + start[r])
            out[int(self.of[hit[r]])] = max(out.get(int(self.of[hit[r]]), (0, 0, 0)), (int(best[r]), first, first + int(self.size[hit[r]])))
        return out


def _test_side(bench: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(seed, ctx, words, size) with one row for equal contexts of one seed; (ctx, item_id); the masks that items use."""
    schema = pa.schema([("served", pa.int32()), ("seed", pa.int64()), ("ctx", pa.int64()), ("words", pa.binary()), ("size", pa.int32()), ("item_id", pa.int64())])

    def run(batches):
        for b in slices(batches, 64):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = words_of(t)
                s, c = postings(h)
                size = min(WINDOW, len(h))
                raw = [x.tobytes() for x in c]
                ctx = np.array([xxhash.xxh3_64_intdigest(x, int(k) ^ size) for x, k in zip(raw, s)], np.uint64)
                for at in range(0, len(s), 4096):
                    e = slice(at, at + 4096)
                    n = len(s[e])
                    yield record_batch(schema, [np.full(n, len(h), np.int32), s[e].view(np.int64), ctx[e].view(np.int64), raw[e], np.full(n, size, np.int32), np.full(n, i, np.int64)])

    bench = bench.select(F.col("item_id").cast("long"), F.col("text")).where("text is not null and item_id is not null")
    rows = cut(bench.mapInArrow(run, "served int, seed long, ctx long, words binary, size int, item_id long"))
    longest = max(MASKS)
    masks = {m for r in rows.select(F.least("served", F.lit(longest)).alias("n")).distinct().collect() for m in masks_of(r.n)}
    return rows.groupBy("seed", "ctx").agg(F.first("words").alias("words"), F.first("size").alias("size")), rows.select("ctx", "item_id").distinct(), sorted(masks)


def _filter(seeds: DataFrame, masks: list[str]) -> Filter:
    """Words of the filter are summed up in Spark; what comes to the driver has at most BITS bits, twice."""
    n = seeds.select("seed").distinct().count()
    size = Filter.size(n)
    schema = pa.schema([("at", pa.int64()), ("bits", pa.int64())])

    def run(batches):
        for b in batches:
            s = b.column(0).to_numpy().view(np.uint64)
            yield record_batch(schema, [Filter.word(s, size), Filter.bits(s).view(np.int64)])

    got = seeds.select("seed").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, np.uint64)
    words[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Filter(words, masks)


def _hits(docs: DataFrame, bench: DataFrame, key: list[str]) -> DataFrame:
    """(key columns, item_id, first_word, end_word): verified windows of docs. docs: the key columns, then the text."""
    seeds, items, masks = _test_side(bench)
    shared = docs.sparkSession.sparkContext.broadcast(_filter(seeds, masks))
    schema = pa.schema([*((c, pa.int64()) for c in key), ("seed", pa.int64()), ("at", pa.int64()), ("mine", pa.binary())])

    def find(batches):
        for b in slices(batches):
            rows, parts, most = [], [], 0
            for r, t in enumerate(b.column(len(key)).to_pylist()):
                h = words_of(t)
                s, at = shared.value.hits(h)
                for k in range(0, len(s), 4096):
                    e = slice(k, k + 4096)
                    parts.append((s[e].view(np.int64), at[e], [x.tobytes() for x in _contexts(h, at[e])]))
                    rows.append(np.full(len(s[e]), r))
                    most += len(s[e])
                    if most > 8192:
                        yield out(b, rows, parts)
                        rows, parts, most = [], [], 0
            if rows:
                yield out(b, rows, parts)

    def out(b, rows, parts):
        take = pa.array(np.concatenate(rows))
        return record_batch(schema, [*(b.column(k).take(take) for k in range(len(key))), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [x for p in parts for x in p[2]]])

    found = pa.schema([*((c, pa.int64()) for c in key), ("ctx", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def verify(batches):
        n = len(key)
        for b in slices(batches, 4096):
            mine, item = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, WIDE) for c in ("mine", "words"))
            size = b.column("size").to_numpy()
            best, start = verified(mine, item, size)
            ok = np.flatnonzero(best)
            first = b.column("at").to_numpy()[ok] - (WINDOW - 1) + start[ok]
            take = pa.array(ok)
            yield record_batch(found, [*(b.column(k).take(take) for k in range(n)), b.column("ctx").take(take), first, first + size[ok]])

    long = ", ".join(f"{c} long" for c in key)
    pairs = docs.mapInArrow(find, f"{long}, seed long, at long, mine binary").join(seeds, "seed").select(*key, "ctx", "at", "mine", "words", "size")
    good = pairs.mapInArrow(verify, f"{long}, ctx long, first_word long, end_word long")
    good = good.groupBy(*key, "ctx").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    return good.join(items, "ctx").drop("ctx")


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its id and its text's hash; equal rows have equal results."""
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), F.coalesce("text", F.lit("")).alias("_words"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without an overlap."""
    bad = cut(_hits(_keyed(docs), bench, ["_id", "_text"]).select("_id", "_text").distinct().withColumnsRenamed({"_id": "_bad_id", "_text": "_bad_text"}))
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_bad_text"])
    return docs.join(bad, same, "left_anti")


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, first_word, end_word) for each row of docs.

    A hit is verified: some window of 16 words (the whole item, if shorter) that lies in the text and in the item
    agrees in 80 % or more. Words are lower-cased (A-Z) and end at white space. Items of one or two words are met only
    by a text that is nothing else; a text shorter than an item's window doesn't hold it. Null and empty texts are clean;
    repeated rows stay; windows that tie count alike (first_word: the least start, end_word: the largest end); an
    empty benchmark leaves every row clean."""
    d = _keyed(docs)
    per = _hits(d, bench, ["_id", "_text"]).groupBy("_id", "_text").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    per = cut(per).withColumnsRenamed({"_id": "_i", "_text": "_t"})
    d = d.drop("_words")
    out = d.join(per, d["_id"].eqNullSafe(per["_i"]) & (d["_text"] == per["_t"]), "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<long>")))
    return out.select(F.col("_id").alias("doc_id"), (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "first_word", "end_word")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
