"""LM scoring by a class-based bigram model whose classes come from exchange clustering.

The words of the training part that occur LEAST times or more, WORDS of them at most, take part in the exchange one by
one; any other word takes part through its kind (its last two bytes and its length, KINDS in all), whose tokens are
exchanged like a word's. A token's probability is that of its class after the one before, times its own (or its kind's)
share of the class, times, for a word known by its kind, its exact share of the kind's training tokens, which a join
looks up. So counts, bigrams and vocabulary grow with the corpus; what is sent to workers does not.

A word is known by 54 bits of its hash and its kind: two of n words collide with odds of n**2 / 2**55 at most."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, cut, hashed_words, mix, record_batch, slices, table

LEAST, WORDS, CLASSES, ROUNDS, FLUSH, BLOCK = 20, 1 << 16, 64, 6, 800_000, 250_000
KINDS = 1 << 10
END = int(mix(np.array([0xE0F], np.uint64)).view(np.int64)[0])


def tokens(text: str | None) -> np.ndarray:
    """The words' identities, then the end."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    start, end, h = hashed_words(raw)
    if not len(h):
        return np.array([END], np.int64)
    b = LOWER[np.frombuffer(raw, np.uint8)].astype(np.uint64)
    last, before = b[end - 1], np.where(end - start > 1, b[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    size = np.minimum(end - start, 15).astype(np.uint64) // np.uint64(3)
    kind = (last * np.uint64(31) + before * np.uint64(131) + size * np.uint64(577)) & np.uint64(KINDS - 1)
    return np.append((h & ~np.uint64(KINDS - 1) | kind).view(np.int64), END)


def _summed(rows, names: list[str], keys_of):
    """Counts of the keys (int64 columns) of texts, combined in Python before the shuffle."""
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        held, n = [], 0

        def out():
            k, c = np.unique(np.concatenate(held), axis=0, return_counts=True) if len(names) > 2 else np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for s in range(0, len(k), 100_000):
                part = k[s : s + 100_000]
                yield record_batch(schema, [*(part.T if len(names) > 2 else [part]), c[s : s + 100_000]])

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                x = keys_of(t)
                held.append(x)
                n += len(x)
                if n > 4 * FLUSH:
                    yield from out()
                    n = 0
        if held:
            yield from out()

    got = rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))
    return got.groupBy(*names[:-1]).agg(F.sum(names[-1]).alias(names[-1]))


def _blocks(batches):
    """Pairs in rows of many, as bytes: what is read again and again isn't taken apart each time."""
    schema, held, n = pa.schema([("key", pa.binary()), ("n", pa.binary())]), [], 0
    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
        if n > BLOCK:
            yield record_batch(schema, [[np.concatenate(c).tobytes()] for c in zip(*held)])
            held, n = [], 0
    if held:
        yield record_batch(schema, [[np.concatenate(c).tobytes()] for c in zip(*held)])


def _pairs_of(batches):
    for b in batches:
        for key, n in zip(b.column(0), b.column(1)):
            yield np.frombuffer(key.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)


def objective(matrix: np.ndarray) -> float:
    """What exchange raises: the log likelihood of class bigrams, up to a part that no exchange changes."""
    log = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return log(matrix.ravel()) - log(matrix.sum(0)) - log(matrix.sum(1))


def exchange(pairs: DataFrame, size: int, rounds: int = ROUNDS, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of `size` words by number (then the end's own), the class bigram counts, and the objective from the
    start on. pairs: (key, n), the key holding both words' numbers. A round proposes for each word of one half the class
    that gains most; all that gain move at once if the objective rises, else only the quarter that gains most, and so
    on; a round that finds no rise changes nothing. Ties go to the class of the least number."""
    sc = pairs.sparkSession.sparkContext
    every = classes + 1
    group = np.append(np.arange(size) % classes, [classes]).astype(np.int64)

    blocks = cut(pairs.select("key", "n").mapInArrow(_blocks, "key binary, n binary"))
    one = pa.schema([("m", pa.binary())])

    def bigrams(g) -> np.ndarray:
        """One matrix a task, added up in up to 16 tasks before the driver."""
        shared = sc.broadcast(g)

        def run(batches):
            total = np.zeros(every * every)
            for key, n in _pairs_of(batches):
                total += np.bincount(shared.value[key >> 32] * every + shared.value[key & 0xFFFFFFFF], weights=n, minlength=every * every)
            yield record_batch(one, [[total.tobytes()]])

        def add(batches):
            total = np.zeros(every * every)
            for b in batches:
                for m in b.column(0).to_pylist():
                    total += np.frombuffer(m)
            yield record_batch(one, [[total.tobytes()]])

        got = blocks.mapInArrow(run, "m binary").repartition(16).mapInArrow(add, "m binary").collect()
        return np.sum([np.frombuffer(bytes(r.m)) for r in got], axis=0).reshape(every, every)

    matrix = bigrams(group)
    history = [objective(matrix)]
    slot = pa.schema([("at", pa.int64()), ("n", pa.int64())])
    move = pa.schema([("w", pa.int64()), ("k", pa.int64()), ("gain", pa.float64())])
    for turn in range(rounds if size else 0):
        shared = sc.broadcast((group, np.log(matrix + 0.5), np.log(matrix.sum(1) + 1), np.log(matrix.sum(0) + 1)))

        def contexts(batches, shared=shared, turn=turn):
            g = shared.value[0]
            for key, n in _pairs_of(batches):
                a, c = key >> 32, key & 0xFFFFFFFF
                left, right = (a < size) & (a % 2 == turn % 2), (c < size) & (c % 2 == turn % 2)
                k = np.concatenate((a[left] * 2 * every + g[c[left]], c[right] * 2 * every + every + g[a[right]]))
                u, at = np.unique(k, return_inverse=True)
                m = np.bincount(at, weights=np.concatenate((n[left], n[right])), minlength=len(u)).astype(np.int64)
                yield record_batch(slot, [u, m])

        def moves(batches, shared=shared):
            g, log, out, into = shared.value
            gain = np.concatenate((log.T[:, :classes] - out[:classes], log[:, :classes] - into[:classes]))  # slot -> class
            for b in slices(batches, 4096):
                w, ctx = b.column(0).to_numpy(), b.column(1)
                row = np.repeat(np.arange(len(w)), np.diff(ctx.offsets.to_numpy()))
                x = np.zeros((len(w), 2 * every))
                flat = ctx.flatten()
                x[row, flat.field("slot").to_numpy()] = flat.field("n").to_numpy()
                f = x @ gain
                best, own = f.argmax(1), f[np.arange(len(w)), g[w]]
                up = f.max(1) - own
                on = np.flatnonzero(up > 0)
                yield record_batch(move, [w[on], best[on], up[on]])

        per = blocks.mapInArrow(contexts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
        per = per.groupBy(F.floor(F.col("at") / (2 * every)).alias("w")).agg(F.collect_list(F.struct((F.col("at") % (2 * every)).alias("slot"), "n")).alias("ctx"))
        found = per.mapInArrow(moves, "w long, k long, gain double").toArrow()  # at most one row a word
        w, k, gain = (found.column(c).to_numpy() for c in range(3))
        order = np.lexsort((w, -gain))
        share = len(order)
        while share:
            new = group.copy()
            new[w[order[:share]]] = k[order[:share]]
            trial = bigrams(new)
            if objective(trial) > history[-1]:
                group, matrix = new, trial
                history.append(objective(trial))
                break
            share //= 4
    return group, matrix, history


@dataclass
class Model:
    """Frequent words (sorted, with their numbers), training counts by number (words, kinds, end), classes and tables."""

    word: np.ndarray
    number: np.ndarray
    count: np.ndarray
    group: np.ndarray
    matrix: np.ndarray
    history: list[float]
    move: np.ndarray
    emit: np.ndarray
    kind_total: np.ndarray
    total: int
    distinct: int
    counts: DataFrame | None

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of a text's tokens: words, then kinds, then the end."""
        return _numbers(h, self.word, self.number)


def _numbers(h: np.ndarray, known: np.ndarray, number: np.ndarray) -> np.ndarray:
    out = len(known) + (h & KINDS - 1)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        out[hit] = number[at[hit]]
    out[-1] = len(known) + KINDS
    return out


def train(text: DataFrame, least: int = LEAST, words: int = WORDS, rounds: int = ROUNDS, classes: int = CLASSES) -> Model:
    """The model of the texts (one column). Words that tie in frequency at the bound: those of the least hash."""
    counts = cut(_summed(text, ["h", "c"], tokens))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = counts.where((F.col("c") >= least) & (F.col("h") != END)).orderBy(F.desc("c"), "h").limit(words).toArrow()
    word, count = often["h"].to_numpy(), often["c"].to_numpy()
    order = np.argsort(word)
    known, number = word[order], order
    kinds = counts.where(F.col("h") != END).groupBy(F.col("h").bitwiseAND(KINDS - 1).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    tokens_of, types_of = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
    for r in kinds:  # one row a kind
        tokens_of[r.k], types_of[r.k] = r.c, r.n
    np.subtract.at(tokens_of, word & KINDS - 1, count)
    np.subtract.at(types_of, word & KINDS - 1, 1)
    ends = int(counts.where(F.col("h") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    shared = text.sparkSession.sparkContext.broadcast((known, number))

    def pairs_of(t):
        n = _numbers(tokens(t), *shared.value)
        return np.append(n[-1], n[:-1]) << 32 | n

    pairs = _summed(text, ["key", "n"], pairs_of)
    group, matrix, history = exchange(pairs, len(word) + KINDS, rounds, classes)
    every = classes + 1
    move = np.log10((matrix + 0.1) / (matrix.sum(1, keepdims=True) + 0.1 * every))
    # a kind without training tokens still has a share: one more token for each
    share = np.concatenate((count, tokens_of + 1, [1])).astype(float)
    emit = np.log10(share / np.bincount(group, weights=share, minlength=every)[group])
    return Model(known, number, np.concatenate((count, tokens_of, [ends])), group, matrix, history, move, emit, tokens_of + types_of + 1, int(total), int(distinct), counts)


def score(docs: DataFrame, least: int | float = LEAST, words: int = WORDS, rounds: int = ROUNDS, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row.

    Null texts count as empty: one token, the end. Repeated rows count and stay as often as they occur; a null doc_id
    is of the training part. With no training rows N and V are 0 and nothing is known."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    d = docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out"))
    model = train(d.where(~F.col("held_out")).select("text"), least, words, rounds, classes)
    return scored(d, model)


def scored(d: DataFrame, model: Model) -> DataFrame:
    """d: (doc_id, text, held_out)."""
    base_denominator = float(np.log10(model.total + model.distinct + 1))
    known, kind_total = len(model.word), np.log10(model.kind_total)
    shared = d.sparkSession.sparkContext.broadcast((model.word, model.number, model.count, model.group, model.move, model.emit))
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("hs", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))])

    def run(batches):
        word, number, count, group, move, emit = shared.value
        at = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            rows = []
            for i, t, o in zip(*(b.column(k).to_pylist() for k in range(3))):
                h = tokens(t)
                n = _numbers(h, word, number)
                g = group[n]
                rare = (n >= known) & (n < known + KINDS)
                c = count[n[~rare]]
                u, m = np.unique(h[rare], return_counts=True)
                base = float(np.log10(c + 1.0).sum()) - base_denominator * len(n)
                own = float(move[np.append(len(move) - 1, g[:-1]), g].sum() + emit[n].sum() - kind_total[n[rare] - known].sum())
                rows.append((at, i, o, len(n), int((c > 0).sum()), base, own, u, m))
                at += 1
            yield record_batch(out, list(zip(*rows)) if rows else [[]] * 9)

    first = cut(d.select("doc_id", "text", "held_out").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, hs array<long>, ns array<long>"))
    rare = first.select("row", F.explode(F.arrays_zip("hs", "ns")).alias("e")).select("row", F.col("e.hs").alias("h"), F.col("e.ns").alias("n"))
    c = F.coalesce("c", F.lit(0))
    more = rare.join(model.counts, "h", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10(c + F.lit(1.0))).alias("b"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    s = F.col("model") + zero("b")
    return first.drop("hs", "ns").join(more, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("k")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), s.alias("score"), F.pow(F.lit(10.0), -s / F.col("n_tokens")).alias("perplexity"))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
