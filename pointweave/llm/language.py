"""Language identification by string kernels: blended spectrum of byte 1- to 3-grams (presence), Nyström landmarks,
one-versus-rest kernel ridge regression, scored by matrix products over batches of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .common import record_batch, slices, table

#: The fit's bounds: labelled rows for each language and in all; characters for each language and in all, where a
#: language's first row counts whatever its length and the row that reaches the bound is taken whole.
SAMPLE, SAMPLE_ALL, SAMPLE_CHARS, SAMPLE_CHARS_ALL = 300, 6000, 6_000_000, 120_000_000
#: Languages up to which their table is broadcast (some 100 bytes each).
BROADCAST_LANGS = 50_000
LANDMARKS, RIDGE, SPACE = 64, 1e-3, 256 + 65536 + (1 << 24)
LETTER = regex.compile(r"\p{L}")


def grams(b: np.ndarray) -> np.ndarray:
    x = b.astype(np.int32)
    two = x[:-1] << 8 | x[1:]
    return np.concatenate((x, 256 + two, 65792 + (two[:-1] << 8 | x[2:]))) if len(x) > 2 else np.concatenate((x, 256 + two))


class Kernel:
    """Presence kernel against fixed landmark texts: shared grams over the root of both texts' distinct grams."""

    def __init__(self, landmarks: list[bytes]):
        sets = [np.unique(grams(np.frombuffer(t, np.uint8))) for t in landmarks]
        self.grams = np.unique(np.concatenate(sets))
        self.index = np.zeros(SPACE, np.uint32)
        self.index[self.grams] = np.arange(1, len(self.grams) + 1)
        self.has = np.zeros((len(self.grams) + 1, len(sets)), np.float32)
        for k, s in enumerate(sets):
            self.has[self.index[s], k] = 1 / np.sqrt(len(s))
        self.seen, self.clock = np.zeros(SPACE, np.int32), 1

    def rows(self, texts: list[bytes], block: int = 1 << 20) -> np.ndarray:
        marks = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        size = np.ones(len(texts))
        for k, t in enumerate(texts):
            b, distinct, since = np.frombuffer(t, np.uint8), 0, self.clock
            if self.clock > 1 << 30 or since + 4 * len(b) > (1 << 31) - 1:
                self.seen[:] = 0
                self.clock = since = 1
            for at in range(0, max(1, len(b) - 2), block):
                g = grams(b[at : at + block + 2])
                g = g[self.seen[g] < since]
                stamp = np.arange(self.clock, self.clock + len(g), dtype=np.int32)
                self.seen[g] = stamp
                distinct += int((self.seen[g] == stamp).sum())
                self.clock += len(g)
                marks[k, self.index[g]] = 1
            size[k] = max(1, distinct)
        marks[:, 0] = 0
        return (marks @ self.has) / np.sqrt(size)[:, None]


class Classifier:
    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for _, lang in rows})
        by = {lang: [t for t, x in rows if x == lang] for lang in self.langs}
        each = max(1, LANDMARKS // max(1, len(self.langs)))
        self.landmarks = [self.clean(t) for lang in self.langs for t in sorted(by[lang], key=lambda t: -min(len(t), 3000))[:each]]
        if not self.langs:
            return
        kernel = Kernel(self.landmarks)
        value, vector = np.linalg.eigh(kernel.rows(self.landmarks).astype(float))
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        x = np.concatenate([kernel.rows([self.clean(t) for t, _ in rows[s : s + 64]]) for s in range(0, len(rows), 64)]) @ root
        y = np.array([[1.0 if lang == c else -1.0 for c in self.langs] for _, lang in rows])
        x1 = np.column_stack((x, np.ones(len(x))))
        beta = np.linalg.solve(x1.T @ x1 + RIDGE * len(rows) * np.eye(x1.shape[1]) / 10, x1.T @ y)
        self.weight, self.bias = (root @ beta[:-1]).astype(np.float32), beta[-1]

    @staticmethod
    def clean(text: str) -> bytes:
        return text.lower().encode("utf-8", "surrogatepass")

    def predict(self, texts: list[str | None], kernel: Kernel) -> list[tuple[str, float]]:
        k = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        out = [("und", 0.0)] * len(texts)
        if k and self.langs:
            f = kernel.rows([self.clean(texts[i]) for i in k]) @ self.weight + self.bias
            for i, row in zip(k, f):
                out[i] = (self.langs[int(row.argmax())], float(min(1.0, max(0.0, (row.max() + 1) / 2))))
        return out


def fit(docs: DataFrame) -> Classifier:
    """From at most SAMPLE rows of each language and SAMPLE_ALL in all, of any length, chosen by a hash until their
    characters are enough; only rows whose crc32(doc_id as text) mod 5 isn't 0 and whose text and lang aren't null. A
    language's rows are counted first, and only those below a hash limit that lets about two samples through are ordered."""
    d = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and length(text) > 0").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    # by a uniform hash first, about two samples of each language, so that no language's rows meet in one task
    share = d.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * SAMPLE) / F.count("*")).alias("share"))
    langs = share.count()
    share = F.broadcast(share) if langs <= BROADCAST_LANGS else share
    pick = d.select("lang", "text", F.xxhash64("doc_id", F.lit(7)).alias("h")).join(share, "lang").where(F.col("h") < F.lit(2.0**64) * F.col("share") - F.lit(2.0**63))
    order = Window.partitionBy("lang").orderBy("h", "text")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = pick.withColumn("n", F.row_number().over(order)).withColumn("before", before).where(F.col("n") <= SAMPLE)
    ids = ids.where(F.col("before") < min(SAMPLE_CHARS, SAMPLE_CHARS_ALL // max(1, langs)))
    return Classifier([(r.text, r.lang) for r in ids.select("text", "lang", "n").orderBy("n", "lang").limit(SAMPLE_ALL).collect() if LETTER.search(r.text)])


def identify(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row: `und` and score 0 for texts that are null or without
    letters, or if nothing could be learned; repeated rows stay; ties go to the first language by name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        m = shared.value
        kernel = Kernel(m.landmarks) if m.langs else None
        for b in slices(batches, 64):
            p = m.predict(b.column(1).to_pylist(), kernel)
            yield record_batch(schema, [b.column(0), [x for x, _ in p], [x for _, x in p]])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, model: Classifier, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs whose text has a language, of `languages` if given; all columns, `lang` (if docs have it) being
    the prediction. One pass, no join. If nothing could be learned, every text with a letter stays as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    to = docs.columns.index("lang") if dict(docs.dtypes).get("lang") == "string" else None

    def run(batches):
        m = shared.value
        kernel = Kernel(m.landmarks) if m.langs else None
        for b in slices(batches, 64):
            text = b.column(at).to_pylist()
            if not m.langs:
                yield b.filter(pa.array([bool(t and LETTER.search(t)) for t in text], pa.bool_()))
                continue
            lang = [x for x, _ in m.predict(text, kernel)]
            if to is not None:
                b = b.set_column(to, b.schema.field(to), pa.array(lang, b.schema.field(to).type))
            yield b.filter(pa.array([x != "und" and (languages is None or x in languages) for x in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
