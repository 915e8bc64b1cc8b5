"""Token counts (rank-synchronous array merging) and the byte-level BPE encoder that packing shares."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import record_batch, slices, table

NAME = "byte_bpe_50k.json"
CACHE = 500_000  # pre-tokens of the current generation kept by a worker; the one before it stays readable


def vocabulary(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ArrayMerger:
    """Byte-level BPE over ragged arrays: in each round every sequence merges its pair of lowest rank, all at once."""

    def __init__(self, path: str):
        import public_tokenizers

        j = json.load(open(path, encoding="utf-8"))
        vocab = j["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.byte = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 20 | right
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order, made
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = {t["content"]: t["id"] for t in j["added_tokens"] if t.get("special")}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids start (one more entry: the end)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        ids = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        of = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.key) + 1
        while len(ids):
            k = ids[:-1] << 20 | ids[1:]
            at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            rank = np.where((self.key[at] == k) & (of[:-1] == of[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            least = np.minimum.reduceat(rank, heads)
            length = np.diff(np.append(heads, len(ids)))
            open_ = np.repeat(least < none, length)
            if not open_.all():
                done.append((of[~open_], ids[~open_]))
                rank, ids, of, least = rank[open_], ids[open_], of[open_], np.repeat(least, length)[open_]
                if not len(ids):
                    break
            else:
                least = np.repeat(least, length)
            hit = rank == least
            # overlapping pairs (aaa): from each run of hits every second one counts, from the left
            begin = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
            place = np.flatnonzero(hit)
            run = begin[np.searchsorted(begin, place, "right") - 1]
            place = place[(place - run) % 2 == 0]
            ids = ids.copy()
            ids[place] = self.made[rank[place]]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            ids, of = ids[keep], of[keep]
        of = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order], np.searchsorted(of[order], np.arange(len(words) + 1))

    def pieces(self, text: str, special: bool):
        """Pre-tokens; special strings stand alone in the parts of odd index."""
        if special and self.split is not None and any(s in text for s in self.special):
            return self.split.split(text)
        return [text]

    def learn(self, texts: list[str], value) -> list[list[list[str]]]:
        """Pre-tokens of each part of each text; what isn't known yet is merged in one batch."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        words = [[self.pattern.findall(p) if k % 2 == 0 else [p] for k, p in enumerate(self.pieces(t, True))] for t in texts]
        new = set().union(*(p for t in words for p in t[::2])) - self.known.keys()
        if self.older:
            for w in new & self.older.keys():
                self.known[w] = self.older[w]
            new -= self.known.keys()
        if new:
            new = list(new)
            ids, at = self.merge(new)
            self.known.update(zip(new, value(ids, at)))
        return words

    def counts(self, texts: list[str]) -> list[int]:
        words = self.learn(texts, lambda ids, at: np.diff(at).tolist())
        get = self.known.__getitem__
        return [sum(sum(map(get, p)) if k % 2 == 0 else 1 for k, p in enumerate(t)) for t in words]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        def value(ids, at):
            raw = ids.astype("<u4").tobytes()
            return [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

        words = self.learn(texts, value)
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, p)) if k % 2 == 0 else self.special[p[0]].to_bytes(4, "little") for k, p in enumerate(t)) for t in words]


@lru_cache(4)
def merger(path: str, use: str) -> ArrayMerger:
    """One for each worker and use (counts and ids have caches of their own)."""
    return ArrayMerger(path)


@lru_cache(2)
def fast_encoder(path: str):
    """An encoder by ranks for a vocabulary whose ids are the order of its merges; None for any other."""
    import public_tokenizers
    import tiktoken

    m = merger(path, "ids")
    by_rank = m.made  # in the order of the merges
    n = len(set(m.byte.tolist()))
    if n != 256 or m.byte.max() != 255 or not (by_rank == np.arange(256, 256 + len(by_rank))).all():
        return None
    name: list[bytes] = [b""] * (256 + len(by_rank))
    for b, k in enumerate(m.byte.tolist()):
        name[k] = bytes((b,))
    left, right = np.empty_like(m.key), np.empty_like(m.key)
    left[m.rank], right[m.rank] = m.key >> 20, m.key & (1 << 20) - 1
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        name[256 + k] = name[a] + name[b]
    ranks = {x: k for k, x in enumerate(name)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=m.special) if len(ranks) == len(name) else None


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. Null and empty texts count 0; repeated rows stay;
    other columns are ignored. No shuffle: each text is pre-tokenised, pre-tokens new to the worker are merged as
    ragged arrays, and the surviving symbols are counted."""
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        m = merger(path, "count")
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = m.counts(texts)
            yield record_batch(schema, [b.column(0), [len(t.encode("utf-8", "surrogatepass")) for t in texts], n, [x > limit for x in n]])

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())
