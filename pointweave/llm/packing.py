"""Vector bin packing of tokenised examples under several limits at once."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, record_batch, slices, table
from .tokens import fast_encoder, merger, vocabulary

#: Longer texts are looked at for one very long run, which the array merger takes in linear rounds.
LONG = 100_000
#: Limits of a sequence: tokens, segments, loss-bearing tokens. The first token of a segment has nothing before it and
#: bears no loss, so that plain documents meet the last limit before the first only in conversations (MOST_LOSS).
LENGTH, SEGMENTS, MOST_LOSS, GROUP = 2048, 256, 1024, 20_000
#: Stands for a null id within a task.
NO_ID = -(1 << 63)
RUN = re.compile(r"\s{2000}|\S{2000}")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long"


def _encoded(path: str, texts: list[str]):
    """Ids of each text, four bytes each."""
    fast = fast_encoder(path)
    for t in texts:
        if fast is None or (len(t) > LONG and RUN.search(t)):
            yield merger(path, "ids").ids([t])[0]
        else:
            yield fast.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False).tobytes()


def tokenised(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 1) -> DataFrame:
    """Pieces of each document: blocks of `length` ids and one rest. Null texts hold the end id only.
    The ids are the tokenizer library's; a faster library with the same ranks makes them where that is sure to agree."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss")])
    end = end_id.to_bytes(4, "little")

    def run(batches):
        for b in slices(batches):
            out: list[tuple] = []
            for d, ids in zip(b.column(0).to_pylist(), _encoded(path, [t or "" for t in b.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, length):
                    part = memoryview(ids)[4 * s : 4 * (s + length)]
                    out.append((d, s, len(part) // 4, zlib.crc32(part), n, len(part) // 4 - 1))
            yield record_batch(schema, list(zip(*out)) if out else [[]] * 6)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECE)


def tokenised_turns(turns: DataFrame, path: str, length: int = LENGTH, max_loss: int = MOST_LOSS, end_id: int = 1, role: str = "assistant") -> DataFrame:
    """Pieces of each conversation (conv_id, turn, role, text): its turns in order, each closed by the end id. Tokens of
    `role` turns bear loss, others don't, nor does a piece's first token. A piece ends where it meets `length` or
    `max_loss`. Null texts hold the end id only; turns that tie in number go by role and text; a conversation is read
    by one task (it is one example). doc_id is the conv_id."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss")])
    end = end_id.to_bytes(4, "little")

    def run(batches):
        for b in slices(batches, 64):
            out: list[tuple] = []
            for d, convo in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = [ids + end for ids in _encoded(path, [t["text"] or "" for t in convo])]
                ids = b"".join(parts)
                bears = np.concatenate([np.full(len(p) // 4, t["role"] == role) for p, t in zip(parts, convo)])
                total = np.concatenate(([0], np.cumsum(bears)))
                at, n = 0, len(bears)
                while at < n:
                    # the first token bears none: up to max_loss of those after it
                    most = int(np.searchsorted(total, total[at + 1] + max_loss, "right")) - 1
                    to = min(n, at + length, max(at + 1, most))
                    part = memoryview(ids)[4 * at : 4 * to]
                    out.append((d, at, to - at, zlib.crc32(part), n, int(total[to] - total[at + 1])))
                    at = to
            yield record_batch(schema, list(zip(*out)) if out else [[]] * 6)

    order = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")))
    return turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(order.alias("turns")).mapInArrow(run, PIECE)


def fill(vectors: np.ndarray, limits: np.ndarray) -> list[list[tuple[int, int]]]:
    """Bins of (class, how many): each bin takes, again and again, the class with the largest dot product of its
    demand and the bin's free room (both as shares of the limits), among those that fit. Rows: (demand..., count)."""
    need, left = vectors[:, :-1].astype(np.int64), vectors[:, -1].astype(np.int64).copy()
    share = need / limits
    bins = []
    alive = np.flatnonzero(left > 0)
    while len(alive):
        room, content = limits.astype(np.int64).copy(), []
        while True:
            fit = alive[(need[alive] <= room).all(1) & (left[alive] > 0)]
            if not len(fit):
                break
            k = int(fit[np.argmax(share[fit] @ (room / limits))])
            # as many at once as keep it the best: those of at least half the room come one by one
            many = int(min(left[k], max(1, np.min(room // np.maximum(need[k], 1)) // 2)))
            content.append((k, many))
            left[k] -= many
            room -= many * need[k]
        bins.append(content)
        alive = alive[left[alive] > 0]
    return bins


def pack(pieces: DataFrame, length: int = LENGTH, max_segments: int = SEGMENTS, max_loss: int | None = None, group: int = GROUP) -> DataFrame:
    """Places (doc_id, start, length, ids_crc32, doc_tokens, loss) rows: adds sequence_id and offset. A sequence holds
    `length` tokens, `max_segments` pieces and `max_loss` loss-bearing tokens at most (None: `length`).

    Full blocks are sequences of their own. Rests go round-robin to groups of about `group` rows, each packed by one
    task; a hot key cannot swell a group. Ties go to the piece of the least demand, then the least id and start.
    Repeated rows are packed as often as they occur; an empty table gives an empty result; a null id stays null. A piece over a limit by
    itself raises ValueError."""
    limits = np.array([length, max_segments, length if max_loss is None else max_loss])
    pieces = cut(pieces)
    if not pieces.where((F.col("length") > length) | (F.col("loss") > int(limits[2])) | F.lit(max_segments < 1)).isEmpty():
        raise ValueError("a piece exceeds a limit of its sequence")
    rests = pieces.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // group))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    out = ", ".join(f"{n} long" for n in schema.names)

    def run(batches):
        rows = [np.column_stack([c.fill_null(NO_ID).to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
        if not rows:
            return
        x = np.concatenate(rows)
        x = x[np.lexsort((x[:, 1], x[:, 0], x[:, 5], x[:, 2]))]
        demand = np.column_stack((x[:, 2], np.ones(len(x), np.int64), x[:, 5]))
        kinds, first, count = np.unique(demand, axis=0, return_index=True, return_counts=True)
        order = np.lexsort((demand[:, 2], demand[:, 1], demand[:, 0]))
        begin = np.concatenate(([0], np.cumsum(count)[:-1]))
        base = TaskContext.get().partitionId() << 33
        seq, off = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for n, content in enumerate(fill(np.column_stack((kinds, count)), limits)):
            at = 0
            for k, many in content:
                take = order[begin[k] : begin[k] + many]
                begin[k] += many
                seq[take] = base + n
                off[take] = at + kinds[k, 0] * np.arange(many)
                at += int(kinds[k, 0]) * many
        for s in range(0, len(x), 20_000):
            e = slice(s, s + 20_000)
            yield record_batch(schema, [pa.array(x[e, 0], mask=x[e, 0] == NO_ID), *(x[e, k] for k in range(1, 5)), seq[e], off[e]])

    packed = rests.repartition(groups).mapInArrow(run, out)
    full = pieces.where(F.col("length") == length).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, **limits) -> DataFrame:
    return pack(tokenised(docs, path, limits.get("length", LENGTH)), **limits)


def pack_conversations(turns: DataFrame, path: str, length: int = LENGTH, max_segments: int = 32, max_loss: int = MOST_LOSS, **more) -> DataFrame:
    """Instruction data: conversations under all three limits."""
    return pack(tokenised_turns(turns, path, length, max_loss), length, max_segments, max_loss, **more)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
