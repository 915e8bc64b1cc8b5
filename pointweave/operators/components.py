"""Connected components of distributed links, and dense numbers of ordered keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut

#: Links that a task holds while it thins a part, and up to which one task settles what is left (16 bytes each).
HELD, LAST = 2_000_000, 1_000_000
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a-b that aren't the least of their component, and that least node of each."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        # both ends' roots, and so all that hang on them, go to the lower one
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not (new == (up := new[new])).all():
            new = up
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def thinned(links: DataFrame, *by: Column) -> DataFrame:
    """Links (a, b) with the same components, each task's links cut down to stars. `by` deals links that are likely to
    hang together to one task; a task works through its links HELD at a time, so no key is too large for one."""

    def run(batches):
        held, n = [], 0
        for t in batches:
            if t.num_rows:
                held.append((t.column(0).to_numpy(), t.column(1).to_numpy()))
                n += t.num_rows
            if n >= HELD:
                u, v = forest(*(np.concatenate(c) for c in zip(*held)))
                held, n = [(u, v)], len(u)
                if n >= HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_PAIR)
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest(*(np.concatenate(c) for c in zip(*held)))], schema=_PAIR)

    links = links.select(F.col("a").cast("long"), F.col("b").cast("long"), *(c.alias(f"_k{k}") for k, c in enumerate(by))).where("a != b")
    return (links.repartition(*(f"_k{k}" for k in range(len(by)))) if by else links).select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, *by: Column, last: int = LAST, rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (node, root): the least node reachable, for nodes with a link to another.

    Links are thinned to stars in their tasks, dealt by `by`. What is left is settled by one task if it is `last` links
    or fewer, else by large-star and small-star rounds until nothing changes, each cut in the shared folder and thinned.
    Minima are combined before each shuffle; joins on a hub are left to the adaptive skew split."""
    e = cut(thinned(links, *by).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if e.limit(last + 1).count() <= last:
            one = thinned(e.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1))
            return cut(one.select(F.col("a").alias("node"), F.col("b").alias("root")))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = cut(large.join(low, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        digest = [d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() for d in (e, new)]
        e = new
        if digest[0] == digest[1]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def numbered(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the place (from 0) of each row in the order of a distinct key: places within ranges, and each range's
    offset; no task sees all rows."""
    part = cut(keys.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    total, offset = 0, []
    for r in part.groupBy("_part").count().orderBy("_part").collect():  # one row for each partition
        offset.append((r["_part"], total))
        total += r["count"]
    if not offset:
        return part.drop("_part").withColumn(name, F.lit(0).cast("long"))
    base = keys.sparkSession.createDataFrame(offset, "_part int, _base long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + F.col("_base")
    return part.join(F.broadcast(base), "_part").withColumn(name, place).drop("_part", "_base")
