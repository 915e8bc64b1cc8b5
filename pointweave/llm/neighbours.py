"""Approximate nearest neighbours by a hash-prefix forest.

Each tree turns all vectors by a random rotation of its own. A vector's hash string lists the axes on which it lies
farthest out, with their signs, from the largest on: up to seven symbols of a byte each. A tree is the array of its
vectors sorted by string, kept in blocks of neighbouring strings, one task each. Its nodes are prefixes of variable
length: the shortest that at most `leaf` vectors share. What a prefix says about an inner product is its level: the sum
of the query's components along the prefix's axes, each times the mean length `weight` of that place, over the root of
the weights' squares. A query descends to the prefixes it matches best and ascends in all trees at the same time, level
by level, until it holds the candidates that `target` asks for: the level is measured on queries whose exact neighbours
one scan finds. Only the vectors of visited nodes are scored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, record_batch, slices, table

#: Trees; vectors of a node, at most, where a string has symbols left; vectors of a block, about; vectors that weights
#: and blocks are fitted on; queries that the level is measured on; share of their exact neighbours it must reach.
TREES, LEAF, BLOCK, SAMPLE, PROBED, TARGET = 6, 2, 1 << 16, 8192, 128, 0.95
SYMBOLS, AXES = 7, 128


class Forest:
    """Rotations, weights and block bounds of all trees. Vectors are of length 1 and `dims` components."""

    def __init__(self, sample: np.ndarray, trees: int, blocks: int = 1):
        r = np.random.default_rng(11)
        d = sample.shape[1]
        self.dims = min(d, AXES)
        self.turn = [np.linalg.qr(r.standard_normal((d, d)))[0][:, : self.dims] for _ in range(trees)]
        self.symbols = min(SYMBOLS, self.dims)
        self.weight = np.mean([np.sort(np.abs(sample @ t), 1)[:, ::-1][:, : self.symbols].mean(0) for t in self.turn], axis=0)
        self.weight = np.maximum(self.weight, 1e-9)
        self.norm = np.sqrt(np.cumsum(self.weight**2))
        edge = np.linspace(0, len(sample), blocks + 1)[1:-1].astype(int)
        self.edges = [np.unique(np.sort(self.strings(sample, t))[edge]) for t in range(trees)]

    def strings(self, x: np.ndarray, t: int) -> np.ndarray:
        z = x @ self.turn[t]
        axis = np.argsort(-np.abs(z), axis=1, kind="stable")[:, : self.symbols]
        symbol = 2 * axis + (np.take_along_axis(z, axis, 1) < 0)
        out = np.zeros(len(x), np.int64)
        for k in range(self.symbols):
            out = out << 8 | symbol[:, k]
        return out

    def symbol(self, strings: np.ndarray, k: int) -> np.ndarray:
        return strings >> 8 * (self.symbols - 1 - k) & 255

    def signed(self, q: np.ndarray, t: int) -> np.ndarray:
        """A query's component along each symbol's axis."""
        z = q @ self.turn[t]
        return np.stack((z, -z), axis=2).reshape(len(q), -1)

    def depths(self, strings: np.ndarray, leaf: int) -> np.ndarray:
        """Length of each node's prefix, for the sorted strings of a block."""
        out, open_ = np.full(len(strings), self.symbols), np.ones(len(strings), bool)
        for k in range(self.symbols + 1):
            head = strings >> 8 * (self.symbols - k) if k else np.zeros(len(strings), np.int64)
            begin = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
            size = np.diff(np.append(begin, len(strings)))
            done = open_ & np.repeat(size <= leaf, size)
            out[done] = k
            open_ &= ~done
        return out

    def levels(self, signed: np.ndarray, strings: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Of each query (row) the level of each prefix: the first `depth` symbols of a string."""
        total = np.zeros((len(signed), len(strings)), np.float32)
        for k in range(self.symbols):
            on = np.flatnonzero(depth > k)
            if len(on):
                total[:, on] += (self.weight[k] * signed[:, self.symbol(strings[on], k)]).astype(np.float32)
        norm = np.append(0, self.norm)[depth]
        return np.where(depth > 0, total / np.where(depth > 0, norm, 1), np.inf).astype(np.float32)

    def routes(self, signed: np.ndarray, t: int, level: float) -> np.ndarray:
        """Which blocks of a tree may hold a prefix of that level, for each query: prefix that the block's strings
        share, the best symbol of its range after it, the query's largest components for the rest."""
        edge = np.concatenate(([0], self.edges[t], [(1 << 8 * self.symbols) - 1]))
        most = np.sort(np.abs(signed), axis=1)[:, ::-2][:, : self.symbols]
        out = np.zeros((len(signed), len(edge) - 1), bool)
        for b, (lo, hi) in enumerate(zip(edge[:-1], edge[1:])):
            u, k = self.weight * most, 0
            while k < self.symbols and self.symbol(lo, k) == self.symbol(hi, k):
                u[:, k] = self.weight[k] * signed[:, int(self.symbol(lo, k))] if self.symbol(lo, k) < signed.shape[1] else u[:, k]
                k += 1
            if k < self.symbols and (part := signed[:, int(self.symbol(lo, k)) : int(self.symbol(hi, k)) + 1]).shape[1]:
                u[:, k] = self.weight[k] * part.max(1)
            out[:, b] = (np.cumsum(u, axis=1) / self.norm).max(1) >= level - 1e-6
        return out


def on_sphere(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """One component more and length 1, so that the largest inner product is the least distance."""
    length = np.sqrt((x**2).sum(1))
    if query:
        return np.column_stack((x / length[:, None], np.zeros(len(x))))
    return np.column_stack((x / top, np.sqrt(np.maximum(0, 1 - (length / top) ** 2))))


def vectors_of(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, step: int = 512):
    """Row of q, row of x, id and score of each query's k best, ties to smaller ids. A matrix product finds those near
    enough; a pair's score is summed anew so that it is the same in every task."""
    for at in range(0, len(q), step):
        part = q[at : at + step]
        s = part @ x.T
        least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(part), -np.inf)
        slack = 1e-12 * np.sqrt((part**2).sum(1) * (x**2).sum(1).max())
        row, col = np.nonzero(s >= (least - slack)[:, None])
        score = np.concatenate([(part[row[i : i + 65536]] * x[col[i : i + 65536]]).sum(1) for i in range(0, len(row), 65536)])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield row[keep] + at, col[keep], ids[col[keep]], score[keep]


class Tree:
    """One block of a tree: sorted strings, nodes, vectors."""

    def __init__(self, forest: Forest, t: int, strings: np.ndarray, ids: np.ndarray, x: np.ndarray | None, leaf: int):
        order = np.lexsort((ids, strings))
        self.forest, self.t, self.strings, self.ids = forest, t, strings[order], ids[order]
        self.x = None if x is None else x[order]
        depth = forest.depths(self.strings, leaf)
        cut_at = 8 * (forest.symbols - depth)
        prefix = np.where(depth > 0, self.strings >> np.minimum(cut_at, 63), 0)
        begin = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (depth[1:] != depth[:-1]))) if len(depth) else np.zeros(0, int)
        self.depth = depth
        self.begin, self.size, self.node_depth = begin, np.diff(np.append(begin, len(depth))), depth[begin]

    def candidates(self, q: np.ndarray, level: float):
        """For each query (of length 1) the places of the vectors in nodes of that level or a higher one."""
        step = max(1, (1 << 23) // max(1, len(self.begin)))
        for at in range(0, len(q), step):
            z = self.forest.levels(self.forest.signed(q[at : at + step], self.t), self.strings[self.begin], self.node_depth) >= level
            for i in range(len(z)):
                yield at + i, np.flatnonzero(np.repeat(z[i], self.size))

    def best(self, q: np.ndarray, sphere: np.ndarray, top: float, level: float, k: int):
        """(row of q, id, score) of each query's k best candidates, ties to smaller ids, and how many it scored.
        Single precision on scaled vectors finds those near enough; scores are summed anew in double precision."""
        scaled, unit = (self.x / top).astype(np.float32), (q / np.sqrt((q**2).sum(1))[:, None]).astype(np.float32)
        for i, c in self.candidates(sphere, level):
            if len(c) > k:
                s = scaled[c] @ unit[i]
                c = c[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-5]
            score = (self.x[c] * q[i]).sum(1)
            order = np.lexsort((self.ids[c], -score))[:k]
            yield i, self.ids[c[order]], score[order]


def neighbours_of(asked: np.ndarray, ids: np.ndarray, classes: DataFrame, k: int) -> list:
    """Rows (i, c, x) of the k exact neighbours of each asked vector (its own class left out), by one scan."""
    out = pa.schema([("i", pa.int32()), ("c", pa.int64()), ("score", pa.float64()), ("x", pa.list_(pa.float64()))])

    def scan(batches):
        held, found = np.zeros((0, asked.shape[1])), np.zeros(0, np.int64)
        row = np.zeros(0, np.int64)
        for s in slices(batches, 4096):
            x, c = vectors_of(s.column("x")), np.asarray(s.column("least"))
            new = list(best_of(asked, x, c, k + 1))
            row, found, held = np.concatenate([row, *(n[0] for n in new)]), np.concatenate([found, *(n[2] for n in new)]), np.concatenate([held, *(x[n[1]] for n in new)])
            score = (asked[row] * held).sum(1)
            order = np.lexsort((found, -score, row))
            order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k + 1]
            row, found, held = row[order], found[order], held[order]
        if len(row):
            yield record_batch(out, [row.astype(np.int32), found, (asked[row] * held).sum(1), held.tolist()])

    near = classes.select("least", "x").mapInArrow(scan, "i int, c long, score double, x array<double>")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "c"))).where(F.col("n") <= k + 1)
    return [r for r in near.collect() if r.c != ids[r.i]]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES, leaf: int = LEAF, probed: int = PROBED, target: float = TARGET, block: int = BLOCK, effort: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`; with
    `effort`, (q, scored) instead: how many vectors each query's visits to trees scored in all.

    Equal vectors are one class, searched once and expanded to its k + 1 smallest ids (more cannot be among k
    nearest). Null or zero vectors, those with null or non-finite components, of another length than most, and rows
    without an id take no part. Repeated ids with equal vectors count once; an empty table gives an empty result, and
    so does one without queries. A query that holds too few candidates at the measured level ascends further."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    e, kept = F.col("embedding"), "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    v = v.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    v = v.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    size = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], schema)
    v = cut(v.where(F.size("embedding") == size.d).select("vec_id", F.struct(F.xxhash64("embedding").alias("a"), F.hash("embedding").alias("b")).alias("key"), e.cast(kept).alias("x")))
    classes = cut(v.groupBy("key").agg(F.min("vec_id").alias("least"), F.max(F.when(F.col("vec_id") % every == 0, F.lit(1)).otherwise(0)).alias("asks"), F.first("x").alias("x")))
    members = v.select("key", "vec_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    squares = F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    n, asks, top = classes.agg(F.count("*"), F.sum("asks"), F.max(F.sqrt(squares))).first()
    if not asks:
        return spark.createDataFrame([], schema)
    few = lambda rows, m, salt: rows.orderBy(F.xxhash64("least", F.lit(salt)), "least").limit(m).collect()
    sample = np.array([r.x for r in few(classes.select("least", "x"), SAMPLE, 3)], float)
    forest = Forest(on_sphere(sample, top, False), trees, -(-n // block))
    model = spark.sparkContext.broadcast((forest, top))
    item = pa.schema([("least", pa.int64()), ("x", pa.list_(pa.float32() if kept == "array<float>" else pa.float64())), ("t", pa.int32()), ("b", pa.int32()), ("s", pa.int64())])
    ddl = f"least long, x {kept}, t int, b int, s long"

    def place(with_x: bool):
        def run(batches):
            forest, top = model.value
            for a in slices(batches, 4096):
                x = on_sphere(vectors_of(a.column("x")), top, False)
                for t in range(len(forest.turn)):
                    s = forest.strings(x, t)
                    b = np.searchsorted(forest.edges[t], s, "right").astype(np.int32)
                    own = a.column("x").cast(item.field("x").type) if with_x else pa.nulls(len(x), item.field("x").type)
                    yield record_batch(item, [a.column("least"), own, np.full(len(x), t, np.int32), b, s])

        return classes.select("least", "x").mapInArrow(run, ddl)

    strings = place(False).select("least", "t", "b", "s")
    over = cut(strings.groupBy("t", "b").count().where(F.col("count") > 2 * block).select("t", "b", F.ceil(F.col("count") / block).cast("int").alias("parts")))
    split = not over.isEmpty()  # strings that no symbol tells apart: the block in parts, each met by its queries

    def dealt(items: DataFrame) -> DataFrame:
        if not split:
            return items.withColumn("part", F.lit(0))
        return items.join(F.broadcast(over), ["t", "b"], "left").withColumn("part", F.pmod(F.xxhash64("least", F.lit(3)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    asked = few(classes.where("asks = 1").select("least", "x"), probed, 7)
    q, qid = np.array([r.x for r in asked], float), np.array([r.least for r in asked])
    near = neighbours_of(q, qid, classes, k)
    wanted = np.unique([r.c for r in near])
    depth = pa.schema([("t", pa.int32()), ("c", pa.int64()), ("s", pa.int64()), ("depth", pa.int32())])

    def measure(a: pa.Table) -> pa.Table:
        t = a["t"][0].as_py()
        tree = Tree(model.value[0], t, np.asarray(a["s"]), np.asarray(a["least"]), None, leaf)
        on = np.flatnonzero(np.isin(tree.ids, wanted))
        return pa.table([np.full(len(on), t, np.int32), tree.ids[on], tree.strings[on], tree.depth[on].astype(np.int32)], schema=depth)

    level = -np.inf
    if near:
        i, x = np.array([r.i for r in near]), np.array([r.c for r in near])
        reached = np.full(len(near), -np.inf)
        for t, rows in _by(dealt(strings).groupBy("t", "b", "part").applyInArrow(measure, "t int, c long, s long, depth int").collect()).items():
            at = {r.c: r for r in rows}
            s, d = np.array([at[c].s for c in x.tolist()]), np.array([at[c].depth for c in x.tolist()])
            signed = forest.signed(on_sphere(q, top, True), t)
            reached = np.maximum(reached, [forest.levels(signed[a : a + 1], s[j : j + 1], d[j : j + 1])[0, 0] for j, a in enumerate(i.tolist())])
        level = float(np.sort(reached)[max(0, len(reached) - int(np.ceil(target * len(reached))))])
    out = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("score", pa.float64())])

    def search(askers: DataFrame, level: float) -> DataFrame:
        def route(batches):
            forest, top = model.value
            for a in slices(batches, 1024):
                x = on_sphere(vectors_of(a.column("x")), top, True)
                for t in range(len(forest.turn)):
                    row, b = np.nonzero(forest.routes(forest.signed(x, t), t, level))
                    yield record_batch(item, [a.column("least").take(pa.array(row)), a.column("x").take(pa.array(row)).cast(item.field("x").type), np.full(len(row), t, np.int32), b.astype(np.int32), np.zeros(len(row), np.int64)])

        def visit(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return out.empty_table()
            forest, top = model.value
            q, qid, t = vectors_of(left["x"]), np.asarray(left["least"]), left["t"][0].as_py()
            tree = Tree(forest, t, np.asarray(right["s"]), np.asarray(right["least"]), vectors_of(right["x"]), leaf)
            sphere = on_sphere(q, top, True)
            if effort:
                return pa.table([qid, [len(c) for _, c in tree.candidates(sphere, level)], np.zeros(len(qid))], schema=out)
            found = list(tree.best(q, sphere, top, level, k + 1))
            return pa.table([np.repeat(qid[[f[0] for f in found]], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])], schema=out)

        to = askers.select("least", "x").mapInArrow(route, ddl)
        if split:
            to = to.join(F.broadcast(over), ["t", "b"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        else:
            to = to.withColumn("part", F.lit(0))
        to, items = (d.select("least", "x", "t", "b", "s", "part") for d in (to, dealt(place(True))))
        found = to.groupBy("t", "b", "part").cogroup(items.groupBy("t", "b", "part")).applyInArrow(visit, "q long, c long, score double")
        if effort:
            return found.groupBy("q").agg(F.sum("c").alias("scored"))
        # a pair found in several trees has the same score each time
        return found.withColumn("n", F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("n") <= k + 1).select("q", "c", "score").dropDuplicates(["q", "c"])

    askers = classes.where("asks = 1").select("least", "x")
    if effort:
        return search(askers, level)
    best = cut(search(askers, level))
    for lower in (level - 1 / np.sqrt(forest.dims), -np.inf):
        held = best.groupBy("q").count().where(F.col("count") >= min(k + 1, n)).select(F.col("q").alias("least"))
        askers = askers.join(held, "least", "left_anti")
        if askers.isEmpty():
            break
        best = cut(best.unionByName(search(askers, lower)).dropDuplicates(["q", "c"]))
    named = classes.select(F.col("least").alias("c"), "key").join(members, "key").select("c", "vec_id")
    lists = best.join(named, "c").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).select("q", "vec_id", "score")
    askers = v.where(F.col("vec_id") % every == 0).select("key", F.col("vec_id").alias("query_id")).distinct().join(classes.select("key", F.col("least").alias("q")), "key").select("q", "query_id")
    full = askers.join(lists, "q").where("query_id != vec_id")
    return full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by(rows) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.t, []).append(r)
    return out


def op2_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
