"""Selecting, labelling and merging clouds; chunks, receipts, trajectories, graphs and scenes as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from ..functions import robust
from .grids import voxel_keys
from .shared import cut

XYZ = ("x", "y", "z")


def extract_indices(points: DataFrame, indices: DataFrame, key: str = "pid") -> DataFrame:
    """A row for each row of indices (ord, key), with the point of that key; repeated indices repeat the point. An
    index without a point raises when its row is computed."""
    found = indices.select("ord", key).join(points.withColumn("_there", F.lit(True)), key, "left")
    ok = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no point of index "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return found.where(ok).select("ord", *points.columns)


def extract_mask(points: DataFrame, mask: str) -> DataFrame:
    """Rows whose mask column is true; null is false."""
    return points.where(F.coalesce(F.col(mask).cast("boolean"), F.lit(False))).drop(mask)


def with_labels(points: DataFrame, labels: DataFrame, name: str = "label", key: str = "pid") -> DataFrame:
    """Adds or replaces an int column from labels (key, name); a point without a label has null."""
    return points.drop(name).join(labels.select(key, F.col(name).cast("int").alias(name)), key, "left")


def merge_clouds(*clouds: DataFrame) -> DataFrame:
    """All rows of clouds of one schema (names and types), with the cloud's place as `cloud`."""
    want = [(f.name, f.dataType) for f in clouds[0].schema]
    out = None
    for n, c in enumerate(clouds):
        if [(f.name, f.dataType) for f in c.schema] != want:
            raise ValueError(f"cloud {n} has another schema")
        c = c.withColumn("cloud", F.lit(n))
        out = c if out is None else out.unionByName(c)
    return out


def voxel_mixed(df: DataFrame, leaf: float, average: tuple[str, ...] = (), first: tuple[str, ...] = (), positions: str = "centroid", origin=None, key: str = "pid") -> DataFrame:
    """One row for each voxel: positions by centroid or first point, attributes by average or first point, each as
    stated. The first point is that of the least key; a key and its attributes move together."""
    if positions not in ("centroid", "first"):
        raise ValueError(positions)
    own = voxel_keys(df, leaf, origin) if origin is not None else voxel_keys(df, leaf)
    mean = [*(XYZ if positions == "centroid" else ()), *average]
    keep = [*(XYZ if positions == "first" else ()), *first]
    aggs = [F.count("*").alias("n"), *(F.avg(c).alias(c) for c in mean)]
    if keep:
        aggs.append(F.min_by(F.struct(*keep), F.col(key)).alias("_first"))
    out = own.groupBy("ix", "iy", "iz").agg(*aggs)
    return out.select("ix", "iy", "iz", "n", *mean, *(F.col(f"_first.{c}").alias(c) for c in keep))


def chunk_bounds(df: DataFrame, chunk: str) -> DataFrame:
    """Box and size of each chunk: the zone map that a scan is pruned by."""
    return df.groupBy(chunk).agg(F.count("*").alias("n"), *(f(a).alias(f"{n}_{a}") for a in XYZ for n, f in (("min", F.min), ("max", F.max))))


def chunks_within(df: DataFrame, zones: DataFrame, chunk: str, low, high) -> DataFrame:
    """Points in a box, from the chunks whose own box meets it only."""
    meets = F.lit(True)
    inside = F.lit(True)
    for a, lo, hi in zip(XYZ, low, high):
        meets &= (F.col(f"max_{a}") >= lo) & (F.col(f"min_{a}") <= hi)
        inside &= F.col(a).between(lo, hi)
    return df.join(zones.where(meets).select(chunk), chunk, "left_semi").where(inside)


def transfer_totals(df: DataFrame, direction: str = "direction", size: str = "bytes") -> DataFrame:
    return df.groupBy(direction).agg(F.count("*").alias("transfers"), F.sum(size).alias("bytes"))


def eval_report(df: DataFrame, metrics: dict) -> DataFrame:
    """(name, value) rows of aggregates, in one pass."""
    one = df.agg(*(c.cast("double").alias(n) for n, c in metrics.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in metrics))).alias("m")).select("m.*")


def trajectory_push(df: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """Adds accepted: a sample pushed after one with a larger time stamp is refused (and doesn't count further)."""
    before = F.max(time).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("accepted", F.coalesce(F.col(time) >= before, F.lit(True)))


def episode_reversed(df: DataFrame, key: str, time: str, ordinal: str) -> DataFrame:
    """Records read backwards and put in the order of time again: equal times swap their order. Adds `ord` from 0."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(time, F.desc(ordinal))) - 1)


def valid_surfels(df: DataFrame) -> DataFrame:
    """Surfels with a positive finite radius and a normal of some length."""
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return df.where((F.col("radius") > 0) & (F.col("radius") < float("inf")) & (length > 0) & (length < float("inf")))


def tsdf(points: DataFrame, sensor, voxel: float, truncation: float, dims, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """(ix, iy, iz, distance, weight) of the voxels that points touch: the mean of the signed distances along the view
    ray, clamped to the truncation, over the points within whose band (clamped to the grid) the voxel lies. Points at
    the sensor or without a finite depth count nowhere."""
    gap = [F.col(a) - s for a, s in zip(XYZ, sensor)]
    depth = F.sqrt(sum(g * g for g in gap))
    p = points.select(*XYZ, *(g.alias(f"_r{a}") for a, g in zip(XYZ, gap)), depth.alias("_d")).where((F.col("_d") > 1e-5) & (F.col("_d") < float("inf")))
    for a, o, n in zip(XYZ, origin, dims):
        at = lambda shift, a=a, o=o, n=n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(a) + shift - o) / voxel)))
        p = p.withColumn(f"i{a}", F.explode(F.sequence(at(-truncation), at(truncation))))
    sdf = sum((F.col(a) - (o + (F.col(f"i{a}") + 0.5) * voxel)) * F.col(f"_r{a}") / F.col("_d") for a, o in zip(XYZ, origin))
    p = p.withColumn("_s", F.greatest(F.lit(-truncation), F.least(F.lit(truncation), sdf)))
    return p.groupBy("ix", "iy", "iz").agg(F.avg("_s").alias("distance"), F.count("*").alias("weight"))


def topological_order(nodes: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(id, level) of nodes (id) under edges (from_id, to_id): a node's level is one more than the highest before it; a
    schedule takes levels in order and ids within. A cycle, or an edge to an unknown node, raises."""
    ids = edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id"))).distinct()
    if not ids.join(nodes, "id", "left_anti").isEmpty():
        raise ValueError("an edge ends at an unknown node")
    left, rest, out, level = cut(nodes.select("id").distinct()), cut(edges.select("from_id", "to_id").distinct()), None, 0
    while level < rounds:
        ready = cut(left.join(rest.select(F.col("to_id").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        out = ready if out is None else out.unionByName(ready)
        if ready.isEmpty():
            if left.isEmpty():
                return out
            break
        gone = ready.select("id")
        left = cut(left.join(gone, "id", "left_anti"))
        rest = cut(rest.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti"))
        level += 1
    raise ValueError("the graph has a cycle")


def nodes_query(index: DataFrame, chosen: DataFrame, resolution: float) -> DataFrame:
    """One box around the chosen nodes (id) of an index (id, min_*, max_*), with the resolution to read it at."""
    if not 0 < resolution < float("inf"):
        raise ValueError("resolution must be positive and finite")
    got = index.join(chosen.select("id").distinct(), "id", "left_semi")
    return got.agg(*(f(f"{n}_{a}").alias(f"{n}_{a}") for a in XYZ for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("nodes")).withColumn("resolution", F.lit(float(resolution)))


def packet_topic(packets: DataFrame, asked: DataFrame) -> DataFrame:
    """(sequence, topic) of asked sequences; one without a packet raises when its row is computed."""
    found = asked.select("sequence").join(packets.select("sequence", F.col("source_topic").alias("topic")), "sequence", "left")
    return found.withColumn("topic", F.coalesce("topic", F.raise_error(F.lit("packet sequence is missing"))))


def localize(nodes: DataFrame, edges: DataFrame, root, rounds: int = 10_000, least: float = 1e-4) -> DataFrame:
    """(id, rotation, translation): poses propagated from the root along edges (from_id, to_id, rotation, translation,
    loop_closure) that close no loop, each pose being the edge's motion after the pose before; a node that no path
    reaches keeps its own. Nodes: (id, rotation, translation). Rounds go on while a pose moves by more than `least`;
    of several edges into a node the one from the least id counts."""
    e = cut(edges.where("not loop_closure").select("from_id", "to_id", F.col("rotation").alias("er"), F.col("translation").alias("et")))
    pose = cut(nodes.select("id", "rotation", "translation", (F.col("id") == F.lit(root)).alias("set")))
    for _ in range(rounds):
        near = e.join(pose.where("set").select(F.col("id").alias("from_id"), "rotation", "translation"), "from_id")
        r, t = robust.compose(F.col("er"), F.col("et"), F.col("rotation"), F.col("translation"))
        new = near.groupBy(F.col("to_id").alias("id")).agg(F.min_by(F.struct(r.alias("r"), t.alias("t")), F.col("from_id")).alias("new"))
        gap = F.sqrt(sum((F.col("new.t")[k] - F.col("translation")[k]) ** 2 for k in range(3)))
        moves = F.col("new").isNotNull() & (F.col("id") != F.lit(root)) & (~F.col("set") | (gap > least))
        step = pose.join(new, "id", "left").withColumn("moves", moves)
        step = cut(step.select("id", *(F.when(F.col("moves"), F.col(f"new.{n}")).otherwise(F.col(c)).alias(c) for c, n in (("rotation", "r"), ("translation", "t"))), (F.col("set") | F.col("moves")).alias("set"), "moves"))
        pose = step.drop("moves")
        if step.where("moves").isEmpty():
            return pose.drop("set")
    raise RuntimeError("poses did not settle")


def as_metrics(df: DataFrame) -> DataFrame:
    """(name, value): count and mean of each numeric column, for a report."""
    nums = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    return eval_report(df, {f"{c}_{n}": f(c) for c in nums for n, f in (("count", F.count), ("mean", F.avg))})
