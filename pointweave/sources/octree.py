"""Octree tables: clouds as Parquet partitioned by level and cell, read by bounds, level and node.

A cloud's cube is halved along each axis again and again. A point lies at the first level at which it is the one of
least pid of its voxel (spacing / 2**level), or at the last level. A node is the cube of a level that holds a point's
voxel; a folder is a level and a coarse cell, so that a scan opens only folders that a query meets, and Parquet's own
statistics prune within them. The index (bounds and number of points of each node) is a table of its own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

XYZ = ("x", "y", "z")


def _put(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def info(spark: SparkSession, path: str) -> dict:
    """Cube (low corner and side), root spacing, levels, points and folders' grid, without reading points."""
    return json.loads(spark.read.text(f"{path}/info").first()[0])


def _cell(a: str, head: dict, parts: int):
    """Which of `parts` equal parts of the cube's side a coordinate lies in; the far side belongs to the last."""
    return F.least(F.lit(parts - 1), F.floor((F.col(a) - head["low"][XYZ.index(a)]) / head["side"] * parts)).cast("int")


def write(points: DataFrame, path: str, levels: int = 6, spacing: float | None = None, grid: int = 4) -> dict:
    """Writes pid, x, y, z and all other columns; returns the header. Points without finite coordinates raise. spacing:
    that of level 0 (default: a 32nd of the cube's side); grid: folders' cells along each side."""
    ok = F.lit(True)
    for a in XYZ:
        ok &= F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a)) < float("inf"))
    row = points.agg(F.count("*").alias("n"), F.sum(F.when(ok, 0).otherwise(1)).alias("bad"), *(f(a).alias(f"{n}_{a}") for a in XYZ for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if not row.n or row.bad:
        raise ValueError("an octree needs points, all of finite coordinates")
    side = max(float(row[f"hi_{a}"] - row[f"lo_{a}"]) for a in XYZ) or 1.0
    head = {"low": [float(row[f"lo_{a}"]) for a in XYZ], "side": side, "spacing": float(spacing or side / 32), "levels": levels, "points": row.n, "grid": grid}
    p = points
    for k in range(levels - 1):  # the first of each voxel, and of its coarser ones, is where a level begins
        voxel = [F.floor((F.col(a) - lo) / (head["spacing"] / 2**k)) for a, lo in zip(XYZ, head["low"])]
        p = p.withColumn(f"_k{k}", F.struct(*(v.alias(a) for a, v in zip(XYZ, voxel))))
    firsts = [p.groupBy(f"_k{k}").agg(F.min("pid").alias("pid")).select("pid", F.lit(k).alias("_at")) for k in range(levels - 1)]
    level = None
    for f in firsts:
        level = f if level is None else level.unionByName(f)
    found = level.groupBy("pid").agg(F.min("_at").alias("level")) if level is not None else points.select("pid", F.lit(0).alias("level"))
    p = points.join(found, "pid", "left").withColumn("level", F.coalesce("level", F.lit(levels - 1)))
    for a in XYZ:
        p = p.withColumn(f"g{a}", _cell(a, head, grid))
        p = p.withColumn(f"n{a}", F.least(F.pow(F.lit(2), "level").cast("int") - 1, F.floor((F.col(a) - head["low"][XYZ.index(a)]) / side * F.pow(F.lit(2.0), "level"))).cast("int"))
    p = p.withColumn("cell", F.concat_ws("-", "gx", "gy", "gz")).withColumn("node", F.concat_ws("-", "level", "nx", "ny", "nz")).drop("gx", "gy", "gz", "nx", "ny", "nz")
    # rows of a folder in a few sorted files: a hot folder is spread by node and pid
    p.repartitionByRange(F.col("level"), F.col("cell"), F.col("node"), F.col("pid")).sortWithinPartitions("level", "cell", "node").write.mode("overwrite").partitionBy("level", "cell").parquet(f"{path}/points")
    written = points.sparkSession.read.parquet(f"{path}/points")
    nodes = written.groupBy("node", F.col("level").cast("int").alias("level"), F.col("cell").cast("string").alias("cell")).agg(F.count("*").alias("points"), *(f(a).alias(f"{n}_{a}") for a in XYZ for n, f in (("min", F.min), ("max", F.max))))
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    _put(points.sparkSession, f"{path}/info", json.dumps(head))
    return head


def level_for(head: dict, resolution: float) -> int:
    """The first level whose spacing is `resolution` or finer, the last if none is."""
    if not 0 < resolution < float("inf"):
        raise ValueError("resolution must be positive and finite")
    return next((k for k in range(head["levels"]) if head["spacing"] / 2**k <= resolution), head["levels"] - 1)


def read(spark: SparkSession, path: str, low=None, high=None, resolution: float | None = None) -> DataFrame:
    """Points of a box (ends included) and of the levels that a resolution asks for; folders outside are not listed in
    the plan's partitions, and x, y, z are filtered at the scan."""
    head = info(spark, path)
    p = spark.read.parquet(f"{path}/points")
    if resolution is not None:
        p = p.where(F.col("level") <= level_for(head, resolution))
    if low is not None:
        ranges = []
        for a, lo, hi, at in zip(XYZ, low, high, head["low"]):
            p = p.where(F.col(a).between(lo, hi))
            part = lambda v, at=at: min(head["grid"] - 1, max(0, int((v - at) // (head["side"] / head["grid"]))))
            ranges.append(range(part(lo), part(hi) + 1) if hi >= at and lo <= at + head["side"] else range(0))
        p = p.where(F.col("cell").isin([f"{x}-{y}-{z}" for x in ranges[0] for y in ranges[1] for z in ranges[2]]))
    return p


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node, level, cell, points, min_*, max_*): the hierarchy; a node that two folders share has a row for each."""
    return spark.read.parquet(f"{path}/nodes")


def read_node(spark: SparkSession, path: str, node: str) -> DataFrame:
    """One node's points: its level's folder, its cells' folders, its rows."""
    cells = [r.cell for r in nodes(spark, path).where(F.col("node") == node).select("cell").collect()]
    return spark.read.parquet(f"{path}/points").where((F.col("level") == int(node.split("-")[0])) & F.col("cell").isin(cells) & (F.col("node") == node))


def chosen(index: DataFrame, distance, budget_points: int, budget_nodes: int) -> DataFrame:
    """Nodes to show: by error on screen (column error, largest first, then node), each taken if the points and nodes
    taken so far leave room for it, passed over if not. `distance` makes the error column of the index. The walk is in
    order by nature, so one task folds over the nodes (not the points)."""
    ranked = index.groupBy("node").agg(F.sum("points").alias("points"), F.min("level").alias("level"), *(f(c).alias(c) for a in XYZ for c, f in ((f"min_{a}", F.min), (f"max_{a}", F.max))))
    ranked = ranked.withColumn("error", distance).select("node", "error", "points")

    def walk(parts):
        import pandas as pd

        rows = pd.concat(list(parts)).sort_values(["error", "node"], ascending=[False, True])
        left, out = budget_points, []
        for r in rows.itertuples():
            if len(out) == budget_nodes:
                break
            if r.points <= left:
                left -= r.points
                out.append((r.node, len(out), r.points))
        yield pd.DataFrame(out, columns=["node", "ord", "points"])

    return ranked.coalesce(1).mapInPandas(walk, "node string, ord long, points long")
