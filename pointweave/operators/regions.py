"""Regions of clouds and images: growing over normals, cylinders, pixel components, distances, soft suppression."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components, numbered
from .geometry import XYZ
from .proximity import knn_join
from .shared import cut


def region_growing(points: DataFrame, k: int = 20, smoothness: float = 0.1, curvature: float = 0.05, least: int = 1, most: int = 1 << 62, rounds: int = 1000) -> DataFrame:
    """(pid, label): regions of points with normals and curvature, grown from the flattest unclaimed point on over the k
    nearest whose normals differ by `smoothness` radians at most (either sign); points of more curvature are claimed
    but grow no further, unless they begin a region. Labels count the regions of a fitting size in the order of their
    first points; -1 for the rest. Ties in curvature go to the least pid.

    As flat points come first, a point belongs to the first flat point that reaches it over flat points: least ranks
    run along the links, with jumps over what a rank's own point has met. What no flat point reaches then begins
    regions of its own, each claiming its unclaimed neighbours, in rounds over those links."""
    rank = numbered(points.select(F.struct("curvature", "pid").alias("key")), "key", "rank")
    p = cut(points.join(rank.select(F.col("key.pid").alias("pid"), "rank"), "pid").withColumn("flat", F.col("curvature") <= curvature).select("pid", *XYZ, "nx", "ny", "nz", "rank", "flat"))
    near = knn_join(p, p, k, others=True).select("qid", "pid")
    a = p.select(F.col("pid").alias("qid"), F.col("rank").alias("a"), "flat", *(F.col(f"n{c}").alias(f"a{c}") for c in XYZ))
    b = p.select("pid", F.col("rank").alias("b"), F.col("flat").alias("b_flat"), "nx", "ny", "nz")
    dot = F.abs(sum(F.col(f"a{c}") * F.col(f"n{c}") for c in XYZ))
    links = cut(near.join(a, "qid").join(b, "pid").where(dot >= math.cos(smoothness)).select("a", "b", "flat", "b_flat"))
    label = cut(p.select(F.col("rank").alias("at"), F.when(F.col("flat"), F.col("rank")).alias("own")))
    grow = links.where("flat").select("a", "b")
    for _ in range(rounds):
        low = grow.join(label.withColumnRenamed("at", "a"), "a").groupBy(F.col("b").alias("at")).agg(F.min("own").alias("low"))
        new = label.join(low, "at", "left").select("at", F.col("own").alias("old"), F.least("own", "low").alias("own"))
        jump = label.select(F.col("at").alias("own"), F.col("own").alias("up"))
        new = cut(new.join(jump, "own", "left").select("at", "old", F.least("own", "up").alias("own")))
        if new.where("not (old <=> own)").isEmpty():
            break
        label = new.select("at", "own")
    label = cut(label)
    free = label.where("own is null").select("at")
    rest = links.where("not flat and not b_flat and a < b").join(free.withColumnRenamed("at", "a"), "a", "left_semi").join(free.withColumnRenamed("at", "b"), "b", "left_semi")
    rest = all_rest = cut(rest.select("a", "b").distinct())
    claimed = free.withColumnRenamed("at", "b").where("false")
    for _ in range(rounds):
        if rest.isEmpty():
            break
        first = rest.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = cut(first.select("b").distinct())
        claimed = claimed.unionByName(out)
        rest = cut(rest.join(out, "b", "left_anti").join(out.withColumnRenamed("b", "a"), "a", "left_anti"))
    seeds = free.join(claimed.withColumnRenamed("b", "at"), "at", "left_anti")
    taken = all_rest.join(seeds.withColumnRenamed("at", "a"), "a", "left_semi").groupBy(F.col("b").alias("at")).agg(F.min("a").alias("by"))
    full = cut(label.join(taken, "at", "left").select(F.col("at").alias("rank"), F.coalesce("own", "by", "at").alias("region")))
    size = full.groupBy("region").count().where(F.col("count").between(least, most)).select("region")
    names = numbered(size, "region", "label")
    return p.select("pid", "rank").join(full.join(names, "region", "left"), "rank").select("pid", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def _cylinder(p: np.ndarray, n: np.ndarray):
    """Point of the axis, its direction and the radius, of two points with normals."""
    axis = np.cross(n[0], n[1])
    size = np.linalg.norm(axis)
    if size < 1e-6:
        return None
    axis /= size
    flat = lambda v: v - axis * (v @ axis)
    u, v, d = flat(n[0]), flat(n[1]), flat(p[1] - p[0])
    m = np.stack([u, -v], 1)
    t = np.linalg.lstsq(m, d, rcond=None)[0]
    centre = p[0] + u * t[0]
    return (*map(float, centre), *map(float, axis), float(np.linalg.norm(flat(p[0] - centre))))


def cylinder_residual(m):
    d = [F.col(a) - m[k] for k, a in enumerate(XYZ)]
    along = sum(d[k] * m[3 + k] for k in range(3))
    return F.abs(F.sqrt(sum((d[k] - along * m[3 + k]) * (d[k] - along * m[3 + k]) for k in range(3))) - m[6])


def ransac_cylinder(points: DataFrame, threshold: float, low: float = 0.0, high: float = float("inf"), tries: int = 128, least: int = 2, seed: int = 42):
    """(model, points with `inlier`): cylinders through two hash-drawn points with normals, of a radius from low to high,
    all counted in one pass; the first with the most inliers wins. model: axis point, direction, radius; fewer than
    `least` inliers raise."""
    rows = points.select(*XYZ, "nx", "ny", "nz", F.xxhash64("pid", F.lit(seed)).alias("h")).orderBy("h", *XYZ).limit(2 * tries).collect()
    p, n = (np.array([[r[c] for c in names] for r in rows], float).reshape(-1, 3) for names in (XYZ, ("nx", "ny", "nz")))
    rng, models = np.random.default_rng(seed), []
    for _ in range(tries if len(p) > 1 else 0):
        at = rng.choice(len(p), 2, replace=False)
        m = _cylinder(p[at], n[at])
        if m and np.isfinite(m).all() and low <= m[6] <= high:
            models.append(m)
    votes = points.agg(*(F.count_if(cylinder_residual(m) <= threshold).alias(f"v{i}") for i, m in enumerate(models))).first() if models else []
    best = max(range(len(models)), key=lambda i: (votes[i], -i), default=None)
    if best is None or votes[best] < least:
        raise ValueError(f"no cylinder has {least} inliers")
    return models[best], points.withColumn("inlier", F.coalesce(cylinder_residual(models[best]) <= threshold, F.lit(False)))


def image_components(mask: DataFrame, width: int, diagonal: bool = False) -> DataFrame:
    """(image_id, label, area, x0, y0, x1, y1, cx, cy) of the on pixels (image_id, y, x) of masks `width` wide, joined by
    sides, or corners too; labels from 1 in the order of first pixels by rows; boxes end behind the last pixel."""
    p = mask.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    high = p.agg(F.max("y")).first()[0]
    one = (int(high or 0) + 1) * width
    p = cut(p.withColumn("id", F.col("image_id") * one + F.col("y") * width + F.col("x")))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    to = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps))
    links = p.select("image_id", F.col("id").alias("a"), F.explode(to).alias("t")).select("image_id", "a", "t.y", "t.x").join(p.withColumnRenamed("id", "b"), ["image_id", "y", "x"]).select("a", "b")
    root = p.join(components(links), p.id == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    stats = cut(root.groupBy("image_id", "root").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy")))
    place = numbered(stats.select("root"), "root", "n")
    first = stats.join(place, "root").groupBy("image_id").agg(F.min("n").alias("base"))
    return stats.join(place, "root").join(first, "image_id").select("image_id", (F.col("n") - F.col("base") + 1).alias("label"), "area", "x0", "y0", "x1", "y1", "cx", "cy")


def distance_transform(mask: DataFrame, sy: float = 1.0, sx: float = 1.0) -> DataFrame:
    """(image_id, y, x, distance) of every pixel (image_id, y, x, v) of images without gaps: the exact distance to the nearest pixel of value 0
    of its image, 0 there, infinite if it has none; sy, sx: a pixel's height and width. Distances within columns by
    windows, then each row's minimum over its pixels, a row at a time."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id", "x").orderBy("y")
    off = F.when(F.col("v") == 0, F.col("y"))
    up, down = F.last(off, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(off, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("y") - up, down - F.col("y"))
    rows = mask.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(gap * sy, F.lit(float("inf"))).alias("g"))
    schema = pa.schema([("image_id", pa.int64()), ("y", pa.int64()), ("x", pa.int64()), ("distance", pa.float64())])

    def least(t: pa.Table) -> pa.Table:
        x, g = t["x"].to_numpy(), t["g"].to_numpy()
        out = np.full(len(x), np.inf)
        for s in range(0, len(x), 256):
            out[s : s + 256] = np.sqrt(((x[s : s + 256, None] - x[None, :]) * sx) ** 2 + g[None, :] ** 2).min(1)
        return pa.table([t["image_id"].cast(pa.int64()), t["y"], t["x"], out], schema=schema)

    return rows.groupBy("image_id", "y").applyInArrow(least, "image_id long, y long, x long, distance double")


def soft_nms(df: DataFrame, score_threshold: float, iou_threshold: float = 0.3, method: str = "linear", sigma: float = 0.5) -> DataFrame:
    """(image_id, id, score, ord): the best box is taken, again and again, and the scores of those that overlap it decay:
    hard (to zero) or linear (by one less the overlap) above the overlap threshold, gaussian by exp(-overlap^2 / sigma);
    scores below the threshold end it. Equal scores go to the least id. An image is worked on by one task, as each
    choice depends on all before."""
    if method not in ("hard", "linear", "gaussian") or not 0 < sigma < float("inf"):
        raise ValueError("method hard, linear or gaussian, with a positive sigma")
    schema = pa.schema([("image_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("ord", pa.int64())])

    def choose(t: pa.Table) -> pa.Table:
        ids, score = t["id"].to_numpy(), t["score"].to_numpy().astype(float)
        order = np.argsort(ids, kind="stable")
        ids, score = ids[order], score[order].copy()
        b = np.column_stack([t[c].to_numpy().astype(float)[order] for c in ("x0", "y0", "x1", "y1")])
        area, alive, out = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), score >= score_threshold, []
        while alive.any():
            k = int(np.where(alive, score, -np.inf).argmax())
            out.append((ids[k], score[k]))
            alive[k] = False
            common = np.prod(np.maximum(np.minimum(b[k, 2:], b[:, 2:]) - np.maximum(b[k, :2], b[:, :2]), 0), axis=1)
            union = area[k] + area - common
            iou = np.where(union > 0, common / np.where(union > 0, union, 1), 0)
            if method == "gaussian":
                score *= np.exp(-(iou**2) / sigma)
            else:
                score *= np.where(iou > iou_threshold, 0.0 if method == "hard" else 1 - iou, 1.0)
            alive &= score >= score_threshold
        image = t["image_id"][0].as_py()
        return pa.table([pa.array([image] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64()), pa.array(range(len(out)), pa.int64())], schema=schema)

    return df.select("image_id", "id", "score", "x0", "y0", "x1", "y1").groupBy("image_id").applyInArrow(choose, "image_id long, id long, score double, ord long")
