"""Queries on local geometry, fits, registration, images, files and streams, with SQL where it can say them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import geometry, grids, images
from ..operators.shared import shared_folder
from ..sources import clouds
from ..streaming import flows
from .spatial import CUST, PART, cloud_cust, cloud_part, read, rounded


def pixels(s, d):
    p = read(s, d, "part").groupBy((F.col("p_partkey") % 3).alias("image_id"), F.col("p_size").alias("y"), (F.col("p_partkey") % 20).alias("x"))
    return p.agg(F.sum(F.col("p_partkey") % 251).alias("v"))


PIX = "(SELECT p_partkey % 3 AS image_id, p_size AS y, p_partkey % 20 AS x, CAST(sum(p_partkey % 251) AS BIGINT) AS v FROM part GROUP BY 1, 2, 3)"


def moved(s, d):
    """The part cloud, turned by 0.01 about z and shifted a little."""
    p = cloud_part(s, d)
    return p.withColumns({"x": F.col("x") - 0.01 * F.col("y") + 0.2, "y": F.col("y") + 0.01 * F.col("x") - 0.1, "z": F.col("z") + 0.05})


def folder(s) -> str:
    base = shared_folder(s)
    return f"{base}/{uuid.uuid4().hex}"


def round_trip(kind):
    def query(s, d):
        to = os.path.join(folder(s), kind)
        p = cloud_part(s, d).select("x", "y", "z")
        clouds.write(p, to, kind, 500)
        return rounded(clouds.read(s, to, kind).select("x", "y", "z"), "x", "y", "z", to=2)

    return query


def planes(s, d):
    model, p = geometry.ransac(cloud_part(s, d), 1.5)
    return p.groupBy("inlier").agg(F.count("*").alias("n"))


#: The reference's own limit (icp.rs, max_iterations); rounds end earlier where the error settles.
ICP_ROUNDS = 50


def aligned(s, d):
    m, e = geometry.icp(moved(s, d), cloud_part(s, d), 3.0, ICP_ROUNDS)
    return s.createDataFrame([(i, *map(float, r), float(e)) for i, r in enumerate(m)], "row int, a double, b double, c double, d double, error double")


def reduction(df):
    """Rows, finite rows, bounds and means of the finite ones."""
    ok = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in grids.XYZ)
    w = {c: F.when(F.expr(ok), F.col(c)) for c in grids.XYZ}
    return df.agg(F.count("*").alias("n"), F.count_if(F.expr(ok)).alias("finite"), *(f(w[c]).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c in grids.XYZ))


def map_diff(base, other, cells: int):
    """Clouds paired by pid in a full join; counts and the largest displacement for each cell of an equal-width grid of
    the base's xy bounds; unpaired points are counted in their own cell."""
    o = other.select("pid", *(F.col(c).alias(f"o{c}") for c in grids.XYZ))
    b = base.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    j = base.join(o, "pid", "full").join(F.broadcast(b))

    def place(c):
        v = F.coalesce(F.col(c), F.col(f"o{c}"))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v - F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(f"lo{c}"))))
        return F.coalesce(F.least(F.floor(share * cells), F.lit(cells - 1)), F.lit(0))

    d = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in grids.XYZ))
    return j.groupBy(place("x").alias("cx"), place("y").alias("cy")).agg(F.count("x").alias("base"), F.count("ox").alias("candidate"), F.count(d).alias("compared"), F.max(F.round(d * 1e6)).cast("long").alias("most_um"))


def stream_voxels(s, d):
    """The events table as a stream of clouds, one pass over what is there, to a table of centroids."""
    to = folder(s)
    src = flows.source(s, f"{d}/events*", s.read.parquet(f"{d}/events.parquet").schema)
    cloud = src.selectExpr("cast(user_id as double) as x", "value as y", "cast(event_id % 10 as double) as z")
    flows.drain(flows.voxels(cloud, 25.0), f"{to}/out", f"{to}/state", "complete")
    return rounded(s.read.parquet(f"{to}/out"), "x", "y", "z")


QUERIES = {
    "normals": lambda s, d: rounded(geometry.normals(cloud_cust(s, d), 4.0), "curvature").select("pid", "curvature"),
    "oriented_normals": lambda s, d: geometry.orient(geometry.normals(cloud_cust(s, d), 4.0), (0, 0, 1000)).where("not isnan(nz)").select("pid", (F.col("nz") * (1000 - F.col("z")) + F.col("nx") * -F.col("x") + F.col("ny") * -F.col("y") >= 0).alias("towards")),
    "iss_keypoints": lambda s, d: rounded(geometry.iss_keypoints(cloud_cust(s, d), 5.0, 3.0), "saliency"),
    "boundary_points": lambda s, d: geometry.boundary(cloud_cust(s, d).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)}), 4.0),
    "oriented_bounding_box": lambda s, d: rounded(geometry.obb(cloud_part(s, d)), "lo", "hi", "ux", "uy", "uz"),
    "range_image": lambda s, d: rounded(geometry.range_image(cloud_cust(s, d), 16, 64, 0.6, -0.6), "range"),
    "ransac_plane": planes,
    "multi_plane": lambda s, d: geometry.multi_plane(cloud_part(s, d), 2.0, 2, 10).groupBy("label").agg(F.count("*").alias("n")),
    "icp": aligned,
    "farthest_points": lambda s, d: geometry.farthest_points(cloud_cust(s, d), 8, 1),
    "descriptor_matches": lambda s, d: rounded(geometry.descriptor_matches(read(s, d, "embeddings").where("vec_id % 50 = 0").selectExpr("vec_id as id", "embedding as values"), read(s, d, "embeddings").selectExpr("vec_id as id", "embedding as values"), 1.0, others=True), "distance"),
    "image_gradient": lambda s, d: images.gradient(pixels(s, d)),
    "image_box_blur": lambda s, d: rounded(images.box_blur(pixels(s, d), 3), "v"),
    "image_gaussian_blur": lambda s, d: rounded(images.gaussian_blur(pixels(s, d), 5, 1.2), "v"),
    "image_erode": lambda s, d: images.morphology(pixels(s, d), "erode"),
    "image_open": lambda s, d: images.morphology(pixels(s, d), "open"),
    "image_tophat": lambda s, d: images.morphology(pixels(s, d), "tophat"),
    "image_threshold": lambda s, d: images.threshold(pixels(s, d), 100),
    "image_otsu": lambda s, d: images.otsu(pixels(s, d)),
    "image_resize": lambda s, d: images.resize_nearest(pixels(s, d), 26, 40, 52, 20),
    "mask_runs": lambda s, d: images.rle(images.threshold(pixels(s, d), 100, 1), 52, 20),
    "mask_runs_back": lambda s, d: images.unrle(images.rle(images.threshold(pixels(s, d), 100, 1), 52, 20), 20).where("v = 1").drop("v"),
    "keypoint_grid": lambda s, d: images.keypoint_grid(read(s, d, "customer").selectExpr("c_custkey as id", "c_acctbal / 100 as x", "cast(c_nationkey as double) as y", "c_acctbal % 7 as response"), 80, 20, 10, 2).select("id", "n"),
    "region_sum": lambda s, d: images.region_sum(grids.integral_image(full(s, d)), 3, 5, 12, 30),
    "position_reduction": lambda s, d: rounded(reduction(cloud_part(s, d)), "mean_x", "mean_y", "mean_z"),
    "map_diff": lambda s, d: map_diff(cloud_part(s, d).where("pid % 7 != 0"), moved(s, d).where("pid % 5 != 0"), 4),
    "octree_levels": lambda s, d: clouds.octree_levels(cloud_part(s, d), 16.0, 3).select("pid", "level"),
    "pcd_round_trip": round_trip("pcd"),
    "ply_round_trip": round_trip("ply"),
    "las_round_trip": round_trip("las"),
    "stream_voxels": stream_voxels,
}


def full(s, d):
    """The pixel image without gaps."""
    grid = s.range(3).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(51))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return grid.join(pixels(s, d), ["image_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


_NEAR = f"FROM {PIX} a JOIN {PIX} b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3"
_ERODED = f"SELECT a.image_id AS image_id, a.y AS y, a.x AS x, min(b.v) AS v {_NEAR}"
_OPEN = f"WITH e AS ({_ERODED}), o AS (SELECT a.image_id AS image_id, a.y AS y, a.x AS x, max(b.v) AS v FROM e a JOIN e b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3)"
_ROUND = f"SELECT round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z FROM {PART}"
_R = "sqrt(x * x + y * y + z * z)"
_MOVED = f"(SELECT pid, x - 0.01 * y + 0.2 AS x, y + 0.01 * x - 0.1 AS y, z + 0.05 AS z FROM {PART})"
SQL = {
    "range_image": f"WITH p AS (SELECT atan2(y, x) AS az, asin(z / {_R}) AS el, {_R} AS r FROM {CUST} WHERE {_R} >= 1e-6), k AS (SELECT CAST(floor((0.6 - el) / 1.2 * 16) AS BIGINT) AS row, CAST(floor((az + pi()) / (2 * pi()) * 64) AS BIGINT) AS col, r FROM p) SELECT row, col, round(min(r), 4) AS range FROM k WHERE row BETWEEN 0 AND 15 AND col BETWEEN 0 AND 63 GROUP BY 1, 2",
    "descriptor_matches": "SELECT a.vec_id AS qid, arg_min(b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS tid, round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id GROUP BY 1",
    "image_gradient": f"SELECT a.image_id AS image_id, a.y AS y, a.x AS x, CAST(sum(b.v * (b.x - a.x) * (2 - abs(b.y - a.y))) AS DOUBLE) AS dx, CAST(sum(b.v * (b.y - a.y) * (2 - abs(b.x - a.x))) AS DOUBLE) AS dy {_NEAR}",
    "image_box_blur": f"SELECT a.image_id AS image_id, a.y AS y, a.x AS x, round(sum(b.v) / 9, 4) AS v {_NEAR}",
    "image_erode": _ERODED,
    "image_open": f"{_OPEN} SELECT * FROM o",
    "image_tophat": f"{_OPEN} SELECT image_id, y, x, p.v - o.v AS v FROM {PIX} p JOIN o USING (image_id, y, x)",
    "image_threshold": f"SELECT image_id, y, x, CASE WHEN v > 100 THEN 255 ELSE 0 END AS v FROM {PIX}",
    "image_otsu": f"WITH c AS (SELECT a.image_id, a.v AS t, count(*) FILTER (b.v <= a.v) AS n0, avg(b.v) FILTER (b.v <= a.v) AS m0, count(*) FILTER (b.v > a.v) AS n1, avg(b.v) FILTER (b.v > a.v) AS m1 FROM (SELECT DISTINCT image_id, v FROM {PIX}) a JOIN {PIX} b USING (image_id) GROUP BY 1, 2) SELECT image_id, arg_max(t, (round(n0 * n1 * (m0 - m1) * (m0 - m1), 6), -t)) AS t FROM c WHERE n1 > 0 GROUP BY 1",
    "mask_runs_back": f"SELECT image_id, CAST(y AS BIGINT) AS y, x FROM {PIX} WHERE v > 100",
    "image_resize": f"SELECT image_id, CAST(r.range AS INTEGER) AS y, CAST(c.range AS INTEGER) AS x, v FROM range(26) r, range(40) c JOIN {PIX} p ON p.y = r.range * 52 // 26 AND p.x = c.range * 20 // 40",
    "keypoint_grid": "SELECT c_custkey AS id, CAST(row_number() OVER (PARTITION BY floor(c_nationkey / 10), floor(c_acctbal / 100 / 10) ORDER BY c_acctbal % 7 DESC, c_custkey) AS INT) AS n FROM customer WHERE c_acctbal >= 0 AND c_acctbal / 100 < 80 AND c_nationkey < 20 QUALIFY n <= 2",
    "region_sum": f"SELECT image_id, CAST(sum(CASE WHEN x BETWEEN 3 AND 11 AND y BETWEEN 5 AND 29 THEN v ELSE 0 END) AS BIGINT) AS total FROM {PIX} GROUP BY 1",
    "position_reduction": f"SELECT count(*) AS n, count(*) AS finite, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, round(avg(z), 4) AS mean_z FROM {PART}",
    "map_diff": f"WITH b AS (SELECT * FROM {PART} WHERE pid % 7 <> 0), o AS (SELECT * FROM {_MOVED} WHERE pid % 5 <> 0), m AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM b), j AS (SELECT b.x AS bx, o.x AS ox, coalesce(b.x, o.x) AS x, coalesce(b.y, o.y) AS y, sqrt((b.x - o.x) * (b.x - o.x) + (b.y - o.y) * (b.y - o.y) + (b.z - o.z) * (b.z - o.z)) AS d FROM b FULL JOIN o USING (pid)) SELECT CAST(least(3, floor(greatest(0, least(1, (x - lx) / (hx - lx))) * 4)) AS BIGINT) AS cx, CAST(least(3, floor(greatest(0, least(1, (y - ly) / (hy - ly))) * 4)) AS BIGINT) AS cy, count(bx) AS base, count(ox) AS candidate, count(d) AS compared, CAST(max(round(d * 1e6)) AS BIGINT) AS most_um FROM j, m GROUP BY 1, 2",
    "octree_levels": f"WITH p AS (SELECT pid, row_number() OVER (PARTITION BY floor(x / 16), floor(y / 16), floor(z / 16) ORDER BY pid) = 1 AS a, row_number() OVER (PARTITION BY floor(x / 8), floor(y / 8), floor(z / 8) ORDER BY pid) = 1 AS b FROM {PART}) SELECT pid, CAST(CASE WHEN a THEN 0 WHEN b THEN 1 ELSE 2 END AS INT) AS level FROM p",
    "pcd_round_trip": _ROUND,
    "ply_round_trip": _ROUND,
    "las_round_trip": _ROUND,
    "stream_voxels": "SELECT CAST(floor(user_id / 25) AS BIGINT) AS ix, CAST(floor(value / 25) AS BIGINT) AS iy, 0::BIGINT AS iz, count(*) AS n, round(avg(user_id), 4) AS x, round(avg(value), 4) AS y, round(avg(event_id % 10), 4) AS z FROM events GROUP BY 1, 2",
}
