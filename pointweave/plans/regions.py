"""Queries on regions, features, registration and sources, with SQL where it can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import geometry, regions, registration
from ..operators.shared import shared_folder
from ..sources import octree
from .more import detections
from .shapes import PIX, full, moved, pixels
from .spatial import PART, cloud_cust, cloud_part, rounded


def tree(s, d) -> str:
    to = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    octree.write(cloud_part(s, d), to, levels=4, spacing=16.0)
    return to


def node_scan(s, d):
    to = tree(s, d)
    node = octree.nodes(s, to).groupBy("node").agg(F.sum("points").alias("n")).orderBy(F.desc("n"), "node").first().node
    return octree.read_node(s, to, node).select("pid", "x", "y", "z")


def grown(s, d):
    n = geometry.normals(cloud_cust(s, d), 4.0).where("not isnan(nx) and curvature is not null")
    return regions.region_growing(n, 8, 0.6, 0.15, 3)


def described(s, d):
    n = geometry.normals(cloud_cust(s, d), 4.0).where("not isnan(nx)")
    f = registration.fpfh(n, 4.0)
    return f.select("pid", *(F.round(F.aggregate(F.slice("values", 11 * k + 1, 11), F.lit(0.0), lambda a, x: a + x), 3).alias(f"total{k}") for k in range(3)))


def feature_matches(s, d):
    """Each descriptor's nearest other one."""
    n = geometry.normals(cloud_cust(s, d), 4.0).where("not isnan(nx)")
    f = registration.fpfh(n, 4.0).select(F.col("pid").alias("id"), "values")
    return geometry.descriptor_matches(f, f, 2.0, others=True).select("qid", "tid")


def aligned(how):
    def run(s, d):
        t, _ = how(cloud_part(s, d), moved(s, d))
        return s.createDataFrame([(i, j, round(float(t[i, j]), 3)) for i in range(3) for j in range(4)], "i int, j int, v double")

    return run


QUERIES = {
    "octree_bounds": lambda s, d: octree.read(s, tree(s, d), (5, 0, 1), (45, 190, 14)).select("pid", "x", "y", "z"),
    "octree_resolution": lambda s, d: octree.read(s, tree(s, d), (5, 0, 1), (45, 190, 14), 8.0).select("pid", F.col("level").cast("int").alias("level")),
    "octree_header": lambda s, d: s.createDataFrame([(h["points"], h["side"], h["spacing"], *h["low"]) for h in [octree.info(s, tree(s, d))]], "points long, side double, spacing double, x double, y double, z double"),
    "octree_nodes": lambda s, d: octree.nodes(s, tree(s, d)).groupBy("level").agg(F.sum("points").alias("points")),
    "octree_node": node_scan,
    "octree_choice": lambda s, d: octree.chosen(octree.nodes(s, tree(s, d)), F.pow(F.lit(0.5), "level") * 100, 120, 12),
    "region_growing": grown,
    "fpfh_totals": described,
    "feature_nearest": feature_matches,
    "gicp": aligned(lambda a, b: registration.gicp(a, b, 6.0, 8, 6)),
    "ndt": aligned(lambda a, b: registration.ndt(a, b, 20.0, 6)),
    "moving_least_squares": lambda s, d: rounded(registration.smoothed(cloud_cust(s, d), 4.0, 0), "x", "y", "z"),
    "soft_nms": lambda s, d: rounded(regions.soft_nms(detections(s, d), 150.0, 0.4), "score"),
    "image_components": lambda s, d: rounded(regions.image_components(pixels(s, d).where("v > 100"), 20, True), "cx", "cy"),
    "distance_transform": lambda s, d: rounded(regions.distance_transform(full(s, d).withColumn("v", F.when(F.col("v") > 100, 1).otherwise(0))), "distance"),
}
_LOW = f"(SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM {PART})"
_VOXEL = "floor((x - lx) / {0}), floor((y - ly) / {0}), floor((z - lz) / {0})"
_LEVELS = f"""(SELECT pid, x, y, z, CASE WHEN row_number() OVER (PARTITION BY {_VOXEL.format(16)} ORDER BY pid) = 1 THEN 0 WHEN row_number() OVER (PARTITION BY {_VOXEL.format(8)} ORDER BY pid) = 1 THEN 1
WHEN row_number() OVER (PARTITION BY {_VOXEL.format(4)} ORDER BY pid) = 1 THEN 2 ELSE 3 END AS level FROM {PART}, {_LOW})"""
_BOX = "x BETWEEN 5 AND 45 AND y BETWEEN 0 AND 190 AND z BETWEEN 1 AND 14"
SQL = {
    "octree_bounds": f"SELECT * FROM {PART} WHERE {_BOX}",
    "octree_resolution": f"SELECT pid, level FROM {_LEVELS} WHERE {_BOX} AND level <= 1",
    "octree_header": f"SELECT (SELECT count(*) FROM part) AS points, side, 16.0::DOUBLE AS spacing, lx AS x, ly AS y, lz AS z FROM {_LOW}",
    "octree_nodes": f"SELECT level, count(*) AS points FROM {_LEVELS} GROUP BY 1",
    "image_components": f"""WITH RECURSIVE p AS (SELECT image_id, y, x, row_number() OVER (ORDER BY image_id, y, x) AS id FROM {PIX} WHERE v > 100),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r(a, b) AS (SELECT id, id FROM p UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS root FROM r GROUP BY 1)
SELECT image_id, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label, count(*) AS area, CAST(min(x) AS BIGINT) AS x0, CAST(min(y) AS BIGINT) AS y0, CAST(max(x) + 1 AS BIGINT) AS x1, CAST(max(y) + 1 AS BIGINT) AS y1, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy FROM p JOIN c USING (id) GROUP BY image_id, root""",
    "distance_transform": f"""WITH f AS (SELECT i.range AS image_id, r.range AS y, c.range AS x, coalesce(v, 0) > 100 AS lit FROM range(3) i, range(52) r, range(20) c LEFT JOIN {PIX} p ON p.image_id = i.range AND p.y = r.range AND p.x = c.range)
SELECT a.image_id, a.y, a.x, round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 4) AS distance FROM f a JOIN f b ON a.image_id = b.image_id AND NOT b.lit GROUP BY 1, 2, 3""",
}
