"""Spatial queries over the driver's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, points, proximity, timeline


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cloud_li(spark, sf):
    return read(spark, sf, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as pid", "l_quantity as x", "l_extendedprice / 1000 as y", "l_discount * 100 as z", "l_tax as intensity")


def cloud_part(spark, sf):
    return read(spark, sf, "part").selectExpr("p_partkey as pid", "cast(p_size as double) as x", "p_retailprice - 900 as y", "cast(p_partkey % 17 as double) as z")


def cloud_cust(spark, sf):
    return read(spark, sf, "customer").selectExpr("c_custkey as pid", "c_acctbal / 100 as x", "cast(c_nationkey as double) as y", "cast(c_custkey % 10 as double) as z")


LI = "(SELECT l_orderkey, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_tax AS intensity FROM lineitem)"
PART = "(SELECT p_partkey AS pid, CAST(p_size AS DOUBLE) AS x, p_retailprice - 900 AS y, CAST(p_partkey % 17 AS DOUBLE) AS z FROM part)"
CUST = "(SELECT c_custkey AS pid, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y, CAST(c_custkey % 10 AS DOUBLE) AS z FROM customer)"
EVENTS = "(SELECT event_id AS id, event_type AS topic, user_id, value, epoch_us(ts) * 1000 AS ts_ns FROM events)"


def stamped(spark, sf):
    return read(spark, sf, "events").selectExpr("event_id as id", "event_type as topic", "user_id", "value", "unix_micros(cast(ts as timestamp)) * 1000 as ts_ns")


def rounded(df, *cols, to=4):
    return df.withColumns({c: F.round(c, to) for c in cols})


QUERIES = {
    "voxel_centroid": lambda s, d: rounded(grids.voxel_centroid(cloud_li(s, d), 4.0, ("intensity",), (0, 0, 0)), "x", "y", "z", "intensity", to=8),
    "occupancy_grid": lambda s, d: grids.occupancy(cloud_li(s, d), 5.0),
    "crop_box": lambda s, d: points.crop_box(cloud_part(s, d), (10, 20, 2), (40, 90, 12)),
    "crop_box_inverted": lambda s, d: points.crop_box(cloud_part(s, d), (10, 20, 2), (40, 90, 12), True),
    "pass_through": lambda s, d: points.pass_through(cloud_part(s, d), "x", 5, 25),
    "affine_transform": lambda s, d: rounded(points.affine(cloud_part(s, d), ((0, -1, 0, 1), (1, 0, 0, 2), (0, 0, 2, 3))), "x", "y", "z"),
    "recenter": lambda s, d: rounded(points.recenter(cloud_part(s, d)), "x", "y", "z"),
    "unit_sphere": lambda s, d: rounded(points.unit_sphere(cloud_part(s, d)), "x", "y", "z"),
    "scale_points": lambda s, d: rounded(points.scale(cloud_part(s, d), 2.5), "x", "y", "z"),
    "camera_project": lambda s, d: rounded(points.camera_project(cloud_part(s, d), 500, 500, 320, 240), "u", "v"),
    "bounds": lambda s, d: rounded(grids.bounds(cloud_li(s, d)), "min_y", "max_y", "min_z", "max_z"),
    "voxel_first": lambda s, d: grids.voxel_first(cloud_part(s, d), 8.0),
    "ndt_cells": lambda s, d: (lambda c: rounded(c.where("n >= 3"), *(x for x in c.columns if x[:3] in ("cov", "mea"))))(grids.covariance(grids.voxel_keys(cloud_part(s, d), 20.0, (0, 0, 0)), ("ix", "iy", "iz"))),
    "histogram": lambda s, d: grids.histogram(stamped(s, d), "value", 0, 500, 16),
    "radius_join": lambda s, d: rounded(proximity.radius_join(cloud_cust(s, d), cloud_cust(s, d), 3.0), "d2"),
    "knn_join": lambda s, d: rounded(proximity.knn_join(cloud_cust(s, d), cloud_cust(s, d), 4, others=True), "d2").select("qid", "rank", "d2"),
    "radius_outliers": lambda s, d: proximity.radius_outliers(cloud_cust(s, d), 3.0, 4).select("pid"),
    "statistical_outliers": lambda s, d: proximity.statistical_outliers(cloud_cust(s, d), 4, 1.0).select("pid"),
    "euclidean_clusters": lambda s, d: proximity.euclidean_clusters(cloud_cust(s, d), 2.0),
    "dbscan": lambda s, d: proximity.dbscan(cloud_cust(s, d), 3.0, 6),
    "chamfer_hausdorff": lambda s, d: rounded(proximity.chamfer(cloud_cust(s, d), cloud_part(s, d)), "ab_mean", "ba_mean", "chamfer", "hausdorff"),
    "nearest_in_time": lambda s, d: (lambda e: timeline.nearest_in_time(e.where("topic = 'click'"), e.where("topic = 'purchase'"), 3_600_000_000_000))(stamped(s, d)),
    "odometry_deltas": lambda s, d: rounded(timeline.deltas(stamped(s, d), "user_id", "ts_ns", "value").select("id", "dt", "dv"), "dv"),
    "temporal_subsample": lambda s, d: timeline.subsample(stamped(s, d), "topic", "ts_ns", 7).select("id", "topic", "n"),
    "integral_image": lambda s, d: grids.integral_image(read(s, d, "part").groupBy((F.col("p_partkey") % 3).alias("image_id"), F.col("p_size").alias("y"), (F.col("p_partkey") % 20).alias("x")).agg(F.count("*").alias("v"))),
}
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_BOX = "x BETWEEN 10 AND 40 AND y BETWEEN 20 AND 90 AND z BETWEEN 2 AND 12"
_KEY = "CAST(floor(x / {0}) AS BIGINT) AS ix, CAST(floor(y / {0}) AS BIGINT) AS iy, CAST(floor(z / {0}) AS BIGINT) AS iz"
_NEAR = f"SELECT a.pid AS qid, b.pid AS pid, {_D2} AS d2 FROM {CUST} a, {CUST} b WHERE {_D2} <= "
_KNN = f"SELECT qid, rank, d2 FROM (SELECT a.pid AS qid, {_D2} AS d2, CAST(row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS INT) AS rank FROM {CUST} a, {CUST} b WHERE a.pid <> b.pid) WHERE rank <= 4"
_REACH = f"""WITH RECURSIVE near AS (SELECT a.pid AS a, b.pid AS b FROM {CUST} a, {CUST} b WHERE {_D2} <= {{0}}), core AS ({{1}}),
link AS (SELECT a, b FROM near WHERE a IN (SELECT pid FROM core) AND b IN (SELECT pid FROM core)),
reach(a, b) AS (SELECT pid, pid FROM core UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
named AS (SELECT a AS pid, dense_rank() OVER (ORDER BY min(b)) - 1 AS label FROM reach GROUP BY a)"""
SQL = {
    "euclidean_clusters": _REACH.format(4, f"SELECT pid FROM {CUST}") + " SELECT pid, CAST(label AS INT) AS label FROM named",
    "dbscan": _REACH.format(9, "SELECT a AS pid FROM near GROUP BY a HAVING count(*) >= 6")
    + f" SELECT c.pid, CAST(coalesce(any_value(own.label), min(other.label), -1) AS INT) AS label FROM {CUST} c LEFT JOIN named own ON own.pid = c.pid LEFT JOIN near ON near.a = c.pid LEFT JOIN named other ON other.pid = near.b GROUP BY c.pid",
    "integral_image": "WITH p AS (SELECT p_partkey % 3 AS image_id, p_size AS y, p_partkey % 20 AS x, count(*) AS v FROM part GROUP BY 1, 2, 3), r AS (SELECT *, sum(v) OVER (PARTITION BY image_id, y ORDER BY x) AS r FROM p) SELECT image_id, y, x, v, CAST(sum(r) OVER (PARTITION BY image_id, x ORDER BY y) AS BIGINT) AS s FROM r",
    "chamfer_hausdorff": f"WITH d AS (SELECT a.pid AS i, b.pid AS j, power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) AS d2 FROM {CUST} a, {PART} b), p AS (SELECT min(d2) AS m FROM d GROUP BY i), q AS (SELECT min(d2) AS m FROM d GROUP BY j) SELECT round((SELECT avg(m) FROM p), 4) AS ab_mean, round((SELECT avg(m) FROM q), 4) AS ba_mean, round((SELECT avg(m) FROM p) + (SELECT avg(m) FROM q), 4) AS chamfer, round(sqrt(greatest((SELECT max(m) FROM p), (SELECT max(m) FROM q))), 4) AS hausdorff",
    "voxel_centroid": f"WITH k AS (SELECT *, {_KEY.format('4.0')} FROM {LI}) SELECT ix, iy, iz, count(*) AS n, round(avg(x), 8) AS x, round(avg(y), 8) AS y, round(avg(z), 8) AS z, round(avg(intensity), 8) AS intensity FROM k GROUP BY ix, iy, iz",
    "occupancy_grid": f"SELECT {_KEY.format('5.0')}, count(*) AS n FROM {LI} GROUP BY 1, 2, 3",
    "crop_box": f"SELECT * FROM {PART} WHERE {_BOX}",
    "crop_box_inverted": f"SELECT * FROM {PART} WHERE NOT ({_BOX})",
    "pass_through": f"SELECT * FROM {PART} WHERE x BETWEEN 5 AND 25",
    "affine_transform": f"SELECT pid, round(x * 0 + y * -1 + z * 0 + 1, 4) AS x, round(x * 1 + y * 0 + z * 0 + 2, 4) AS y, round(x * 0 + y * 0 + z * 2 + 3, 4) AS z FROM {PART}",
    "recenter": f"SELECT pid, round(x - avg(x) OVER (), 4) AS x, round(y - avg(y) OVER (), 4) AS y, round(z - avg(z) OVER (), 4) AS z FROM {PART}",
    "unit_sphere": f"WITH c AS (SELECT pid, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, z - avg(z) OVER () AS z FROM {PART}), r AS (SELECT *, max(sqrt(x * x + y * y + z * z)) OVER () AS r FROM c) SELECT pid, round(x / r, 4) AS x, round(y / r, 4) AS y, round(z / r, 4) AS z FROM r",
    "scale_points": f"SELECT pid, round(x * 2.5, 4) AS x, round(y * CAST(2.5 AS DOUBLE), 4) AS y, round(z * 2.5, 4) AS z FROM {PART}",
    "camera_project": f"SELECT pid, x, y, z, round(x / z * 500 + 320, 4) AS u, round(y / z * 500 + 240, 4) AS v FROM {PART} WHERE z > 0",
    "bounds": f"SELECT min(x) AS min_x, round(min(y), 4) AS min_y, round(min(z), 4) AS min_z, max(x) AS max_x, round(max(y), 4) AS max_y, round(max(z), 4) AS max_z FROM {LI}",
    "voxel_first": f"WITH k AS (SELECT *, CAST(floor((x - min(x) OVER ()) / 8.0) AS BIGINT) AS ix, CAST(floor((y - min(y) OVER ()) / 8.0) AS BIGINT) AS iy, CAST(floor((z - min(z) OVER ()) / 8.0) AS BIGINT) AS iz FROM {PART}) SELECT ix, iy, iz, pid, x, y, z FROM k QUALIFY row_number() OVER (PARTITION BY ix, iy, iz ORDER BY pid) = 1",
    "ndt_cells": f"WITH k AS (SELECT *, {_KEY.format('20.0')} FROM {PART}) SELECT ix, iy, iz, count(*) AS n, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, round(avg(z), 4) AS mean_z, {', '.join(f'round(covar_samp({a}, {b}), 4) AS cov_{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM k GROUP BY ix, iy, iz HAVING count(*) >= 3",
    "histogram": f"SELECT CAST(floor(value / 31.25) AS BIGINT) AS bin, count(*) AS n FROM {EVENTS} WHERE value >= 0 AND value < 500 GROUP BY 1",
    "radius_join": f"SELECT qid, pid, round(d2, 4) AS d2 FROM ({_NEAR} 9)",
    "knn_join": f"SELECT qid, rank, round(d2, 4) AS d2 FROM ({_KNN})",
    "radius_outliers": f"SELECT qid AS pid FROM ({_NEAR} 9) GROUP BY qid HAVING count(*) >= 5",
    "statistical_outliers": f"WITH m AS (SELECT qid, avg(sqrt(d2)) AS d FROM ({_KNN}) GROUP BY qid) SELECT qid AS pid FROM m WHERE d <= (SELECT avg(d) + stddev_pop(d) FROM m)",
    "nearest_in_time": f"SELECT a.id AS id, a.ts_ns AS ts_ns, arg_min(b.id, abs(a.ts_ns - b.ts_ns) * 4 + CAST(b.ts_ns > a.ts_ns AS INT)) AS match_id, min(abs(a.ts_ns - b.ts_ns)) AS dt FROM {EVENTS} a, {EVENTS} b WHERE a.topic = 'click' AND b.topic = 'purchase' AND abs(a.ts_ns - b.ts_ns) <= 3600000000000 GROUP BY a.id, a.ts_ns",
    "odometry_deltas": f"SELECT id, ts_ns - lag(ts_ns) OVER w AS dt, round(value - lag(value) OVER w, 4) AS dv FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns)",
    "temporal_subsample": f"SELECT id, topic, CAST(n AS INT) AS n FROM (SELECT id, topic, row_number() OVER (PARTITION BY topic ORDER BY ts_ns) - 1 AS n FROM {EVENTS}) WHERE n % 7 = 0",
}
