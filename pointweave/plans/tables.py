"""Queries on selections, cameras, tensors, trajectories, graphs and scenes, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tensors
from ..operators import depth, points, selection
from ..operators.shared import shared_folder
from ..sources import arrow
from ..streaming import flows
from .spatial import CUST, EVENTS, PART, cloud_cust, cloud_part, read, rounded, stamped

CAMERA = depth.Camera(500.0, 480.0, 320.0, 240.0, -0.15, 0.02, 0.001, -0.001, 0.003)
PLAIN = depth.Camera(510.0, 470.0, 10.0, 12.0)
BEAM = f"(SELECT pid, x / 100 AS x, y / 200 AS y, z + 1.0 AS z FROM {PART})"
PIXELS = "(SELECT p_partkey % 3 AS image_id, p_size AS v, p_partkey AS u, CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE p_retailprice / 100 END AS depth, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_size * 5 AS b FROM part)"


def beam(s, d):
    return cloud_part(s, d).selectExpr("pid", "x / 100 as x", "y / 200 as y", "z + 1.0 as z")


def depths(s, d):
    return read(s, d, "part").selectExpr("p_partkey % 3 as image_id", "p_size as v", "p_partkey as u", "case when p_partkey % 11 = 0 then 0.0 else p_retailprice / 100 end as depth")


def colours(s, d):
    return read(s, d, "part").selectExpr("p_partkey % 3 as image_id", "p_size as v", "p_partkey as u", "p_partkey * 7 % 256 as r", "p_partkey * 13 % 256 as g", "p_size * 5 as b")


def indexed(s, d):
    ids = read(s, d, "supplier").selectExpr("s_suppkey as ord", "s_suppkey * 7 % 100 + 1 as pid")
    return selection.extract_indices(cloud_part(s, d), ids)


def mapped(s, d):
    p = cloud_cust(s, d).selectExpr("pid as u", "0 as v", "0 as image_id", "case when pid % 13 = 0 then double('nan') else x end as x", "y", "z")
    c = read(s, d, "customer").selectExpr("c_custkey as u", "0 as v", "0 as image_id", "c_custkey % 10 / 10.0D as confidence")
    return depth.point_map_to_cloud(p, c, 0.4).select("u", "x", "y", "z")


def chunked(s, d):
    return cloud_part(s, d).withColumn("chunk", F.floor(F.col("pid") / 100))


def chunk_scan(s, d):
    p = chunked(s, d)
    return selection.chunks_within(p, selection.chunk_bounds(p, "chunk"), "chunk", (5, 0, 1), (45, 190, 14)).drop("chunk")


def reported(s, d):
    return rounded(selection.eval_report(cloud_part(s, d), {"points": F.count("*"), "mean_x": F.avg("x"), "rms_y": F.sqrt(F.avg(F.col("y") * F.col("y"))), "top_z": F.max("z")}), "value")


def pushed(s, d):
    """Samples in the order of their ids, time stamps folded so that some go back."""
    e = stamped(s, d).withColumn("t", F.col("ts_ns") % 86_400_000_000_000)
    return selection.trajectory_push(e, "user_id", "id", "t").select("id", "accepted")


def reversed_episode(s, d):
    e = stamped(s, d).withColumn("ts_ns", F.floor(F.col("ts_ns") / 7_200_000_000_000))
    return selection.episode_reversed(e, "user_id", "ts_ns", "id").select("id", "ord")


def surfels(s, d):
    p = cloud_cust(s, d).selectExpr("pid", "x - 30 as radius", "y * 0 as nx", "y as ny", "z as nz")
    return selection.valid_surfels(p).select("pid", "radius")


def graph(s, d):
    n = read(s, d, "nation")
    nodes = n.selectExpr("concat('n', n_nationkey) as id").unionByName(n.selectExpr("concat('r', n_regionkey) as id").distinct()).unionByName(s.createDataFrame([("root",)], "id string"))
    edges = n.selectExpr("concat('r', n_regionkey) as from_id", "concat('n', n_nationkey) as to_id").unionByName(n.selectExpr("'root' as from_id", "concat('r', n_regionkey) as to_id").distinct())
    return selection.topological_order(nodes, edges.unionByName(n.where("n_nationkey > 0").selectExpr("concat('n', n_nationkey - 1) as from_id", "concat('n', n_nationkey) as to_id")))


def lod_box(s, d):
    zones = selection.chunk_bounds(chunked(s, d), "chunk").withColumnRenamed("chunk", "id")
    return selection.nodes_query(zones, zones.where("id % 3 = 1").select("id"), 0.5)


def packets(s, d):
    e = stamped(s, d)
    return selection.packet_topic(e.selectExpr("id as sequence", "topic as source_topic"), e.where("value > 250").selectExpr("id as sequence"))


def poses(s, d):
    """A chain of suppliers, a step's motion a quarter turn about z and a shift by its key; even links to 1 close loops."""
    p = read(s, d, "supplier").where("s_suppkey between 1 and 60").selectExpr("s_suppkey as id")
    eye, zero = (F.array(*(F.lit(float(v)) for v in values)) for values in ((1, 0, 0, 0, 1, 0, 0, 0, 1), (0, 0, 0)))
    turn = F.array(*(F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)))
    nodes = p.select("id", eye.alias("rotation"), zero.alias("translation"))
    shift = lambda c: F.array(F.col(c) * 1.0, F.lit(2.0), F.col(c) % 3 * 1.0)
    edges = p.where("id > 1").select((F.col("id") - 1).alias("from_id"), F.col("id").alias("to_id"), turn.alias("rotation"), shift("id").alias("translation"), F.lit(False).alias("loop_closure"))
    loops = p.where("id > 2 and id % 2 = 0").select(F.col("id").alias("from_id"), F.lit(1).cast("long").alias("to_id"), eye.alias("rotation"), shift("id").alias("translation"), F.lit(True).alias("loop_closure"))
    out = selection.localize(nodes, edges.unionByName(loops), 1)
    return out.select("id", *(F.round(F.col("translation")[k], 4).alias(c) for k, c in enumerate("xyz")))


def packed(s, d):
    p = read(s, d, "part").select(F.floor(F.col("p_partkey") / 1040).alias("image_id"), F.floor(F.col("p_partkey") % 1040 / 20).alias("y"), (F.col("p_partkey") % 20).alias("x"), F.array(F.col("p_partkey") * 7 % 256, F.col("p_partkey") * 13 % 256, F.col("p_size") * 5).alias("v"))
    return rounded(tensors.pack_chw(p, 52, 20, 1 / 255, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)), "value", to=6)


def decoded(s, d):
    """Six numbers a row of five orders a tensor."""
    o = read(s, d, "orders").selectExpr("o_orderkey div 5 as tensor_id", "o_orderkey as k", "array(o_custkey % 50, o_orderkey % 40, o_custkey % 50 + 8, o_orderkey % 40 + 6, o_totalprice, o_custkey % 3) as six")
    t = o.groupBy("tensor_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "six"))), lambda x: x["six"].cast("array<double>"))).alias("values"))
    t = t.select("tensor_id", tensors.descriptor(F.col("values"), F.array((F.size("values") / 6).cast("long"), F.lit(6).cast("long"))).alias("tensor"))
    return rounded(tensors.decode_detections(t), "score")


def masks(s, d):
    v = read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    t = v.select("vec_id", tensors.descriptor(F.col("e"), F.array(F.lit(1), F.lit(8), F.lit(8))).alias("tensor"))
    m = tensors.decode_mask(t, 0.05)
    return m.select("vec_id", "height", "width", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("lit"))


def props(s, d):
    e = read(s, d, "events")
    return e.select("event_id", tensors.json_at(F.col("props"), "$.k", "int").alias("k"), tensors.canonical_json(F.concat(F.lit('{"z": '), F.col("props"), F.lit(', "a": '), F.col("event_id").cast("string"), F.lit("}"))).alias("canonical"))


def streamed(change):
    def run(s, d):
        to = f"{shared_folder(s)}/{uuid.uuid4().hex}"
        src = flows.source(s, f"{d}/events*", s.read.parquet(f"{d}/events.parquet").schema)
        cloud = src.selectExpr("event_id as pid", "cast(user_id as double) as x", "value as y", "cast(event_id % 10 as double) as z")
        flows.drain(change(cloud), f"{to}/out", f"{to}/state")
        return rounded(s.read.parquet(f"{to}/out"), "x", "y", "z")

    return run


QUERIES = {
    "extract_indices": indexed,
    "extract_mask": lambda s, d: selection.extract_mask(cloud_part(s, d).withColumn("keep", F.when(F.col("pid") % 5 != 0, F.col("x") > 20)), "keep"),
    "with_labels": lambda s, d: selection.with_labels(cloud_cust(s, d), read(s, d, "customer").where("c_nationkey > 3").selectExpr("c_custkey as pid", "c_nationkey as label")).select("pid", "label"),
    "merge_clouds": lambda s, d: selection.merge_clouds(cloud_part(s, d), cloud_cust(s, d)),
    "voxel_mixed": lambda s, d: rounded(selection.voxel_mixed(cloud_cust(s, d).withColumns({"intensity": F.col("pid") % 7 * 1.0, "ring": F.col("pid") % 16}), 8.0, ("intensity",), ("ring",), origin=(0, 0, 0)), "x", "y", "z", "intensity"),
    "voxel_first_position": lambda s, d: rounded(selection.voxel_mixed(cloud_cust(s, d).withColumn("intensity", F.col("pid") % 7 * 1.0), 8.0, ("intensity",), (), "first", (0, 0, 0)), "intensity"),
    "chunk_bounds": lambda s, d: selection.chunk_bounds(chunked(s, d), "chunk"),
    "chunk_scan": chunk_scan,
    "transfer_totals": lambda s, d: selection.transfer_totals(stamped(s, d).selectExpr("topic as direction", "user_id as bytes")),
    "eval_report": reported,
    "trajectory_push": pushed,
    "episode_reverse": reversed_episode,
    "valid_surfels": surfels,
    "tsdf_integrate": lambda s, d: rounded(selection.tsdf(cloud_part(s, d), (-3.0, -5.0, 40.0), 4.0, 6.0, (14, 300, 6)), "distance"),
    "topological_order": graph,
    "lod_nodes_query": lod_box,
    "packet_topics": packets,
    "pose_accumulation": poses,
    "camera_project_distorted": lambda s, d: rounded(depth.project(beam(s, d), CAMERA), "u", "v", to=6).select("pid", "u", "v"),
    "camera_unproject": lambda s, d: rounded(depth.unproject(depth.project(beam(s, d), CAMERA).selectExpr("pid", "u", "v", "z as depth"), CAMERA), "x", "y", "z", to=6).select("pid", "x", "y", "z"),
    "depth_dense": lambda s, d: rounded(depth.depth_to_xyz_dense(depths(s, d), PLAIN, 1.0, 9.5).withColumn("valid", F.expr("not isnan(z)")).na.fill(0.0), "x", "y", "z", to=6).select("image_id", "v", "u", "valid", "x", "y", "z"),
    "depth_cloud": lambda s, d: rounded(depth.depth_to_cloud(depths(s, d), PLAIN, 0.5, 0.0, 5.2), "x", "y", "z", to=6).select("image_id", "v", "u", "x", "y", "z"),
    "rgbd_cloud": lambda s, d: rounded(depth.rgbd_to_cloud(depths(s, d), colours(s, d), PLAIN), "x", "y", "z", to=6).select("image_id", "u", "x", "y", "z", "r", "g", "b"),
    "point_map_cloud": mapped,
    "pack_chw": packed,
    "swap_red_blue": lambda s, d: tensors.swap_red_blue(colours(s, d)),
    "gray_to_rgb": lambda s, d: tensors.gray_to_rgb(colours(s, d).selectExpr("u", "r as v")),
    "detection_tensors": decoded,
    "mask_tensors": masks,
    "json_values": props,
    "stream_crop": streamed(lambda c: points.crop_box(c, (10, 50, 2), (90, 400, 8))),
    "stream_transform": streamed(lambda c: points.affine(c, ((0, -1, 0, 1), (1, 0, 0, 2), (0, 0, 2, 3)))),
    "arrow_round_trip": lambda s, d: arrow.from_reader(s, arrow.reader(cloud_part(s, d))),
}

_XYZ = ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}" for a in "xyz")
_KEY = "CAST(floor(x / 8.0) AS BIGINT) AS ix, CAST(floor(y / 8.0) AS BIGINT) AS iy, CAST(floor(z / 8.0) AS BIGINT) AS iz"
_CHUNKS = f"(SELECT *, CAST(floor(pid / 100) AS BIGINT) AS chunk FROM {PART})"
_RANGE = "unnest(generate_series(CAST(greatest(0, least({n} - 1, floor(({a} - 6.0) / 4.0))) AS BIGINT), CAST(greatest(0, least({n} - 1, floor(({a} + 6.0) / 4.0))) AS BIGINT))) AS i{a}"
_RAY = "sqrt(power(x + 3, 2) + power(y + 5, 2) + power(z - 40, 2))"
_VALID = "depth > 0 AND depth >= 9.5"
SQL = {
    "extract_indices": f"SELECT s_suppkey AS ord, p.* FROM supplier JOIN {PART} p ON p.pid = s_suppkey * 7 % 100 + 1",
    "extract_mask": f"SELECT * FROM {PART} WHERE pid % 5 <> 0 AND x > 20",
    "with_labels": "SELECT c_custkey AS pid, CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS INT) END AS label FROM customer",
    "merge_clouds": f"SELECT *, 0 AS cloud FROM {PART} UNION ALL SELECT *, 1 FROM {CUST}",
    "voxel_mixed": f"SELECT ix, iy, iz, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z, round(avg(pid % 7), 4) AS intensity, min(pid) % 16 AS ring FROM (SELECT *, {_KEY} FROM {CUST}) GROUP BY 1, 2, 3",
    "voxel_first_position": f"SELECT ix, iy, iz, count(*) AS n, round(avg(pid % 7), 4) AS intensity, arg_min(x, pid) AS x, arg_min(y, pid) AS y, arg_min(z, pid) AS z FROM (SELECT *, {_KEY} FROM {CUST}) GROUP BY 1, 2, 3",
    "chunk_bounds": f"SELECT chunk, count(*) AS n, {_XYZ} FROM {_CHUNKS} GROUP BY 1",
    "chunk_scan": f"SELECT * FROM {PART} WHERE x BETWEEN 5 AND 45 AND y BETWEEN 0 AND 190 AND z BETWEEN 1 AND 14",
    "transfer_totals": f"SELECT topic AS direction, count(*) AS transfers, CAST(sum(user_id) AS BIGINT) AS bytes FROM {EVENTS} GROUP BY 1",
    "eval_report": f"WITH m AS (SELECT count(*)::DOUBLE AS points, avg(x) AS mean_x, sqrt(avg(y * y)) AS rms_y, max(z) AS top_z FROM {PART}) SELECT 'points' AS name, round(points, 4) AS value FROM m UNION ALL SELECT 'mean_x', round(mean_x, 4) FROM m UNION ALL SELECT 'rms_y', round(rms_y, 4) FROM m UNION ALL SELECT 'top_z', round(top_z, 4) FROM m",
    "trajectory_push": f"SELECT id, coalesce(t >= max(t) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM (SELECT *, ts_ns % 86400000000000 AS t FROM {EVENTS})",
    "episode_reverse": f"SELECT id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts_ns // 7200000000000, id DESC) - 1 AS INT) AS ord FROM {EVENTS}",
    "valid_surfels": f"SELECT pid, x - 30 AS radius FROM {CUST} WHERE x > 30 AND (y <> 0 OR z <> 0)",
    "tsdf_integrate": f"""WITH p AS (SELECT x, y, z, {_RAY} AS d FROM {PART} WHERE {_RAY} > 1e-5), a AS (SELECT *, {_RANGE.format(a='x', n=14)} FROM p), b AS (SELECT *, {_RANGE.format(a='y', n=300)} FROM a), c AS (SELECT *, {_RANGE.format(a='z', n=6)} FROM b)
SELECT ix, iy, iz, round(avg(greatest(-6.0::DOUBLE, least(6.0::DOUBLE, ((x - (ix + 0.5) * 4.0) * (x + 3) + (y - (iy + 0.5) * 4.0) * (y + 5) + (z - (iz + 0.5) * 4.0) * (z - 40)) / d))), 4) AS distance, count(*) AS weight FROM c GROUP BY 1, 2, 3""",
    "topological_order": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS f, 'n' || n_nationkey AS t FROM nation UNION SELECT 'root', 'r' || n_regionkey FROM nation UNION SELECT 'n' || (n_nationkey - 1), 'n' || n_nationkey FROM nation WHERE n_nationkey > 0),
r(id, level) AS (SELECT 'root', 0 UNION SELECT e.t, r.level + 1 FROM r JOIN e ON e.f = r.id) SELECT id, max(level) AS level FROM r GROUP BY id""",
    "lod_nodes_query": f"SELECT {_XYZ}, count(DISTINCT chunk) AS nodes, 0.5::DOUBLE AS resolution FROM {_CHUNKS} WHERE chunk % 3 = 1",
    "packet_topics": f"SELECT id AS sequence, topic FROM {EVENTS} WHERE value > 250",
    "pose_accumulation": """WITH RECURSIVE p(id, c, s, x, y, z) AS (SELECT 1::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
UNION ALL SELECT id + 1, -s, c, -y + (id + 1), x + 2.0, z + (id + 1) % 3 FROM p WHERE id < 60 AND id < (SELECT max(s_suppkey) FROM supplier)) SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM p""",
    "camera_project_distorted": f"""WITH n AS (SELECT pid, x / z AS x, y / z AS y FROM {BEAM}), r AS (SELECT *, x * x + y * y AS r FROM n), k AS (SELECT *, 1 + r * (-0.15 + r * (0.02 + r * 0.003)) AS k FROM r)
SELECT pid, round((x * k + 2 * 0.001 * x * y - 0.001 * (r + 2 * x * x)) * 500 + 320, 6) AS u, round((y * k + 0.001 * (r + 2 * y * y) - 2 * 0.001 * x * y) * 480 + 240, 6) AS v FROM k""",
    "camera_unproject": f"SELECT pid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM {BEAM}",
    "depth_dense": f"SELECT image_id, v, u, {_VALID} AS valid, CASE WHEN {_VALID} THEN round((u - 10) * depth / 510, 6) ELSE 0 END AS x, CASE WHEN {_VALID} THEN round((v - 12) * depth / 470, 6) ELSE 0 END AS y, CASE WHEN {_VALID} THEN round(depth, 6) ELSE 0 END AS z FROM {PIXELS}",
    "depth_cloud": f"SELECT image_id, v, u, round((u - 10) * depth * 0.5::DOUBLE / 510, 6) AS x, round((v - 12) * depth * 0.5::DOUBLE / 470, 6) AS y, round(depth * 0.5::DOUBLE, 6) AS z FROM {PIXELS} WHERE depth > 0 AND depth * 0.5::DOUBLE <= 5.2",
    "rgbd_cloud": f"SELECT image_id, u, round((u - 10) * depth / 510, 6) AS x, round((v - 12) * depth / 470, 6) AS y, round(depth, 6) AS z, r, g, b FROM {PIXELS} WHERE depth > 0",
    "point_map_cloud": f"SELECT pid AS u, x, y, z FROM {CUST} WHERE pid % 13 <> 0 AND pid % 10 >= 4",
    "pack_chw": "WITH p AS (SELECT CAST(floor(p_partkey / 1040) AS BIGINT) AS image_id, p_partkey % 1040 AS place, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_size * 5 AS b FROM part) SELECT image_id, place, round((r / 255.0::DOUBLE - 0.485) / 0.229, 6) AS value FROM p UNION ALL SELECT image_id, place + 1040, round((g / 255.0::DOUBLE - 0.456) / 0.224, 6) FROM p UNION ALL SELECT image_id, place + 2080, round((b / 255.0::DOUBLE - 0.406) / 0.225, 6) FROM p",
    "swap_red_blue": f"SELECT image_id, v, u, b AS r, g, r AS b FROM {PIXELS}",
    "gray_to_rgb": f"SELECT u, r, r AS g, r AS b FROM {PIXELS}",
    "detection_tensors": "SELECT o_orderkey // 5 AS tensor_id, row_number() OVER (PARTITION BY o_orderkey // 5 ORDER BY o_orderkey) - 1 AS n, CAST(o_custkey % 50 AS DOUBLE) AS x0, CAST(o_orderkey % 40 AS DOUBLE) AS y0, CAST(o_custkey % 50 + 8 AS DOUBLE) AS x1, CAST(o_orderkey % 40 + 6 AS DOUBLE) AS y1, round(o_totalprice, 4) AS score, o_custkey % 3 AS class_id FROM orders",
    "mask_tensors": "SELECT vec_id, 8::BIGINT AS height, 8::BIGINT AS width, CAST(len(list_filter(embedding::DOUBLE[], lambda x: x >= 0.05)) AS INT) AS lit FROM embeddings",
    "json_values": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{\"a\":' || event_id || ',\"z\":{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}}' AS canonical FROM events",
    "stream_crop": "SELECT event_id AS pid, CAST(user_id AS DOUBLE) AS x, round(value, 4) AS y, CAST(event_id % 10 AS DOUBLE) AS z FROM events WHERE user_id BETWEEN 10 AND 90 AND value BETWEEN 50 AND 400 AND event_id % 10 BETWEEN 2 AND 8",
    "stream_transform": "SELECT event_id AS pid, round(1 - value, 4) AS x, CAST(user_id + 2 AS DOUBLE) AS y, CAST(event_id % 10 * 2 + 3 AS DOUBLE) AS z FROM events",
    "arrow_round_trip": f"SELECT * FROM {PART}",
}
