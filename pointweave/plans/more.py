"""Queries on boxes, entities, timelines and inventories."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import boxes, entities, grids, proximity, timeline
from .spatial import CUST, EVENTS, PART, cloud_cust, cloud_part, read, rounded, stamped


def detections(s, d):
    o = read(s, d, "orders").selectExpr("o_orderkey as id", "o_custkey % 20 as image_id", "o_custkey % 3 as class_id", "cast(o_custkey % 50 as double) as x0", "cast(o_orderkey % 40 as double) as y0", "o_totalprice / 1000 as score")
    return o.withColumns({"x1": F.col("x0") + 8.0 + F.col("id") % 5, "y1": F.col("y0") + 6.0 + F.col("id") % 7})


DET = "(SELECT o_orderkey AS id, o_custkey % 20 AS image_id, o_custkey % 3 AS class_id, CAST(o_custkey % 50 AS DOUBLE) AS x0, CAST(o_orderkey % 40 AS DOUBLE) AS y0, o_totalprice / 1000 AS score, CAST(o_custkey % 50 AS DOUBLE) + 8.0 + o_orderkey % 5 AS x1, CAST(o_orderkey % 40 AS DOUBLE) + 6.0 + o_orderkey % 7 AS y1 FROM orders)"
QUERY = [((k * 37) % 11 - 5) / 10 for k in range(64)]


def box_overlap(s, d):
    iou, giou = boxes.overlap()
    pairs = boxes.alike_pairs(detections(s, d), 16.0).select("a_ids", "b_ids", "same", F.round(iou, 4).alias("iou"), F.round(giou, 4).alias("giou")).where("iou > 0.3")
    return boxes.listed(pairs).select("a_id", "b_id", "iou", "giou")


def ent(s, d):
    return read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") / 10.0).alias("confidence"), F.col("label").alias("class_id"))


def interpolated(s, d):
    """Each click's value held between the neighbouring purchases of the same user, linear in time, clamped outside."""
    e = stamped(s, d)
    before = Window.partitionBy("user_id").orderBy("ts_ns").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("user_id").orderBy("ts_ns").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("topic") == "purchase", F.struct("ts_ns", "value"))
    w = e.withColumns({"l": F.last(known, True).over(before), "r": F.first(known, True).over(after)}).where("topic = 'click'")
    t = (F.col("ts_ns") - F.col("l.ts_ns")) / (F.col("r.ts_ns") - F.col("l.ts_ns"))
    v = F.when(F.col("l").isNull(), F.col("r.value")).when(F.col("r").isNull(), F.col("l.value")).otherwise(F.col("l.value") + t * (F.col("r.value") - F.col("l.value")))
    return w.select("id", F.round(v, 4).alias("value"))


QUERIES = {
    "box_overlap": box_overlap,
    "box_clip": lambda s, d: boxes.clip(detections(s, d), 45, 30).select("id", "x0", "y0", "x1", "y1"),
    "batched_nms": lambda s, d: boxes.batched_nms(detections(s, d), 20.0, 0.4).select("image_id", "class_id", "id", "place"),
    "semantic_search": lambda s, d: rounded(entities.semantic_search(ent(s, d), QUERY, 10), "score"),
    "cosine_similarity": lambda s, d: ent(s, d).select("id", F.round(entities.cosine(F.col("embedding"), F.array(*map(F.lit, QUERY))), 4).alias("cosine")),
    "stage_stats": lambda s, d: rounded(entities.stage_stats(stamped(s, d), "topic", "value"), "median", "mean", "std", "cv"),
    "class_legend": lambda s, d: entities.legend(s.range(12).select(F.col("id").cast("int").alias("class_id")), ent(s, d)),
    "ground_mask": lambda s, d: entities.ground(cloud_part(s, d), 5.0, 1, 3.0),
    "loop_closures": lambda s, d: proximity.radius_pairs(cloud_cust(s, d), 2.0).select("a", "b"),
    "radius_count": lambda s, d: proximity.radius_counts(cloud_cust(s, d), cloud_cust(s, d), 3.0),
    "replay_order": lambda s, d: stamped(s, d).select("id", F.row_number().over(Window.partitionBy(F.floor(F.col("ts_ns") / 86_400_000_000_000)).orderBy("ts_ns", "topic", "id")).alias("ord")),
    "annotation_spans": lambda s, d: timeline.spans(stamped(s, d), stamped(s, d).where("topic = 'purchase'").selectExpr("id as span", "ts_ns as start_ns", "ts_ns + 1800000000000 as end_ns")).select("span", "id"),
    "trajectory_interpolation": interpolated,
    "topic_inventory": lambda s, d: stamped(s, d).groupBy("topic").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")),
    "keyset_page": lambda s, d: stamped(s, d).where("id > 100").orderBy("id").limit(20).select("id", "topic"),
    "frame_inventory": lambda s, d: read(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("frame")).union(read(s, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")))).distinct(),
    "histogram_equalisation": lambda s, d: read(s, d, "part").groupBy(F.col("p_size").alias("v")).agg(F.count("*").alias("n")).withColumn("c", F.sum("n").over(Window.orderBy("v"))).withColumn("lut", F.round(F.col("c") * 255.0 / F.sum("n").over(Window.partitionBy(F.lit(1)))).cast("int")).select("v", "lut"),
    "voxel_tsdf_mean": lambda s, d: rounded(grids.voxel_keys(cloud_part(s, d), 10.0, (0, 0, 0)).groupBy("ix", "iy", "iz").agg(F.avg("z").alias("tsdf"), F.count("*").alias("weight")), "tsdf"),
}
_DOT = "list_dot_product(CAST(embedding AS DOUBLE[]), {q}) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) / sqrt(list_dot_product({q}, {q}))".format(q=f"CAST({QUERY} AS DOUBLE[])")
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_COMMON = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
SQL = {
    "histogram_equalisation": "SELECT v, CAST(round(c * 255.0::DOUBLE / (SELECT count(*) FROM part)) AS INTEGER) AS lut FROM (SELECT p_size AS v, sum(count(*)) OVER (ORDER BY p_size) AS c FROM part GROUP BY p_size)",
    "trajectory_interpolation": f"""WITH e AS {EVENTS}, c AS (SELECT * FROM e WHERE topic = 'click'), p AS (SELECT * FROM e WHERE topic = 'purchase'),
l AS (SELECT c.id, max_by(p.value, p.ts_ns) AS v, max(p.ts_ns) AS t FROM c JOIN p ON c.user_id = p.user_id AND p.ts_ns <= c.ts_ns GROUP BY c.id), r AS (SELECT c.id, min_by(p.value, p.ts_ns) AS v, min(p.ts_ns) AS t FROM c JOIN p ON c.user_id = p.user_id AND p.ts_ns >= c.ts_ns GROUP BY c.id)
SELECT c.id, round(CASE WHEN l.v IS NULL THEN r.v WHEN r.v IS NULL THEN l.v ELSE l.v + (c.ts_ns - l.t)::DOUBLE / (r.t - l.t) * (r.v - l.v) END, 4) AS value FROM c LEFT JOIN l ON c.id = l.id LEFT JOIN r ON c.id = r.id""",
    "box_overlap": f"WITH p AS (SELECT a.id AS a_id, b.id AS b_id, {_COMMON} AS c, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_COMMON} AS u, (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) AS h FROM {DET} a JOIN {DET} b USING (image_id, class_id) WHERE a.id < b.id) SELECT a_id, b_id, round(c / u, 4) AS iou, round(c / u - (h - u) / h, 4) AS giou FROM p WHERE round(c / u, 4) > 0.3",
    "batched_nms": f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, id) AS n FROM {DET} WHERE score >= 20),
r AS (SELECT image_id, class_id, n, [struct_pack(id := id, score := score, x0 := x0, y0 := y0, x1 := x1, y1 := y1)] AS kept FROM d WHERE n = 1
UNION ALL SELECT b.image_id, b.class_id, b.n, CASE WHEN len(list_filter(r.kept, lambda a: (greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))
 / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) > 0.4)) > 0
 THEN r.kept ELSE list_append(r.kept, struct_pack(id := b.id, score := b.score, x0 := b.x0, y0 := b.y0, x1 := b.x1, y1 := b.y1)) END FROM r JOIN d b ON b.image_id = r.image_id AND b.class_id = r.class_id AND b.n = r.n + 1),
k AS (SELECT image_id, class_id, unnest(kept) AS b FROM r QUALIFY row_number() OVER (PARTITION BY image_id, class_id ORDER BY n DESC) = 1)
SELECT image_id, class_id, b.id AS id, row_number() OVER (ORDER BY b.score DESC, b.id) - 1 AS place FROM k""",
    "box_clip": f"SELECT id, greatest(0, least(x0, 45)) AS x0, greatest(0, least(y0, 30)) AS y0, greatest(0, least(x1, 45)) AS x1, greatest(0, least(y1, 30)) AS y1 FROM {DET}",
    "semantic_search": f"SELECT vec_id AS id, round(0.7 * ({_DOT}) + 0.3 * (label / 10.0), 4) AS score FROM embeddings ORDER BY 0.7 * ({_DOT}) + 0.3 * (label / 10.0) DESC, id LIMIT 10",
    "cosine_similarity": f"SELECT vec_id AS id, round({_DOT}, 4) AS cosine FROM embeddings",
    "stage_stats": f"SELECT topic, min(value) AS lo, round(quantile_cont(value, 0.5), 4) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS hi, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(stddev_pop(value) / avg(value), 4) AS cv FROM {EVENTS} GROUP BY topic",
    "class_legend": "SELECT CAST(r.range AS INT) AS class_id, count(label) AS n, CAST(coalesce(max(label / 10.0), 0) AS DOUBLE) AS best FROM range(12) r LEFT JOIN embeddings ON label = r.range GROUP BY 1",
    "ground_mask": f"WITH p AS (SELECT *, floor(x / 5.0) AS cx, floor(y / 5.0) AS cy FROM {PART}), c AS (SELECT cx, cy, min(z) AS low FROM p GROUP BY 1, 2) SELECT p.pid, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.z) AS z, any_value(p.z) - min(c.low) <= 3.0 AS is_ground FROM p JOIN c ON abs(p.cx - c.cx) <= 1 AND abs(p.cy - c.cy) <= 1 GROUP BY p.pid",
    "loop_closures": f"SELECT a.pid AS a, b.pid AS b FROM {CUST} a JOIN {CUST} b ON a.pid < b.pid WHERE {_D2} <= 4",
    "radius_count": f"SELECT a.pid AS qid, count(*) AS n FROM {CUST} a, {CUST} b WHERE {_D2} <= 9 GROUP BY 1",
    "replay_order": f"SELECT id, CAST(row_number() OVER (PARTITION BY ts_ns // 86400000000000 ORDER BY ts_ns, topic, id) AS INT) AS ord FROM {EVENTS}",
    "annotation_spans": f"SELECT a.id AS span, e.id AS id FROM {EVENTS} e JOIN {EVENTS} a ON a.topic = 'purchase' AND e.ts_ns BETWEEN a.ts_ns AND a.ts_ns + 1800000000000",
    "topic_inventory": f"SELECT topic, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM {EVENTS} GROUP BY 1",
    "keyset_page": f"SELECT id, topic FROM {EVENTS} WHERE id > 100 ORDER BY id LIMIT 20",
    "frame_inventory": "SELECT 'n' || n_nationkey AS frame FROM nation UNION SELECT 'r' || n_regionkey FROM nation",
    "voxel_tsdf_mean": f"WITH k AS (SELECT *, CAST(floor(x / 10.0) AS BIGINT) AS ix, CAST(floor(y / 10.0) AS BIGINT) AS iy, CAST(floor(z / 10.0) AS BIGINT) AS iz FROM {PART}) SELECT ix, iy, iz, round(avg(z), 4) AS tsdf, count(*) AS weight FROM k GROUP BY ix, iy, iz",
}
