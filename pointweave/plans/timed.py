"""Queries on records, frames, schemas, colours and residuals, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, robust
from ..operators import records
from .spatial import CUST, EVENTS, PART, cloud_cust, cloud_part, read, rounded, stamped

OTHERS = ["click", "view"]


def sure(s, d):
    return stamped(s, d).withColumn("uncertainty_ns", F.col("id") % 10 * 1_000_000)


SURE = f"(SELECT *, id % 10 * 1000000 AS uncertainty_ns FROM {EVENTS} e)"
GAP, TIGHT = 3_600_000_000_000, 6_000_000


def _nearest(topic):
    return f"""(SELECT p.id, m.id AS {topic}_id, abs(m.ts_ns - p.ts_ns) AS {topic}_dt FROM sure p JOIN sure m ON p.topic = 'purchase' AND m.topic = '{topic}'
AND p.uncertainty_ns <= {TIGHT} AND m.uncertainty_ns <= {TIGHT} AND abs(m.ts_ns - p.ts_ns) <= {GAP}
QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY abs(m.ts_ns - p.ts_ns), m.ts_ns, m.id) = 1)"""


BUNDLES = f"WITH sure AS {SURE} SELECT c.id, click_id, click_dt, view_id, view_dt FROM {_nearest('click')} c JOIN {_nearest('view')} v ON c.id = v.id"


def frame_edges(s, d):
    """Nations hang below regions, regions below the world: quarter turns about z and a shift."""
    turn = lambda k: f"CASE {k} % 4 WHEN 0 THEN array(1d,0d,0d,0d,1d,0d,0d,0d,1d) WHEN 1 THEN array(0d,-1d,0d,1d,0d,0d,0d,0d,1d) WHEN 2 THEN array(-1d,0d,0d,0d,-1d,0d,0d,0d,1d) ELSE array(0d,1d,0d,-1d,0d,0d,0d,0d,1d) END"
    n = read(s, d, "nation").selectExpr("concat('r', n_regionkey) as parent", "concat('n', n_nationkey) as child", f"{turn('n_nationkey')} as r", "array(n_nationkey * 1d, n_nationkey * 2d, 1d) as t")
    return n.unionByName(read(s, d, "region").selectExpr("'world' as parent", "concat('r', r_regionkey) as child", f"{turn('r_regionkey')} as r", "array(r_regionkey * 10d, 0d, -r_regionkey * 1d) as t"))


def in_world(s, d):
    """Each nation's point (1, 2, 3) in the world's frame, and the world's origin in the nation's."""
    edges, nation = frame_edges(s, d), read(s, d, "nation").selectExpr("n_nationkey as id", "concat('n', n_nationkey) as frame", "1d as x", "2d as y", "3d as z")
    out = records.resolve_frames(edges, "world")
    r, t = robust.inverse(F.col("r"), F.col("t"))
    there = records.to_frame(nation, out.select("frame", r.alias("r"), t.alias("t"))).select("id", "x", "y", "z")
    origin = out.select("frame", F.col("t")[0].alias("ox"), F.col("t")[1].alias("oy"), F.col("t")[2].alias("oz"))
    return rounded(there.join(origin.withColumn("id", F.expr("try_cast(substring(frame, 2) as bigint)")).where("frame like 'n%'").drop("frame"), "id"), "x", "y", "z", "ox", "oy", "oz")


def _turn(k, x, y):
    return f"CASE {k} % 4 WHEN 0 THEN {x} WHEN 1 THEN -({y}) WHEN 2 THEN -({x}) ELSE {y} END", f"CASE {k} % 4 WHEN 0 THEN {y} WHEN 1 THEN {x} WHEN 2 THEN -({y}) ELSE -({x}) END"


FRAMES = f"""WITH a AS (SELECT n_nationkey AS id, n_regionkey AS g, {_turn('n_nationkey', '1.0', '2.0')[0]} + n_nationkey AS x, {_turn('n_nationkey', '1.0', '2.0')[1]} + 2 * n_nationkey AS y, 4.0 AS z FROM nation),
b AS (SELECT id, {_turn('g', 'x', 'y')[0]} + 10 * g AS x, {_turn('g', 'x', 'y')[1]} AS y, z - g AS z FROM a),
o AS (SELECT n_nationkey AS id, {_turn('(4 - n_regionkey % 4)', '-10.0 * n_regionkey', '0.0')[0]} - n_nationkey AS x, {_turn('(4 - n_regionkey % 4)', '-10.0 * n_regionkey', '0.0')[1]} - 2 * n_nationkey AS y, n_regionkey - 1.0 AS z FROM nation)
SELECT b.id, CAST(b.x AS DOUBLE) AS x, CAST(b.y AS DOUBLE) AS y, CAST(b.z AS DOUBLE) AS z, CAST({_turn('(4 - b.id % 4)', 'o.x', 'o.y')[0]} AS DOUBLE) AS ox, CAST({_turn('(4 - b.id % 4)', 'o.x', 'o.y')[1]} AS DOUBLE) AS oy, CAST(o.z AS DOUBLE) AS oz FROM b JOIN o ON b.id = o.id"""


def registries(s, d):
    e = read(s, d, "part").where("p_partkey % 5 != 0").selectExpr("p_size as schema_id", "p_size % 7 as major", "concat('f', p_partkey % 3) as name", "if(p_size % 11 = 0, 'F64', 'F32') as dtype").distinct()
    a = read(s, d, "part").where("p_partkey % 3 != 0 or p_size > 25").selectExpr("p_size as schema_id", "if(p_size % 13 = 0, 9, p_size % 7) as major", "concat('f', p_partkey % 3) as name", "'F32' as dtype").distinct()
    return e, a


SCHEMAS = """WITH e AS (SELECT DISTINCT p_size AS i, p_size % 7 AS v, 'f' || (p_partkey % 3) AS name, CASE WHEN p_size % 11 = 0 THEN 'F64' ELSE 'F32' END AS t FROM part WHERE p_partkey % 5 <> 0),
a AS (SELECT DISTINCT p_size AS i, CASE WHEN p_size % 13 = 0 THEN 9 ELSE p_size % 7 END AS v, 'f' || (p_partkey % 3) AS name, 'F32' AS t FROM part WHERE p_partkey % 3 <> 0 OR p_size > 25),
k AS (SELECT i, max(e.v) AS v, (SELECT max(a.v) FROM a WHERE a.i = e.i) AS w FROM e WHERE i IN (SELECT i FROM a) GROUP BY i),
n AS (SELECT i, count(*) FILTER (ta IS NULL) AS missing, count(*) FILTER (te IS NULL) AS extra, count(*) FILTER (te <> ta) AS conflicting FROM (SELECT coalesce(e.i, a.i) AS i, e.t AS te, a.t AS ta FROM e FULL JOIN a ON e.i = a.i AND e.name = a.name) GROUP BY i)
SELECT k.i AS schema_id, missing, extra, conflicting, CASE WHEN v <> w OR conflicting > 0 OR (missing > 0 AND extra > 0) THEN 'incompatible' WHEN extra > 0 THEN 'backward' WHEN missing > 0 THEN 'forward' ELSE 'identical' END AS verdict FROM k JOIN n ON k.i = n.i"""


def coloured(s, d):
    return read(s, d, "part").selectExpr("p_partkey as id", "cast(p_partkey % 3 as int) as image_id", "cast(p_partkey * 7 % 256 as int) as r", "cast(p_partkey * 13 % 256 as int) as g", "cast(p_size * 5 as int) as b")


RGB = "(SELECT p_partkey AS id, p_partkey % 3 AS image_id, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_size * 5 AS b FROM part)"


def as_hsv(s, d):
    h, sat, v = colour.hsv(F.col("r"), F.col("g"), F.col("b"))
    return coloured(s, d).select("id", h.alias("h"), sat.alias("s"), v.alias("v"))


def residuals(s, d):
    c = cloud_cust(s, d)
    c = c.withColumn("e", robust.plane_distance(F.col("x"), F.col("y"), F.col("z"), (0.6, 0.0, 0.8, -20.0)))
    out = {}
    for name, f, k in (("huber", robust.huber, 4.0), ("cauchy", robust.cauchy, 3.0), ("tukey", robust.tukey, 30.0)):
        out[f"{name}_w"], out[f"{name}_rho"] = f(F.col("e"), k)
    return rounded(c.select("pid", *(v.alias(n) for n, v in out.items())), *out)


def provenance(s, d):
    e = stamped(s, d).selectExpr("id", "1 + cast(id % 17 = 0 as int) as version", "if(id % 19 = 0, ' ', topic) as source_id", "if(id % 3 = 0, null, if(id % 23 = 0, '', 'u')) as source_uri", "if(id % 4 = 0, null, concat('s', user_id)) as stream_id", "if(id % 5 = 0, null, id) as sequence")
    return e.where(records.valid_provenance()).select("id", records.entity_id(F.col("source_id"), F.col("stream_id"), F.col("sequence")).alias("entity"))


def migrated(s, d):
    from pyspark.sql.types import DoubleType, FloatType, LongType, StructField, StructType

    target = StructType([StructField("z", DoubleType()), StructField("pid", LongType()), StructField("x", DoubleType()), StructField("intensity", FloatType()), StructField("y", DoubleType())])
    return rounded(records.migrate(cloud_part(s, d), target, fill=0.0), "y")


def health(s, d):
    o = read(s, d, "orders").selectExpr("CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'warning' ELSE 'fail' END as status", "o_orderstatus = 'P' as blocking", "o_orderstatus = 'P' and o_totalprice > 200000 as critical")
    return records.health(o)


def runs(s, d):
    return read(s, d, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("run"), F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n"), F.max("l_tax").alias("top"))


RUNS = "(SELECT l_linenumber % 3 AS run, l_returnflag AS name, count(*) AS n, max(l_tax) AS top FROM lineitem GROUP BY 1, 2)"

QUERIES = {
    "sync_bundles": lambda s, d: records.bundles(sure(s, d), "purchase", OTHERS, GAP, TIGHT).drop("ts_ns"),
    "sync_preview": lambda s, d: records.sync_preview(records.bundles(sure(s, d), "purchase", OTHERS, GAP, TIGHT), OTHERS),
    "sync_quality": lambda s, d: records.tight(sure(s, d), TIGHT).groupBy("topic").agg(F.count("*").alias("n")),
    "frame_motions": in_world,
    "schema_verdicts": lambda s, d: records.compare_schemas(*registries(s, d)),
    "schema_migration": migrated,
    "record_entities": provenance,
    "episode_limits": lambda s, d: records.within_limits(stamped(s, d).withColumn("size", F.col("id") % 13), "user_id", ["ts_ns", "id"], {"size": 200}, 40).select("user_id", "id"),
    "stream_receipts": lambda s, d: records.receipts(stamped(s, d).withColumn("size", F.col("id") % 13 * 16), "topic", "user_id", "size"),
    "run_stability": lambda s, d: records.stable(runs(s, d), "run", ["name", "top", "n"]),
    "hash_differences": lambda s, d: records.hash_differences(runs(s, d), "run", "name", "n"),
    "health_counts": health,
    "semantic_summary": lambda s, d: rounded(records.semantic_summary(read(s, d, "embeddings").selectExpr("vec_id / 1000 as confidence", "if(label = 3, null, label) as class_id")), "coverage", "mean", "p95"),
    "largest_payload": lambda s, d: read(s, d, "events").groupBy(F.col("event_type").alias("topic")).agg(F.max(F.octet_length("props")).alias("most")),
    # the first so many messages of a topic are what the operator is asked for
    "transform_list": lambda s, d: stamped(s, d).where("topic = 'view'").orderBy("ts_ns", "id").limit(25).select("id", "ts_ns"),
    "rgb_to_hsv": as_hsv,
    "white_balance": lambda s, d: colour.white_balance(coloured(s, d)).select("id", "r", "g", "b"),
    "disparity_points": lambda s, d: rounded(colour.disparity_points(cloud_part(s, d).selectExpr("pid", "x as u", "y as v", "z - 2 as d"), 500, 480, 320, 240, 0.12), "x", "y", "z", to=8).select("pid", "x", "y", "z"),
    "robust_weights": residuals,
}

SQL = {
    "sync_bundles": BUNDLES,
    "sync_preview": f"SELECT count(*) AS bundles, max(greatest(click_dt, view_dt)) AS most_dt, count(DISTINCT click_id) AS click_used, count(DISTINCT view_id) AS view_used FROM ({BUNDLES})",
    "sync_quality": f"SELECT topic, count(*) AS n FROM {SURE} e WHERE uncertainty_ns <= {TIGHT} GROUP BY topic",
    "frame_motions": FRAMES,
    "schema_verdicts": SCHEMAS,
    "schema_migration": f"SELECT z, pid, x, CAST(0 AS FLOAT) AS intensity, round(y, 4) AS y FROM {PART}",
    "record_entities": f"""SELECT id, 'record:' || topic || ':' || CASE WHEN id % 4 = 0 THEN 'record' ELSE 's' || user_id END || ':' || CASE WHEN id % 5 = 0 THEN 'unsequenced' ELSE CAST(id AS VARCHAR) END AS entity
FROM {EVENTS} e WHERE id % 17 <> 0 AND id % 19 <> 0 AND (id % 3 = 0 OR id % 23 <> 0)""",
    "episode_limits": f"SELECT user_id, id FROM {EVENTS} e WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, id ROWS UNBOUNDED PRECEDING) QUALIFY row_number() OVER w <= 40 AND sum(id % 13) OVER w <= 200",
    "stream_receipts": f"SELECT topic, count(*) AS chunks, CAST(sum(user_id) AS BIGINT) AS points, CAST(sum(id % 13 * 16) AS BIGINT) AS bytes, max(id % 13 * 16) AS most_bytes FROM {EVENTS} e GROUP BY topic",
    "run_stability": f"SELECT count(DISTINCT run) AS runs, count(DISTINCT name) = 1 AS same_name, count(DISTINCT top) = 1 AS same_top, count(DISTINCT n) = 1 AS same_n FROM {RUNS}",
    "hash_differences": f"SELECT name, count(DISTINCT run) AS runs, count(DISTINCT n) AS digests FROM {RUNS} GROUP BY name HAVING count(DISTINCT n) > 1 OR count(DISTINCT run) < (SELECT count(DISTINCT run) FROM {RUNS})",
    "health_counts": "SELECT count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS warnings, count(*) FILTER (o_orderstatus = 'P') AS blocked, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 200000) AS critical FROM orders",
    "semantic_summary": "SELECT count(*) AS n, round(count(*) FILTER (label <> 3) / count(*), 4) AS coverage, round(avg(vec_id / 1000), 4) AS mean, round(quantile_disc(vec_id / 1000, 0.95), 4) AS p95, count(DISTINCT CASE WHEN label <> 3 THEN label END) AS classes FROM embeddings",
    "largest_payload": "SELECT event_type AS topic, CAST(max(octet_length(encode(props))) AS INTEGER) AS most FROM events GROUP BY 1",
    "transform_list": f"SELECT id, ts_ns FROM {EVENTS} e WHERE topic = 'view' ORDER BY ts_ns, id LIMIT 25",
    "rgb_to_hsv": f"""WITH f AS (SELECT id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM {RGB}), m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM f),
h AS (SELECT id, v, d, CASE WHEN d = 0 THEN 0 WHEN v = r THEN 60 * CASE WHEN (g - b) / d < 0 THEN (g - b) / d + 6 ELSE (g - b) / d END WHEN v = g THEN 60 * ((b - r) / d + 2) ELSE 60 * ((r - g) / d + 4) END AS hue FROM m)
SELECT id, CAST(least(round(CASE WHEN hue >= 360 THEN 0 ELSE hue END / 2), 179) AS INTEGER) AS h, CAST(CASE WHEN v = 0 THEN 0 ELSE round(d / v * 255) END AS INTEGER) AS s, CAST(round(v * 255) AS INTEGER) AS v FROM h""",
    "white_balance": f"""WITH m AS (SELECT *, avg(r) OVER w AS mr, avg(g) OVER w AS mg, avg(b) OVER w AS mb FROM {RGB} WINDOW w AS (PARTITION BY image_id))
SELECT id, CAST(least(round(r * ((mr + mg + mb) / 3 / mr)), 255) AS INTEGER) AS r, CAST(least(round(g * ((mr + mg + mb) / 3 / mg)), 255) AS INTEGER) AS g, CAST(least(round(b * ((mr + mg + mb) / 3 / mb)), 255) AS INTEGER) AS b FROM m""",
    "disparity_points": f"""WITH p AS (SELECT pid, x AS u, y AS v, CASE WHEN z - 2 > 0 THEN 500 * 0.12::DOUBLE / (z - 2) ELSE 0.0::DOUBLE END AS z FROM {PART})
SELECT pid, round((u - 320) * z / 500, 8) AS x, round((v - 240) * z / 480, 8) AS y, round(z, 8) AS z FROM p""",
    "robust_weights": f"""WITH e AS (SELECT pid, x * 0.6::DOUBLE + z * 0.8::DOUBLE - 20 AS e FROM {CUST})
SELECT pid, round(CASE WHEN abs(e) <= 4 THEN 1.0::DOUBLE ELSE 4 / abs(e) END, 4) AS huber_w, round(CASE WHEN abs(e) <= 4 THEN 0.5::DOUBLE * e * e ELSE 4 * (abs(e) - 2.0::DOUBLE) END, 4) AS huber_rho,
round(1 / (1 + e * e / 9), 4) AS cauchy_w, round(4.5::DOUBLE * ln(1 + e * e / 9), 4) AS cauchy_rho,
round(CASE WHEN abs(e) >= 30 THEN 0.0::DOUBLE ELSE (1 - e * e / 900) * (1 - e * e / 900) END, 4) AS tukey_w, round(CASE WHEN abs(e) >= 30 THEN 150.0::DOUBLE ELSE 150.0::DOUBLE * (1 - (1 - e * e / 900) * (1 - e * e / 900) * (1 - e * e / 900)) END, 4) AS tukey_rho FROM e""",
}
