"""Queries of image filters with borders, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from .shapes import PIX, pixels
from .spatial import read, rounded

H, W = 52, 20


def exposures(s, d):
    p = read(s, d, "part")
    return p.selectExpr("p_partkey % 3 as image_id", "cast(cast(p_partkey / 3 as int) div 20 as int) as y", "cast(p_partkey / 3 as int) % 20 as x", "p_partkey * 7 % 256 as r", "p_partkey * 13 % 256 as g", "p_size * 5 as b")


def _near(reach: str, y: str, x: str, missing: str = "0.0") -> str:
    """Samples (image_id, y, x, v, dy, dx) of every pixel, y and x naming their sources."""
    return f"""(SELECT a.image_id, a.y, a.x, CASE WHEN a.sy IS NULL OR a.sx IS NULL THEN {missing} ELSE coalesce(CAST(b.v AS DOUBLE), 0.0::DOUBLE) END AS v, a.dy, a.dx
FROM (SELECT p.image_id, p.y, p.x, i.k AS dy, j.k AS dx, {y} AS sy, {x} AS sx FROM {PIX} p, (SELECT unnest(range({reach})) AS k) i, (SELECT unnest(range({reach})) AS k) j) a
LEFT JOIN {PIX} b ON a.image_id = b.image_id AND a.sy = b.y AND a.sx = b.x)"""


_MIRROR = [f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} >= {n} THEN 2 * {n} - 2 - ({c}) ELSE {c} END" for c, n in (("p.y + i.k", H), ("p.x + j.k", W))]
_CLAMP = [f"greatest(0, least({c}, {n - 1}))" for c, n in (("p.y + i.k", H), ("p.x + j.k", W))]
_WRAP = [f"({c} + {n}) % {n}" for c, n in (("p.y + i.k", H), ("p.x + j.k", W))]
_NONE = [f"CASE WHEN {c} >= 0 AND {c} < {n} THEN {c} END" for c, n in (("p.y + i.k", H), ("p.x + j.k", W))]
_TWICE = [f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {n} THEN 2 * {n} - 1 - ({c}) ELSE {c} END" for c, n in (("p.y + i.k", H), ("p.x + j.k", W))]
_FIVE = "CASE abs({}) WHEN 0 THEN 6.0::DOUBLE WHEN 1 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END"

QUERIES = {
    "median_blur": lambda s, d: filters.median(pixels(s, d), 3, H, W, mode="replicate"),
    "laplacian": lambda s, d: filters.laplacian(pixels(s, d), H, W, 3, mode="wrap"),
    "adaptive_threshold": lambda s, d: filters.adaptive_threshold(pixels(s, d), 5, 7.25, H, W, mode="reflect"),
    "pyramid_down": lambda s, d: rounded(filters.pyramid_down(pixels(s, d), H, W), "v", to=6),
    "filter2d_constant": lambda s, d: filters.filter2d(pixels(s, d), [[1, 2, 1], [0, 0, 0], [-1, -2, -1]], H, W, 3.0, mode="constant", value=9.0),
    "crop_image": lambda s, d: filters.crop(pixels(s, d), 10, 4, 20, 12),
    "exposure_fusion": lambda s, d: filters.fuse_exposures(exposures(s, d)),
}

_LIGHT = "exp(-power((r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255 - 0.5, 2) / (2 * power(0.2::DOUBLE, 2))) + 1e-6"
SQL = {
    "median_blur": f"SELECT image_id, y, x, list_sort(list(v))[5] AS v FROM {_near('-1, 2', *_CLAMP)} GROUP BY 1, 2, 3",
    "laplacian": f"SELECT image_id, y, x, sum(v * CASE WHEN dy = 0 AND dx = 0 THEN -8 WHEN dy <> 0 AND dx <> 0 THEN 2 ELSE 0 END) AS v FROM {_near('-1, 2', *_WRAP)} GROUP BY 1, 2, 3",
    "adaptive_threshold": f"SELECT p.image_id, p.y, p.x, CASE WHEN p.v > m.m - 7.25::DOUBLE THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM {PIX} p JOIN (SELECT image_id, y, x, avg(v) AS m FROM {_near('-2, 3', *_TWICE)} GROUP BY 1, 2, 3) m ON p.image_id = m.image_id AND p.y = m.y AND p.x = m.x",
    "pyramid_down": f"SELECT image_id, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, round(sum(v * {_FIVE.format('dy')} * {_FIVE.format('dx')} / 256), 6) AS v FROM {_near('-2, 3', *_MIRROR)} WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY image_id, y, x",
    "filter2d_constant": f"SELECT image_id, y, x, sum(v * -dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END) + 3 AS v FROM {_near('-1, 2', *_NONE, '9.0::DOUBLE')} GROUP BY 1, 2, 3",
    "crop_image": f"SELECT image_id, y - 10 AS y, x - 4 AS x, v FROM {PIX} WHERE y BETWEEN 10 AND 29 AND x BETWEEN 4 AND 15",
    "exposure_fusion": f"SELECT y, x, CAST(round(sum(r * w) / sum(w)) AS INTEGER) AS r, CAST(round(sum(g * w) / sum(w)) AS INTEGER) AS g, CAST(round(sum(b * w) / sum(w)) AS INTEGER) AS b FROM (SELECT *, {_LIGHT} AS w FROM (SELECT CAST(floor(p_partkey / 3) AS INTEGER) // 20 AS y, CAST(floor(p_partkey / 3) AS INTEGER) % 20 AS x, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_size * 5 AS b FROM part)) GROUP BY 1, 2",
}
