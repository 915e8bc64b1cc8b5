"""Row-wise filters and transforms of clouds (columns pid, x, y, z, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

XYZ = ("x", "y", "z")


def _inside(c: str, lo: float, hi: float):
    return (F.col(c) >= lo) & (F.col(c) <= hi) & ~F.isnan(F.col(c).cast("double"))


def crop_box(df: DataFrame, lo, hi, invert: bool = False) -> DataFrame:
    """Points in the closed box; NaN lies outside, so `invert` keeps it."""
    test = _inside("x", lo[0], hi[0]) & _inside("y", lo[1], hi[1]) & _inside("z", lo[2], hi[2])
    return df.where(~F.coalesce(test, F.lit(False)) if invert else test)


def pass_through(df: DataFrame, column: str, lo: float, hi: float, invert: bool = False) -> DataFrame:
    test = _inside(column, lo, hi)
    return df.where(~F.coalesce(test, F.lit(False)) if invert else test)


def affine(df: DataFrame, matrix) -> DataFrame:
    """matrix: three rows of four numbers."""
    x, y, z = map(F.col, XYZ)
    return df.withColumns({c: x * m[0] + y * m[1] + z * m[2] + m[3] for c, m in zip(XYZ, matrix)})


def recenter(df: DataFrame) -> DataFrame:
    """Centroid to the origin; the one-row centroid is broadcast."""
    c = df.agg(*(F.avg(a).alias(f"_{a}") for a in XYZ))
    return df.join(F.broadcast(c)).withColumns({a: F.col(a) - F.col(f"_{a}") for a in XYZ}).drop("_x", "_y", "_z")


def scale(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumns({a: F.col(a) * factor for a in XYZ})


def unit_sphere(df: DataFrame) -> DataFrame:
    df = recenter(df)
    r = df.agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("_r"))
    return df.join(F.broadcast(r)).withColumns({a: F.when(F.col("_r") > 0, F.col(a) / F.col("_r")).otherwise(F.col(a)) for a in XYZ}).drop("_r")


def camera_project(df: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """Pinhole image coordinates of points before the camera."""
    return df.where("z > 0").withColumns({"u": F.col("x") / F.col("z") * fx + cx, "v": F.col("y") / F.col("z") * fy + cy})


def depth_to_points(df: DataFrame, fx: float, fy: float, cx: float, cy: float, depth_scale: float = 1.0) -> DataFrame:
    """(u, v, depth) to x, y, z; depths that are not positive and finite go."""
    d = F.col("depth") * depth_scale
    return df.where((d > 0) & (d < float("inf"))).withColumns({"x": (F.col("u") - cx) * d / fx, "y": (F.col("v") - cy) * d / fy, "z": d})
