"""Aggregations over voxels and whole clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

XYZ = ("x", "y", "z")


def voxel_keys(df: DataFrame, leaf: float, origin=None) -> DataFrame:
    """ix, iy, iz; the origin is the cloud's minimum unless given (one row, broadcast)."""
    if origin is None:
        df = df.join(F.broadcast(df.agg(*(F.min(c).alias(f"_{c}") for c in XYZ))))
        o = {c: F.col(f"_{c}") for c in XYZ}
    else:
        o = {c: F.lit(float(v)) for c, v in zip(XYZ, origin)}
    return df.withColumns({f"i{c}": F.floor((F.col(c) - o[c]) / leaf) for c in XYZ}).drop("_x", "_y", "_z")


def voxel_centroid(df: DataFrame, leaf: float, attributes=(), origin=None) -> DataFrame:
    return voxel_keys(df, leaf, origin).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in (*XYZ, *attributes)))


def voxel_first(df: DataFrame, leaf: float, order: str = "pid") -> DataFrame:
    """The first point of each voxel; min_by combines before the shuffle, where a window would not."""
    keyed = voxel_keys(df, leaf)
    return keyed.groupBy("ix", "iy", "iz").agg(F.min_by(F.struct(*df.columns), order).alias("p")).select("ix", "iy", "iz", "p.*")


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in XYZ))


def covariance(df: DataFrame, keys=()) -> DataFrame:
    """Mean and sample covariance, for each cell if keys are given (normal-distribution cells)."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in XYZ), *(F.covar_samp(a, b).alias(f"cov_{a}{b}") for a, b in pairs))


def occupancy(df: DataFrame, leaf: float, origin=(0, 0, 0)) -> DataFrame:
    return voxel_keys(df, leaf, origin).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts over [lo, hi) in equal bins."""
    c = F.col(column)
    return df.where((c >= lo) & (c < hi)).groupBy(F.floor((c - lo) / ((hi - lo) / bins)).alias("bin")).agg(F.count("*").alias("n"))


def integral_image(df: DataFrame) -> DataFrame:
    """Summed area for each pixel of (image_id, y, x, v): along rows, then along columns."""
    row = df.withColumn("r", F.sum("v").over(Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    return row.withColumn("s", F.sum("r").over(Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0))).drop("r")
