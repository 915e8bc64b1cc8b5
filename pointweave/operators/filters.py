"""Image filters with borders, in pixel form (image_id, y, x, v). Every target pixel names its sources, which one join
on the pixel brings; pixels that an image lacks count as zero. An aperture's samples are all that meets in one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _source(c: Column, n: int, mode: str) -> Column:
    """The place inside [0, n) that stands for place c; null where the border is constant."""
    if mode == "constant":
        return F.when((c >= 0) & (c < n), c)
    if mode == "replicate":
        return F.greatest(F.lit(0), F.least(c, F.lit(n - 1)))
    if mode == "wrap":
        return F.pmod(c, F.lit(n))
    if mode == "reflect":  # edge pixels twice
        p = F.pmod(c, F.lit(2 * n))
        return F.when(p < n, p).otherwise(2 * n - 1 - p)
    if mode == "reflect101":  # edge pixels once
        if n == 1:
            return F.lit(0)
        p = F.pmod(c, F.lit(2 * n - 2))
        return F.when(p < n, p).otherwise(2 * n - 2 - p)
    raise ValueError(f"unknown border {mode}")


def gather(df: DataFrame, reach: list[tuple[int, int, float]], height: int, width: int, mode: str = "reflect101", value: float = 0.0, where: Column | None = None) -> DataFrame:
    """(image_id, y, x, v, w): for each pixel (of those `where` holds) the value at each offset (dy, dx) and its weight."""
    to = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in reach))
    t = (df if where is None else df.where(where)).select("image_id", "y", "x", F.explode(to).alias("t"))
    t = t.select("image_id", "y", "x", "t.w", _source(F.col("y") + F.col("t.dy"), height, mode).alias("sy"), _source(F.col("x") + F.col("t.dx"), width, mode).alias("sx"))
    s = df.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("v").cast("double").alias("v"))
    out = t.join(s, ["image_id", "sy", "sx"], "left")
    v = F.when(F.col("sy").isNull() | F.col("sx").isNull(), F.lit(float(value))).otherwise(F.coalesce("v", F.lit(0.0)))
    return out.select("image_id", "y", "x", v.alias("v"), "w")


def _square(size: int) -> list[tuple[int, int, float]]:
    r = size // 2
    return [(i, j, 1.0) for i in range(-r, r + 1) for j in range(-r, r + 1)]


def filter2d(df: DataFrame, kernel, height: int, width: int, delta: float = 0.0, **border) -> DataFrame:
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    reach = [(i - h, j - w, k) for i, row in enumerate(kernel) for j, k in enumerate(row) if k]
    return gather(df, reach, height, width, **border).groupBy("image_id", "y", "x").agg((F.sum(F.col("v") * F.col("w")) + delta).alias("v"))


def laplacian(df: DataFrame, height: int, width: int, size: int = 1, **border) -> DataFrame:
    kernel = {1: [[0, 1, 0], [1, -4, 1], [0, 1, 0]], 3: [[2, 0, 2], [0, -8, 0], [2, 0, 2]]}[size]
    return filter2d(df, kernel, height, width, **border)


def median(df: DataFrame, size: int, height: int, width: int, **border) -> DataFrame:
    near = gather(df, _square(size), height, width, **border).groupBy("image_id", "y", "x")
    return near.agg(F.element_at(F.sort_array(F.collect_list("v")), size * size // 2 + 1).alias("v"))


def adaptive_threshold(df: DataFrame, size: int, c: float, height: int, width: int, top: float = 255.0, **border) -> DataFrame:
    """`top` where the pixel is above the mean of its square less c, else zero."""
    mean = gather(df, _square(size), height, width, **border).groupBy("image_id", "y", "x").agg(F.avg("v").alias("m"))
    return df.join(mean, ["image_id", "y", "x"]).select("image_id", "y", "x", F.when(F.col("v") > F.col("m") - c, float(top)).otherwise(0.0).alias("v"))


def pyramid_down(df: DataFrame, height: int, width: int, **border) -> DataFrame:
    """Half the size: the even pixels after a 5x5 binomial blur; the others are not computed."""
    one = (1, 4, 6, 4, 1)
    reach = [(i - 2, j - 2, a * b / 256) for i, a in enumerate(one) for j, b in enumerate(one)]
    even = (F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)
    g = gather(df, reach, height, width, where=even, **border).groupBy("image_id", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return g.select("image_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v")


def crop(df: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    inside = F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1)
    return df.where(inside).withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def fuse_exposures(pixels: DataFrame, sigma: float = 0.2, floor: float = 1e-6) -> DataFrame:
    """(y, x, r, g, b) of all exposures image_id of one scene, weighted by how well each pixel is exposed."""
    light = (F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722) / 255.0
    w = F.exp(-(light - 0.5) * (light - 0.5) / (2 * sigma**2)) + floor
    p = pixels.withColumn("w", w).groupBy("y", "x")
    return p.agg(*(F.round(F.sum(F.col(c) * F.col("w")) / F.sum("w")).cast("int").alias(c) for c in "rgb"))
