"""Images in pixel form (image_id, y, x, v): kernels are joins on shifted pixels with sums combined before the shuffle,
so an image of any size and a hot image spread over many tasks. Pixels outside the image count as zero."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F


def _around(df: DataFrame, reach: list[tuple[int, int, float]]) -> DataFrame:
    """Each pixel's value sent to the pixels it takes part in: (image_id, y, x, v, w)."""
    to = F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(float(w)).alias("w")) for dy, dx, w in reach))
    return df.select("image_id", "v", F.explode(to).alias("t")).select("image_id", "t.y", "t.x", "v", "t.w")


def correlate(df: DataFrame, kernel) -> DataFrame:
    """Sum of kernel[dy][dx] * pixel, centred; only pixels of the image are returned."""
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    reach = [(i - h, j - w, k) for i, row in enumerate(kernel) for j, k in enumerate(row) if k]
    total = _around(df, reach).groupBy("image_id", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return df.select("image_id", "y", "x").join(total, ["image_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def box_blur(df: DataFrame, size: int) -> DataFrame:
    return correlate(df, [[1 / size**2] * size] * size)


def gaussian_blur(df: DataFrame, size: int, sigma: float) -> DataFrame:
    one = [math.exp(-((k - size // 2) ** 2) / (2 * sigma**2)) for k in range(size)]
    total = sum(one)
    row = [v / total for v in one]
    return correlate(correlate(df, [row]), [[v] for v in row])


def gradient(df: DataFrame, side: int = 2, edge: int = 1) -> DataFrame:
    """(image_id, y, x, dx, dy): Sobel with side 2, Scharr with side 10 and edge 3, in one pass."""
    reach = [(i, j, 0) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    row = {-1: edge, 0: side, 1: edge}
    to = F.array(*(F.struct((F.col("y") - i).alias("y"), (F.col("x") - j).alias("x"), F.lit(float(row[i] * j)).alias("a"), F.lit(float(row[j] * i)).alias("b")) for i, j, _ in reach))
    s = df.select("image_id", "v", F.explode(to).alias("t")).groupBy("image_id", F.col("t.y").alias("y"), F.col("t.x").alias("x")).agg(F.sum(F.col("v") * F.col("t.a")).alias("dx"), F.sum(F.col("v") * F.col("t.b")).alias("dy"))
    return df.select("image_id", "y", "x").join(s, ["image_id", "y", "x"])


def morphology(df: DataFrame, how: str, size: int = 3) -> DataFrame:
    """erode, dilate, open, close, gradient, tophat, blackhat by a square; only the image's own pixels count."""
    reach = [(i - size // 2, j - size // 2, 1) for i in range(size) for j in range(size)]

    def once(d, f):
        return df.select("image_id", "y", "x").join(_around(d, reach).groupBy("image_id", "y", "x").agg(f("v").alias("v")), ["image_id", "y", "x"])

    def less(a, b):
        return a.join(b.withColumnRenamed("v", "_b"), ["image_id", "y", "x"]).withColumn("v", F.col("v") - F.col("_b")).drop("_b")

    if how in ("erode", "dilate"):
        return once(df, F.min if how == "erode" else F.max)
    if how == "gradient":
        return less(once(df, F.max), once(df, F.min))
    out = once(once(df, F.min), F.max) if how in ("open", "tophat") else once(once(df, F.max), F.min)
    plain = df.select("image_id", "y", "x", "v")
    return {"open": lambda: out, "close": lambda: out, "tophat": lambda: less(plain, out), "blackhat": lambda: less(out, plain)}[how]()


def threshold(df: DataFrame, t: float, top: float = 255, how: str = "binary") -> DataFrame:
    """Strictly above t."""
    v, on = F.col("v"), F.col("v") > t
    value = {"binary": (F.lit(top), F.lit(0)), "binary_inv": (F.lit(0), F.lit(top)), "truncate": (F.lit(t), v), "to_zero": (v, F.lit(0)), "to_zero_inv": (F.lit(0), v)}[how]
    return df.withColumn("v", F.when(on, value[0]).otherwise(value[1]))


def otsu(df: DataFrame) -> DataFrame:
    """(image_id, t): the least value with the largest variance (to six places) between classes v <= t and v > t."""
    n = df.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id")
    run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = n.withColumns({"n0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("v")).over(run), "na": F.sum("n").over(w), "sa": F.sum(F.col("n") * F.col("v")).over(w)})
    n1 = F.col("na") - F.col("n0")
    d = F.col("s0") / F.col("n0") - F.try_divide(F.col("sa") - F.col("s0"), n1)
    return c.withColumn("b", F.round(F.coalesce(F.col("n0") * n1 * d * d, F.lit(0.0)), 6)).groupBy("image_id").agg(F.min_by("v", F.struct((-F.col("b")).alias("b"), "v")).alias("t"))


def grey(df: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b) to v: BT.601 weights of 14 bits, rounded."""
    return df.withColumn("v", F.shiftright(F.col("r").cast("int") * 4899 + F.col("g").cast("int") * 9617 + F.col("b").cast("int") * 1868 + 8192, 14))


def resize_nearest(df: DataFrame, height: int, width: int, old_height: int, old_width: int) -> DataFrame:
    """Each new pixel takes the old one at floor(place * old / new); old pixels go straight to the new ones."""
    span = lambda c, new, old: F.explode(F.filter(F.sequence(F.floor(F.col(c) * new / old).cast("int"), F.ceil((F.col(c) + 1) * new / old).cast("int")), lambda p: (F.floor(p * old / new) == F.col(c)) & (p < new)))
    rows = df.withColumn("ny", span("y", height, old_height))
    return rows.withColumn("nx", span("x", width, old_width)).select("image_id", F.col("ny").alias("y"), F.col("nx").alias("x"), "v")


def rle(df: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, runs): alternating run lengths of the mask v in row order, zeros first. Only run ends are gathered."""
    pos = F.col("y").cast("long") * width + F.col("x")
    on = df.where("v != 0").select("image_id", pos.alias("p"))
    edge = on.select("image_id", F.explode(F.array(F.struct(F.col("p"), F.lit(1).alias("d")), F.struct((F.col("p") + 1).alias("p"), F.lit(-1).alias("d")))).alias("e"))
    ends = edge.groupBy("image_id", F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d")).where("d != 0")
    cuts = df.select("image_id").distinct().join(ends.groupBy("image_id").agg(F.sort_array(F.collect_list("p")).alias("c")), "image_id", "left")
    c = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("c", F.array().cast("array<long>")), F.array(F.lit(height * width).cast("long")))
    runs = F.zip_with(F.slice("c", 2, F.size("c")), F.slice("c", 1, F.size("c") - 1), lambda b, a: b - a)
    return cuts.withColumn("c", c).withColumn("runs", runs).select("image_id", F.when((F.element_at("runs", -1) == 0) & (F.size("runs") > 1), F.slice("runs", 1, F.size("runs") - 1)).otherwise(F.col("runs")).alias("runs"))


def unrle(df: DataFrame, width: int) -> DataFrame:
    """The mask pixels of runs: (image_id, y, x, v)."""
    ends = F.transform("runs", lambda v, i: F.struct(F.aggregate(F.slice("runs", 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b).alias("e"), v.alias("n"), (i % 2).alias("v")))
    r = df.select("image_id", F.explode(ends).alias("r")).where("r.n > 0")
    p = r.select("image_id", F.explode(F.sequence(F.col("r.e") - F.col("r.n"), F.col("r.e") - 1)).alias("p"), F.col("r.v").cast("int").alias("v"))
    return p.select("image_id", F.floor(F.col("p") / width).alias("y"), (F.col("p") % width).alias("x"), "v")


def disparity_to_depth(df: DataFrame, focal: float, baseline: float) -> DataFrame:
    return df.where("v > 0").withColumn("depth", F.lit(focal * baseline) / F.col("v"))


def keypoint_grid(df: DataFrame, width: float, height: float, cell: float, each: int) -> DataFrame:
    """The `each` strongest keypoints (id, x, y, response) of each cell; those outside the image go; ties: smaller id."""
    inside = df.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    w = Window.partitionBy("cy", "cx").orderBy(F.desc("response"), "id")
    return inside.withColumns({"cy": F.floor(F.col("y") / cell), "cx": F.floor(F.col("x") / cell)}).withColumn("n", F.row_number().over(w)).where(F.col("n") <= each)


def region_sum(integral: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Sum over [x0, x1) x [y0, y1) by the four corners of an integral image (image_id, y, x, s)."""
    sign = F.when(((F.col("x") == x1 - 1) & (F.col("y") == y1 - 1)) | ((F.col("x") == x0 - 1) & (F.col("y") == y0 - 1)), 1).otherwise(-1)
    return integral.where(F.col("x").isin(x0 - 1, x1 - 1) & F.col("y").isin(y0 - 1, y1 - 1)).groupBy("image_id").agg(F.sum(sign * F.col("s")).alias("total"))
