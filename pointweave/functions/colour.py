"""Column functions on 8-bit colours and disparities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue halved to 0-179, saturation and value to 0-255, rounded half up."""
    r, g, b = (c.cast("double") / 255.0 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, 0.0).when(top == r, 60.0 * F.pmod((g - b) / d, F.lit(6.0))).when(top == g, 60.0 * ((b - r) / d + 2.0)).otherwise(60.0 * ((r - g) / d + 4.0))
    hue = F.when(hue >= 360.0, 0.0).otherwise(hue)
    return F.least(F.round(hue / 2.0), F.lit(179.0)).cast("int"), F.when(top == 0, 0).otherwise(F.round(d / top * 255.0)).cast("int"), F.round(top * 255.0).cast("int")


def depth_of(disparity: Column, focal: float, baseline: float) -> Column:
    """Zero where the disparity is not positive and finite."""
    return F.when((disparity > 0) & (disparity < float("inf")), focal * baseline / disparity).otherwise(0.0)


def disparity_points(df: DataFrame, fx: float, fy: float, cx: float, cy: float, baseline: float, disparity: str = "d") -> DataFrame:
    """Adds x, y, z of the left camera for pixels (u, v); zeros where there is no depth."""
    z = depth_of(F.col(disparity), fx, baseline)
    return df.withColumns({"x": (F.col("u") - cx) * z / fx, "y": (F.col("v") - cy) * z / fy, "z": z})


def white_balance(pixels: DataFrame) -> DataFrame:
    """Grey-world gains of each image: one partial aggregate, joined back by image."""
    mean = {c: F.avg(c).alias(f"m_{c}") for c in "rgb"}
    m = pixels.groupBy("image_id").agg(*mean.values())
    target = (F.col("m_r") + F.col("m_g") + F.col("m_b")) / 3
    gain = lambda c: F.when(F.col(f"m_{c}") > 0, target / F.col(f"m_{c}")).otherwise(1.0)
    out = pixels.join(m, "image_id").withColumns({c: F.least(F.round(F.col(c) * gain(c)), F.lit(255.0)).cast("int") for c in "rgb"})
    return out.drop("m_r", "m_g", "m_b")
