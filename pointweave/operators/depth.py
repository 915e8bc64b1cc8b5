"""Cameras with Brown-Conrady distortion, depth, colour and point maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Camera:
    """Focal lengths and centre in pixels, distortion of normalised coordinates (zeros: none)."""

    fx: float
    fy: float
    cx: float
    cy: float
    k1: float = 0.0
    k2: float = 0.0
    p1: float = 0.0
    p2: float = 0.0
    k3: float = 0.0

    def __post_init__(self):
        if not (0 < self.fx < float("inf") and 0 < self.fy < float("inf")):
            raise ValueError("focal lengths must be positive and finite")

    @property
    def straight(self) -> bool:
        return not any((self.k1, self.k2, self.p1, self.p2, self.k3))

    def distorted(self, x: Column, y: Column) -> tuple[Column, Column]:
        r2 = x * x + y * y
        radial = 1.0 + r2 * (self.k1 + r2 * (self.k2 + r2 * self.k3))
        return x * radial + 2 * self.p1 * x * y + self.p2 * (r2 + 2 * x * x), y * radial + self.p1 * (r2 + 2 * y * y) + 2 * self.p2 * x * y

    def undistorted(self, x: Column, y: Column, rounds: int = 12) -> Column:
        """A struct x, y: Newton steps with the exact derivative, within one expression."""
        if self.straight:
            return F.struct(x.alias("x"), y.alias("y"))

        def step(s, _):
            u, v = s["x"], s["y"]
            r2 = u * u + v * v
            radial, slope = 1.0 + r2 * (self.k1 + r2 * (self.k2 + r2 * self.k3)), self.k1 + r2 * (2 * self.k2 + 3 * r2 * self.k3)
            ex, ey = (a - b for a, b in zip(self.distorted(u, v), (x, y)))
            a = radial + 2 * u * u * slope + 2 * self.p1 * v + 6 * self.p2 * u
            b = 2 * u * v * slope + 2 * self.p1 * u + 2 * self.p2 * v
            d = radial + 2 * v * v * slope + 6 * self.p1 * v + 2 * self.p2 * u
            det = a * d - b * b
            flat = F.abs(det) < 2.3e-16
            nx, ny = u - (d * ex - b * ey) / det, v - (a * ey - b * ex) / det
            return F.struct(F.when(flat, u).otherwise(nx).alias("x"), F.when(flat, v).otherwise(ny).alias("y"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x.alias("x"), y.alias("y")), step)


def project(points: DataFrame, camera: Camera) -> DataFrame:
    """Adds u, v; points that aren't before the camera go."""
    x, y = camera.distorted(F.col("x") / F.col("z"), F.col("y") / F.col("z"))
    return points.where((F.col("z") > 0) & (F.col("z") < float("inf"))).withColumns({"u": x * camera.fx + camera.cx, "v": y * camera.fy + camera.cy})


def unproject(pixels: DataFrame, camera: Camera) -> DataFrame:
    """(u, v, depth) to x, y, z; pixels or depths that aren't finite, and depths that aren't positive, go."""
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    df = pixels.where((F.col("depth") > 0) & finite("depth") & finite("u") & finite("v"))
    df = df.withColumn("_n", camera.undistorted((F.col("u") - camera.cx) / camera.fx, (F.col("v") - camera.cy) / camera.fy))
    return df.withColumns({"x": F.col("_n.x") * F.col("depth"), "y": F.col("_n.y") * F.col("depth"), "z": F.col("depth")}).drop("_n")


def _depth(scale: float, low: float, high: float) -> Column:
    d = F.col("depth").cast("double") * scale
    return F.when((d > 0) & (d >= low) & (d <= high) & (d < float("inf")), d)


def depth_to_xyz_dense(depth: DataFrame, camera: Camera, scale: float = 1.0, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """Every pixel (image_id, v, u, depth) with x, y, z; NaN where the depth is invalid or out of range."""
    d = F.coalesce(_depth(scale, low, high), F.lit(float("nan")))
    return depth.withColumns({"x": (F.col("u") - camera.cx) * d / camera.fx, "y": (F.col("v") - camera.cy) * d / camera.fy, "z": d})


def depth_to_cloud(depth: DataFrame, camera: Camera, scale: float = 1.0, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """The valid pixels of a depth image as points."""
    return depth_to_xyz_dense(depth, camera, scale, low, high).where("not isnan(z)")


def rgbd_to_cloud(depth: DataFrame, colour: DataFrame, camera: Camera, **limits) -> DataFrame:
    """Points with the colour (r, g, b) of the same pixel; images are aligned, so a pixel without colour raises."""
    p = depth_to_cloud(depth, camera, **limits).join(colour.select("image_id", "v", "u", "r", "g", "b"), ["image_id", "v", "u"], "left")
    return p.withColumn("r", F.coalesce("r", F.raise_error(F.lit("a pixel has no colour"))))


def point_map_to_cloud(points: DataFrame, confidence: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """Finite points (image_id, v, u, x, y, z) of a map, with a confidence of `least` or more where one is given."""
    if not 0 <= least <= 1:
        raise ValueError("least confidence must lie in 0 to 1")
    ok = F.lit(True)
    for a in "xyz":
        ok &= F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < float("inf"))
    out = points.where(ok)
    if confidence is not None:
        out = out.join(confidence.select("image_id", "v", "u", "confidence"), ["image_id", "v", "u"]).where(~(F.col("confidence") < least) | F.isnan("confidence")).drop("confidence")
    return out
