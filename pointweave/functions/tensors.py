"""Tensors as columns: a struct of data type, shape, strides (in elements), byte offset and flat values; JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def contiguous_strides(shape: Column) -> Column:
    """Row-major strides of a shape: of each axis the product of those after it."""
    after = lambda k: F.aggregate(F.slice(shape, k + 2, F.greatest(F.size(shape) - k - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, x: a * x)
    return F.transform(shape, lambda _, k: after(k))


def descriptor(values: Column, shape: Column, dtype: str = "f32", strides: Column | None = None, offset: int = 0) -> Column:
    """The tensor struct; without strides they are row-major."""
    shape = shape.cast("array<long>")
    return F.struct(F.lit(dtype).alias("dtype"), shape.alias("shape"), (contiguous_strides(shape) if strides is None else strides.cast("array<long>")).alias("strides"), F.lit(offset).cast("long").alias("byte_offset"), values.alias("values"))


def is_contiguous(tensor: Column) -> Column:
    return (tensor["strides"] == contiguous_strides(tensor["shape"])) & (tensor["byte_offset"] == 0)


def checked(tensor: Column, shape_ok: Column, what: str) -> Column:
    """The tensor if it is a contiguous f32 tensor of a fitting shape with all its values; else raises."""
    size = F.aggregate(tensor["shape"], F.lit(1).cast("long"), lambda a, x: a * x)
    ok = (tensor["dtype"] == "f32") & is_contiguous(tensor) & shape_ok & (F.size(tensor["values"]) == size)
    return F.when(ok, tensor).otherwise(F.raise_error(F.lit(f"{what}: unfit tensor")))


def decode_detections(df: DataFrame, tensor: str = "tensor") -> DataFrame:
    """[N, 6] tensors of x0, y0, x1, y1, score, class: one row each, n being its place; other shapes raise."""
    t = F.col(tensor)
    t = checked(t, (F.size(t["shape"]) == 2) & (t["shape"][1] == 6), "detections")
    rows = df.withColumn("_t", t).withColumn("n", F.explode(F.when(F.col("_t.shape")[0] > 0, F.sequence(F.lit(0).cast("long"), F.col("_t.shape")[0] - 1))))
    at = lambda k: F.get(F.col("_t.values"), (F.col("n") * 6 + k).cast("int"))
    return rows.withColumns({c: at(k) for k, c in enumerate(("x0", "y0", "x1", "y1", "score"))} | {"class_id": at(5).cast("long")}).drop("_t", tensor)


def decode_mask(df: DataFrame, threshold: float, tensor: str = "tensor") -> DataFrame:
    """[H, W], [1, H, W] or [1, 1, H, W] scores: adds height, width and mask, 1 where a finite score meets the threshold."""
    t = F.col(tensor)
    n = F.size(t["shape"])
    lead = F.forall(F.slice(t["shape"], 1, F.greatest(n - 2, F.lit(0))), lambda x: x == 1)
    t = checked(t, n.between(2, 4) & lead, "scores")
    out = df.withColumn("_t", t)
    meets = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")) & (x >= threshold), 1).otherwise(0)
    return out.withColumns({"height": F.element_at("_t.shape", -2), "width": F.element_at("_t.shape", -1), "mask": F.transform("_t.values", meets)}).drop("_t", tensor)


def pack_chw(pixels: DataFrame, height: int, width: int, scale: float, mean: tuple[float, ...], std: tuple[float, ...]) -> DataFrame:
    """(image_id, y, x, v as array of channels) to (image_id, place, value): planes one after the other, each value
    scaled, less the mean, over the deviation of its channel."""
    if any(s == 0 for s in std) or len(mean) != len(std):
        raise ValueError("a deviation for each channel, none of them zero")
    each = pixels.select("image_id", "y", "x", F.posexplode("v").alias("c", "_v"))
    pick = lambda values: F.get(F.array(*(F.lit(float(x)) for x in values)), F.col("c"))
    return each.select("image_id", (F.col("c") * height * width + F.col("y") * width + F.col("x")).cast("long").alias("place"), ((F.col("_v") * scale - pick(mean)) / pick(std)).alias("value"))


def swap_red_blue(df: DataFrame, r: str = "r", b: str = "b") -> DataFrame:
    return df.withColumns({r: F.col(b), b: F.col(r)})


def gray_to_rgb(df: DataFrame, v: str = "v") -> DataFrame:
    return df.withColumns({c: F.col(v) for c in "rgb"}).drop(v)


def canonical_json(text: Column) -> Column:
    """Text of a JSON value with the keys of its objects in order and no blanks; invalid text raises."""
    return F.to_json(F.parse_json(text))


def json_at(text: Column, path: str, to: str) -> Column:
    """The value at a path ($.a[0].b) of JSON text, null where there is none or it is of another kind."""
    return F.try_variant_get(F.try_parse_json(text), path, to)
