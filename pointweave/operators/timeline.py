"""Ordered sequences: nearest-in-time alignment, deltas, subsampling, interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .shared import cut


def nearest_in_time(primary: DataFrame, other: DataFrame, gap_ns: int) -> DataFrame:
    """For each primary row (id, ts_ns) the nearest other row within gap_ns; equal gaps: the earlier one, then the least
    id. Rows of both sides lie in ranges of time; within a range one pass each way carries the last other time seen, and
    what a range lacks comes from the ends of the ranges around it, so no row meets more than two."""
    o = other.where("ts_ns is not null").groupBy("ts_ns").agg(F.min("id").alias("match_id")).select("ts_ns", F.struct(F.col("ts_ns").alias("match_ns"), "match_id").alias("m"))
    p = primary.where("ts_ns is not null").select("ts_ns", "id").distinct().withColumn("asks", F.lit(True))
    both = p.withColumn("m", F.lit(None).cast(o.schema["m"].dataType)).unionByName(o.withColumns({"id": F.lit(None).cast(p.schema["id"].dataType), "asks": F.lit(False)}))
    both = cut(both.repartitionByRange("ts_ns").withColumn("_part", F.spark_partition_id()))
    ends = both.groupBy("_part").agg(F.min("m").alias("first"), F.max("m").alias("last"))  # one row for each range
    around = Window.orderBy("_part")
    ends = ends.select("_part", F.last("last", True).over(around.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("first", True).over(around.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    seen = lambda *by: F.last("m", True).over(Window.partitionBy("_part").orderBy(*by, "asks").rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("_l", seen("ts_ns")).withColumn("_r", seen(F.desc("ts_ns"))).where("asks").join(F.broadcast(ends), "_part")
    far = lambda m: F.struct(F.abs(F.col("ts_ns") - m["match_ns"]).alias("dt"), m["match_ns"].alias("match_ns"), m["match_id"].alias("match_id"))
    l, r = F.coalesce("_l", "_before"), F.coalesce("_r", "_after")
    near = near.select("id", "ts_ns", F.least(F.when(l.isNotNull(), far(l)), F.when(r.isNotNull(), far(r))).alias("m"))
    return near.where(F.col("m.dt") <= gap_ns).select("id", "ts_ns", "m.match_id", "m.dt")


def deltas(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({"dt": F.col(order) - F.lag(order).over(w), "dv": F.col(value) - F.lag(value).over(w)})


def subsample(df: DataFrame, key: str, order: str, step: int) -> DataFrame:
    """Every step-th row of each key, from the first on; places (column n) are counted within ranges of (key, order)
    and offset by what the ranges before hold of the key, so that a key with a third of all rows is spread."""
    part = cut(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))
    held = part.groupBy("_part", key).count()
    before = F.sum("count").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select("_part", F.col(key).alias("_key"), F.coalesce(before, F.lit(0)).alias("_base"))
    n = part.withColumn("_n", F.row_number().over(Window.partitionBy("_part", key).orderBy(order)) - 1)
    out = n.join(F.broadcast(base), (n["_part"] == base["_part"]) & n[key].eqNullSafe(base["_key"])).withColumn("n", F.col("_n") + F.col("_base"))
    return out.where(F.col("n") % step == 0).select(*df.columns, "n")


def spans(records: DataFrame, annotations: DataFrame, bucket_ns: int | None = None) -> DataFrame:
    """Records (ts_ns) within closed annotation spans (start_ns, end_ns): an equi-join on the time buckets a span
    touches, as wide as the mean span unless stated; a span that ends before it starts holds nothing."""
    if bucket_ns is None:
        mean = annotations.agg(F.avg(F.col("end_ns") - F.col("start_ns"))).first()[0]
        bucket_ns = max(1, int(mean or 1))
    to = lambda c: F.floor(F.col(c) / bucket_ns)
    a = annotations.where("start_ns <= end_ns").withColumn("_b", F.explode(F.sequence(to("start_ns"), to("end_ns"))))
    return records.withColumn("_b", to("ts_ns")).join(a, "_b").where(F.col("ts_ns").between(F.col("start_ns"), F.col("end_ns"))).drop("_b")
