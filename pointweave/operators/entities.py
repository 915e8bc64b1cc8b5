"""Vector and label search, statistics of runs, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n >= 1e-12, dot(a, b) / n)


def semantic_search(df: DataFrame, query: list[float], k: int, embedding_weight: float = 0.7, label_weight: float = 0.3) -> DataFrame:
    """id, score of the k best: weighted cosine and label confidence; an entity without embedding scores by label."""
    q = F.array(*(F.lit(float(x)) for x in query))
    s = embedding_weight * F.coalesce(cosine(F.col("embedding"), q), F.lit(0.0)) + label_weight * F.col("confidence")
    return df.withColumn("score", s).orderBy(F.desc("score"), "id").limit(k).select("id", "score")


def stage_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """min, median, nearest-rank p95, max, mean, population deviation and its ratio to the mean."""
    v = F.col(value)
    out = df.groupBy(key).agg(F.min(v).alias("lo"), F.percentile(v, 0.5).alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0))


def legend(classes: DataFrame, entities: DataFrame) -> DataFrame:
    """Every class with its count and confidences, zero where it has no entity."""
    n = entities.groupBy("class_id").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
    return classes.join(n, "class_id", "left").fillna(0, ["n", "best"])


def ground(df: DataFrame, cell: float, radius: int, height: float) -> DataFrame:
    """Ground mask: least height of each cell, least of the cells within radius, and a height limit above it."""
    keyed = df.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    low = keyed.groupBy("cx", "cy").agg(F.min("z").alias("low"))
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    spread = low.withColumn("dx", F.explode(reach)).withColumn("dy", F.explode(reach)).groupBy((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy")).agg(F.min("low").alias("ref"))
    return keyed.join(spread, ["cx", "cy"]).withColumn("is_ground", F.col("z") - F.col("ref") <= height).select(*df.columns, "is_ground")
