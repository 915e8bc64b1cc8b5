"""Stamped records: sync bundles, frames, schemas, provenance, limits and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.robust import compose, inverse, turned
from .shared import cut
from .timeline import nearest_in_time


def tight(records: DataFrame, most_ns: int) -> DataFrame:
    return records.where(F.col("uncertainty_ns") <= most_ns)


def bundles(records: DataFrame, primary: str, others: list[str], gap_ns: int, most_ns: int) -> DataFrame:
    """One row for each tight primary record that has a tight record of every other topic within gap_ns: its id and
    ts_ns, and <topic>_id and <topic>_dt of the nearest (ties: the earlier). A record may serve several primaries."""
    good = tight(records, most_ns)
    out = good.where(F.col("topic") == primary).select("id", "ts_ns")
    for t in others:
        m = nearest_in_time(good.where(F.col("topic") == primary), good.where(F.col("topic") == t), gap_ns)
        out = out.join(m.select("id", F.col("match_id").alias(f"{t}_id"), F.col("dt").alias(f"{t}_dt")), "id")
    return out


def sync_preview(bundled: DataFrame, others: list[str]) -> DataFrame:
    gap = F.greatest(*(F.col(f"{t}_dt") for t in others)) if len(others) > 1 else F.col(f"{others[0]}_dt")
    return bundled.agg(F.count("*").alias("bundles"), F.max(gap).alias("most_dt"), *(F.count_distinct(f"{t}_id").alias(f"{t}_used") for t in others))


def resolve_frames(edges: DataFrame, source: str, rounds: int = 64) -> DataFrame:
    """(frame, r, t): the motion from `source` coordinates to every frame reachable over edges (parent, child, r, t),
    which map child to parent coordinates, and their inverses. Breadth first, one join a round; a frame keeps the
    motion found first (ties: the neighbour with the smallest name)."""
    back = inverse(F.col("r"), F.col("t"))
    step = edges.select(F.col("child").alias("a"), F.col("parent").alias("b"), F.col("r").alias("er"), F.col("t").alias("et"))
    step = step.unionByName(edges.select(F.col("parent").alias("a"), F.col("child").alias("b"), back[0].alias("er"), back[1].alias("et")))
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    seen = front = edges.sparkSession.createDataFrame([(source, one, [0.0] * 3)], "frame string, r array<double>, t array<double>")
    for _ in range(rounds):
        r, t = compose(F.col("er"), F.col("et"), F.col("r"), F.col("t"))
        new = front.join(step, front.frame == step.a).select("b", F.col("a").alias("via"), r.alias("r"), t.alias("t"))
        new = new.groupBy("b").agg(F.min_by(F.struct("r", "t"), "via").alias("m")).select(F.col("b").alias("frame"), "m.r", "m.t")
        front = cut(new.join(seen.select("frame"), "frame", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    raise RuntimeError(f"frames lie more than {rounds} steps from {source}")


def to_frame(points: DataFrame, motions: DataFrame) -> DataFrame:
    """Points (x, y, z, frame) moved by their frame's motion (frame, r, t); points of unknown frames go."""
    p = points.join(motions, "frame")
    x, y, z = turned(F.col("r"), F.array("x", "y", "z"))
    return p.withColumns({"x": x + F.col("t")[0], "y": y + F.col("t")[1], "z": z + F.col("t")[2]}).drop("r", "t")


def compare_schemas(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Fields (schema_id, major, name, dtype) of two registries -> a row for each schema id of both: counts of missing,
    extra and conflicting fields and the verdict. Another major version or any conflict is incompatible."""
    a = actual.select("schema_id", F.col("major").alias("a_major"), "name", F.col("dtype").alias("a_dtype"))
    ids = expected.groupBy("schema_id").agg(F.max("major").alias("major")).join(a.groupBy("schema_id").agg(F.max("a_major").alias("a_major")), "schema_id")
    both = expected.select("schema_id", "name", "dtype").join(a.drop("a_major"), ["schema_id", "name"], "full")
    n = both.groupBy("schema_id").agg(F.count_if(F.col("a_dtype").isNull()).alias("missing"), F.count_if(F.col("dtype").isNull()).alias("extra"), F.count_if(F.col("dtype") != F.col("a_dtype")).alias("conflicting"))
    verdict = F.when((F.col("major") != F.col("a_major")) | (F.col("conflicting") > 0) | ((F.col("missing") > 0) & (F.col("extra") > 0)), "incompatible").when(F.col("extra") > 0, "backward").when(F.col("missing") > 0, "forward").otherwise("identical")
    return ids.join(n, "schema_id").select("schema_id", "missing", "extra", "conflicting", verdict.alias("verdict"))


def migrate(df: DataFrame, target: StructType, fill: float | None = None, drop_unknown: bool = False) -> DataFrame:
    """The target's fields in its order: unknown ones dropped, missing ones filled, none cast; ValueError where the
    policy does not allow it."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in target.fields}
    missing, extra = [n for n in want if n not in have], [n for n in have if n not in want]
    conflict = [n for n in want if n in have and have[n] != want[n]]
    if conflict or (missing and extra) or (extra and not drop_unknown) or (missing and fill is None):
        raise ValueError(f"cannot migrate: missing {missing}, extra {extra}, conflicting {conflict}")
    return df.select(*(F.col(n) if n in have else F.lit(fill).cast(t).alias(n) for n, t in want.items()))


def entity_id(source: Column, stream: Column, sequence: Column) -> Column:
    return F.concat(F.lit("record:"), source, F.lit(":"), F.coalesce(stream, F.lit("record")), F.lit(":"), F.coalesce(sequence.cast("string"), F.lit("unsequenced")))


def valid_provenance(version: int = 1) -> Column:
    blank = lambda c: F.trim(F.col(c)) == ""
    return (F.col("version") == version) & ~blank("source_id") & ~F.coalesce(blank("source_uri"), F.lit(False)) & ~F.coalesce(blank("stream_id"), F.lit(False))


def within_limits(records: DataFrame, episode: str, order: list[str], most: dict[str, int], most_records: int) -> DataFrame:
    """The records of each episode before the first that breaks a limit on its rows or on a running sum."""
    w = Window.partitionBy(episode).orderBy(*order)
    sums = {f"_{c}": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in most}
    d = records.withColumns({"_n": F.row_number().over(w), **sums})
    ok = F.col("_n") <= most_records
    for c, limit in most.items():
        ok &= F.col(f"_{c}") <= limit
    return d.where(ok).drop("_n", *sums)


def stable(runs: DataFrame, run: str, columns: list[str]) -> DataFrame:
    """Whether every run has the same values as the others, column by column."""
    return runs.agg(F.count_distinct(run).alias("runs"), *((F.count_distinct(F.struct(c)) == 1).alias(f"same_{c}") for c in columns))


def hash_differences(outputs: DataFrame, run: str, name: str, digest: str) -> DataFrame:
    """Names whose hash is not the same in all runs, or missing from some."""
    all_runs = outputs.select(F.count_distinct(run).alias("all"))
    n = outputs.groupBy(name).agg(F.count_distinct(run).alias("runs"), F.count_distinct(digest).alias("digests"))
    return n.join(F.broadcast(all_runs)).where((F.col("digests") > 1) | (F.col("runs") < F.col("all"))).select(name, "runs", "digests")


def health(checks: DataFrame, status: str = "status", blocking: str = "blocking", critical: str = "critical") -> DataFrame:
    return checks.agg(F.count_if(F.col(status) == "pass").alias("passed"), F.count_if(F.col(status) == "warning").alias("warnings"), F.count_if(F.col(blocking)).alias("blocked"), F.count_if(F.col(critical)).alias("critical"))


def semantic_summary(entities: DataFrame, confidence: str = "confidence", label: str = "class_id") -> DataFrame:
    """Count, labelled share, mean and nearest-rank p95 of the confidence, and distinct classes."""
    has = F.col(label).isNotNull()
    return entities.agg(F.count("*").alias("n"), (F.count_if(has) / F.count("*")).alias("coverage"), F.avg(confidence).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {confidence})").alias("p95"), F.count_distinct(label).alias("classes"))


def receipts(chunks: DataFrame, stream: str, points: str, size: str) -> DataFrame:
    """What each stream's chunks came to: chunks, points, bytes, and the largest chunk."""
    return chunks.groupBy(stream).agg(F.count("*").alias("chunks"), F.sum(points).alias("points"), F.sum(size).alias("bytes"), F.max(size).alias("most_bytes"))
