import numpy as np
from pyspark.sql import functions as F

from pointweave.operators import records, timeline


def test_nearest_in_time_against_brute_force(spark):
    r = np.random.default_rng(5)
    p = [(k, int(t)) for k, t in enumerate(r.integers(-500, 3000, 120))] + [(3, None), (900, 100_000)]
    o = [(1000 + k, int(t)) for k, t in enumerate(r.integers(0, 2500, 90))] + [(2000, None), (990, 40), (2001, 40)]
    for gap in (0, 7, 300, 10**7):
        got = {(x.id, x.ts_ns): (x.match_id, x.dt) for x in timeline.nearest_in_time(spark.createDataFrame(p + p[:3], "id long, ts_ns long").repartition(5), spark.createDataFrame(o, "id long, ts_ns long").repartition(5), gap).collect()}
        want = {}
        for i, t in p:
            near = min(((abs(t - u), u, j) for j, u in o if t is not None and u is not None and abs(t - u) <= gap), default=None)
            if near:
                want[i, t] = (near[2], near[0])
        assert got == want
    none = spark.createDataFrame([], "id long, ts_ns long")
    assert timeline.nearest_in_time(none, none, 5).count() == 0


def test_many_records_within_the_gap(spark):
    """40,000 records a side within one gap: 1.6 thousand million pairs, if each met each."""
    n = 40_000
    side = lambda shift, topic: spark.range(n).select((F.col("id") + shift).alias("id"), (F.col("id") * 10 + shift % 7).alias("ts_ns"), F.lit(topic).alias("topic"), F.lit(0).alias("uncertainty_ns"))
    got = timeline.nearest_in_time(side(0, "a"), side(200_000, "b"), 10**9).agg(F.count("*"), F.sum("dt"), F.sum(F.col("match_id") - F.col("id"))).first()
    assert 200_000 % 7 == 3 and tuple(got) == (n, 3 * n, 200_000 * n)
    both = records.bundles(side(0, "a").unionByName(side(300_000, "b")).unionByName(side(200_000, "c")), "a", ["b", "c"], 10**9, 0)
    seen = records.sync_preview(both, ["b", "c"]).first()
    assert (seen.bundles, seen.b_used, seen.c_used) == (n, n, n)
