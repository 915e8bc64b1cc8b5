import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import geometry, images
from pointweave.sources import clouds
from pointweave.streaming import flows

CLOUD = "pid long, x double, y double, z double"


def cloud(spark, xyz):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], CLOUD)


def test_normals_equal_brute_force(spark):
    p = np.random.default_rng(1).normal(size=(120, 3))
    got = {r.pid: r for r in geometry.normals(cloud(spark, p), 0.9).collect()}
    for k in range(len(p)):
        d = ((p - p[k]) ** 2).sum(1)
        near = [j for j in range(len(p)) if j != k and d[j] <= 0.81]
        if len(near) < 3:
            assert np.isnan(got[k].nx)
            continue
        value, vector = np.linalg.eigh(np.cov(p[near].T))
        assert abs(abs(vector[:, 0] @ [got[k].nx, got[k].ny, got[k].nz]) - 1) < 1e-6
        assert got[k].curvature == pytest.approx(value[0] / value.sum(), abs=1e-9)


def test_planes_and_spheres(spark):
    rng = np.random.default_rng(2)
    flat = np.column_stack((rng.uniform(-5, 5, (200, 2)), np.full(200, 2.0)))
    far = rng.uniform(5, 9, (40, 3))
    model, marked = geometry.ransac(cloud(spark, np.concatenate((flat, far))), 0.05, tries=40)
    assert marked.where("inlier").count() == 200 and abs(abs(model[2]) - 1) < 1e-6 and abs(abs(model[3]) - 2) < 1e-6
    u = rng.normal(size=(150, 3))
    ball = u / np.linalg.norm(u, axis=1)[:, None] * 3 + [1, 2, 3]
    model, _ = geometry.ransac(cloud(spark, ball), 0.01, "sphere", tries=10)
    assert model == pytest.approx((1, 2, 3, 3), abs=1e-6)
    assert geometry.ransac(cloud(spark, flat[:2]), 0.1)[0] is None
    room = np.concatenate((flat, np.column_stack((np.full(100, 20.0), rng.uniform(-5, 5, 100), rng.uniform(3, 9, 100)))))
    n = {r.label: r["count"] for r in geometry.multi_plane(cloud(spark, room), 0.05, 3, 50, 60).groupBy("label").count().collect()}
    assert n == {0: 200, 1: 100}


@pytest.mark.parametrize("plane", [False, True])
def test_icp_finds_the_motion(spark, plane):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 10, (150, 3))
    a = 0.02
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    target = cloud(spark, p @ r.T + [0.05, -0.03, 0.02])
    if plane:
        n = rng.normal(size=(150, 3))
        n /= np.linalg.norm(n, axis=1)[:, None]
        target = target.join(spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(n)], "pid long, nx double, ny double, nz double"), "pid")
    m, e = geometry.icp(cloud(spark, p), target, 1.0, 8, plane=plane)
    assert np.abs(m[:3, :3] - r).max() < 1e-3 and e < 1e-4


def test_boundary_box_and_farthest(spark):
    grid = [(i, j, 0) for i in range(5) for j in range(5)]
    flat = cloud(spark, grid).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    edge = {r.pid for r in geometry.boundary(flat, 1.5, 1.7).where("is_boundary").collect()}
    assert edge == {k for k, (i, j, _) in enumerate(grid) if i in (0, 4) or j in (0, 4)}
    box = geometry.obb(cloud(spark, [(i, j * 0.1, 0) for i in range(5) for j in range(5)])).orderBy("axis").collect()
    assert [round(r.hi - r.lo, 6) for r in box] == [4, 0.4, 0]
    assert [r.pid for r in geometry.farthest_points(cloud(spark, [(0, 0, 0), (1, 0, 0), (9, 0, 0), (5, 0, 0)]), 9, 0).orderBy("ord").collect()] == [0, 2, 3, 1]


def test_files(spark, tmp_path):
    (tmp_path / "a.pcd").write_text("VERSION .7\nFIELDS x y label\nSIZE 4 8 4\nTYPE F F I\nCOUNT 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA ascii\n1 2 3\n4 5.5 -6\n")
    assert [tuple(r)[1:] for r in clouds.read(spark, str(tmp_path / "a.pcd")).orderBy("pid").collect()] == [(0, 1.0, 2.0, 3), (1, 4.0, 5.5, -6)]
    raw = np.array([1, 1, 1, 1], "<f4").tobytes()
    packed = bytes([3]) + raw[:4] + bytes([(7 << 5), 3, 3])
    assert clouds.lzf(packed, 16) == raw
    head = b"FIELDS x\nSIZE 4\nTYPE F\nCOUNT 1\nWIDTH 4\nHEIGHT 1\nPOINTS 4\nDATA binary_compressed\n"
    (tmp_path / "b.pcd").write_bytes(head + struct.pack("<II", len(packed), 16) + packed)
    assert [r.x for r in clouds.read(spark, str(tmp_path / "b.pcd")).collect()] == [1.0] * 4
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty uchar red\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n7 255\n")
    assert [(r.x, r.red) for r in clouds.read(spark, str(tmp_path / "c.ply")).collect()] == [(7.0, 255)]
    (tmp_path / "d.pgm").write_bytes(b"P5 2 2 255\n" + bytes([1, 2, 3, 4]))
    assert [(r.y, r.x, r.v) for r in clouds.read(spark, str(tmp_path / "d.pgm")).orderBy("pid").collect()] == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)]
    assert clouds.detect("A.COPC.LAZ") == "copc" and clouds.detect("x.txt") is None
    m = clouds.manifest(spark, str(tmp_path))
    assert {r.verdict for r in clouds.validate(m, m).collect()} == {"ok"}
    wrong = m.withColumn("bytes", F.when(F.col("path").endswith("c.ply"), 1).otherwise(F.col("bytes")))
    assert sorted(r.verdict for r in clouds.validate(wrong, m).collect()) == ["ok", "ok", "ok", "size"]


def test_runs_alternate_from_zero(spark):
    df = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 1), (1, 1, 0, 0), (1, 1, 1, 1), (2, 0, 0, 0), (2, 0, 1, 0), (2, 1, 0, 0), (2, 1, 1, 0)], "image_id long, y int, x int, v int")
    assert {r.image_id: r.runs for r in images.rle(df, 2, 2).collect()} == {1: [0, 2, 1, 1], 2: [4]}
    assert images.unrle(images.rle(df, 2, 2), 2).exceptAll(df.select("image_id", "y", "x", "v")).isEmpty()


def test_tracks_keep_their_ids():
    tracks, n = flows.advance([], [(1, 0.9, [0, 0, 10, 10])], 0, 0.3, 2, 1)
    assert tracks[0]["state"] == "tentative"
    tracks, n = flows.advance(tracks, [(1, 0.8, [1, 0, 11, 10]), (2, 0.7, [1, 0, 11, 10])], n, 0.3, 2, 1)
    assert [(t["id"], t["state"], t["hits"]) for t in tracks] == [(0, "confirmed", 2), (1, "tentative", 1)]
    for _ in range(2):
        tracks, n = flows.advance(tracks, [], n, 0.3, 2, 1)
    assert tracks == [] and n == 2


def test_streamed_tracks_and_background(spark, tmp_path):
    det = "stream string, frame long, det long, class_id long, score double, x0 double, y0 double, x1 double, y1 double"
    spark.createDataFrame([("s", f, 0, 1, 0.5, float(f), 0.0, f + 10.0, 10.0) for f in range(4)], det).coalesce(1).write.parquet(str(tmp_path / "det"))
    got = flows.drain(flows.track(flows.source(spark, str(tmp_path / "det"), det)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert got["rows_in"] == 4
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("frame").collect()
    assert [(r.frame, r.id, r.hits, r.state) for r in rows] == [(0, 1, 1, "tentative"), (1, 1, 2, "tentative"), (2, 1, 3, "confirmed"), (3, 1, 4, "confirmed")]
    pix = "y long, x long, frame long, v double"
    spark.createDataFrame([(0, 0, f, 200.0 if f == 5 else 10.0) for f in range(6)], pix).coalesce(1).write.parquet(str(tmp_path / "pix"))
    flows.drain(flows.background(flows.source(spark, str(tmp_path / "pix"), pix)), str(tmp_path / "fg"), str(tmp_path / "state2"))
    assert [r.foreground for r in spark.read.parquet(str(tmp_path / "fg")).orderBy("frame").collect()] == [False] * 5 + [True]


def test_background_learns_foreground_slowly(spark, tmp_path):
    r = np.random.default_rng(2)
    frames = r.integers(90, 110, (12, 3, 40)).astype(float)
    frames[5:9, 1, 33:] = 240
    rows = [(y, x, f, float(frames[f, y, x])) for f in range(12) for y in range(3) for x in range(40)]
    pix = "y long, x long, frame long, v double"
    for part in range(2):  # the state goes on over micro-batches
        spark.createDataFrame([x for x in rows if x[2] // 6 == part], pix).coalesce(1).write.mode("append").parquet(str(tmp_path / "pix"))
        flows.drain(flows.background(flows.source(spark, str(tmp_path / "pix"), pix), 0.05, 2.0, 50.0), str(tmp_path / "fg"), str(tmp_path / "state"))
    got = {(x.frame, x.y, x.x): x.foreground for x in spark.read.parquet(str(tmp_path / "fg")).collect()}
    for y in range(3):
        for x in range(40):
            mean, var = frames[0, y, x], 50.0
            assert not got[0, y, x]
            for f in range(1, 12):
                d = frames[f, y, x] - mean
                fore = abs(d) > 2.0 * max(var, 1.0) ** 0.5
                a = 0.005 if fore else 0.05
                mean, var = mean + a * d, max((1 - a) * var + a * d * d, 1.0)
                assert got[f, y, x] == fore
    assert sum(got.values()) >= 28
