import sqlite3

import numpy as np
import pytest

from pointweave.sources import arrow, bags, octree


def test_octree_prunes_folders_and_reads_levels(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.random((3000, 3)) * [100, 60, 10]
    df = spark.createDataFrame([(k, *map(float, v), k % 5) for k, v in enumerate(x)], "pid long, x double, y double, z double, class int")
    to = str(tmp_path / "tree")
    head = octree.write(df, to, levels=4, spacing=25.0)
    assert octree.info(spark, to) == head and head["points"] == 3000
    whole = octree.read(spark, to)
    assert sorted((p.pid, p.x, p["class"]) for p in whole.collect()) == [(k, v[0], k % 5) for k, v in enumerate(x)]
    box = octree.read(spark, to, (10, 10, 2), (40, 30, 7))
    want = {k for k, v in enumerate(x) if 10 <= v[0] <= 40 and 10 <= v[1] <= 30 and 2 <= v[2] <= 7}
    assert {p.pid for p in box.collect()} == want
    assert len(box.inputFiles()) == len(whole.inputFiles())  # the plan prunes, the reader lists
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200] and "GreaterThanOrEqual(x" in plan
    low = np.floor((x - x.min(0)) / 25.0)
    first = {tuple(v): k for k, v in reversed(list(enumerate(low)))}
    coarse = octree.read(spark, to, resolution=25.0)
    assert {p.pid for p in coarse.collect()} == set(first.values())
    assert octree.level_for(head, 30) == 0 and octree.level_for(head, 12.5) == 1 and octree.level_for(head, 0.001) == 3
    index = octree.nodes(spark, to)
    assert index.agg({"points": "sum"}).first()[0] == 3000
    node = index.orderBy("points", ascending=False).first().node
    assert octree.read_node(spark, to, node).count() == whole.where(f"node = '{node}'").count() > 0
    from pyspark.sql import functions as F

    got = [(c.node, c.points) for c in octree.chosen(index, F.col("points").cast("double"), 900, 7).orderBy("ord").collect()]
    sizes = sorted(((r["sum(points)"], r.node) for r in index.groupBy("node").sum("points").collect()), key=lambda t: (-t[0], t[1]))
    left, want = 900, []
    for n, k in sizes:
        if len(want) < 7 and n <= left:
            left -= n
            want.append((k, n))
    assert got == want
    with pytest.raises(ValueError):
        octree.write(df.where("false"), to)


def bag(path, clouds, moves):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
    db.execute("CREATE TABLE messages (id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/lidar", bags.CLOUD_TYPE), (2, "/tf", bags.TF_TYPE), (3, "/log", "std_msgs/msg/String")])
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(k, 1, 100 - k, c) for k, c in enumerate(clouds)] + [(50 + k, 2, 7 - k, m) for k, m in enumerate(moves)] + [(90, 3, 1, b"x")])
    db.commit()
    db.close()


def test_bags_and_messages(spark, tmp_path):
    r = np.random.default_rng(2)
    xyz = [r.random((n, 3)).astype(np.float32) for n in (5, 0, 40)]
    clouds = [bags.encode_cloud("lidar_é", 12_000_000_345 + k, x, x[:, 0] * 2 if k != 2 else None) for k, x in enumerate(xyz)]
    moves = [bags.encode_transforms([(k * 10**9 + 5, "map", f"base{k}", 1.0, 2.0, 3.0, 0.0, 0.0, 0.5, 0.5)] * (k + 1)) for k in range(3)]
    bag(tmp_path / "a.db3", clouds, moves)
    bag(tmp_path / "b.db3", clouds[:1], [])
    for c, x in zip(clouds, xyz):
        d = bags.decode_cloud(c)
        assert d["frame_id"] == "lidar_é" and np.array_equal(np.column_stack([d[a] for a in "xyz"]), x)
    got = {(t.topic, t.messages, t.largest) for t in bags.topic_list(spark, str(tmp_path)).collect()}
    assert got == {("/lidar", 4, max(map(len, clouds))), ("/tf", 3, len(moves[2])), ("/log", 2, 1)}
    p = bags.clouds(spark, str(tmp_path), chunk=16).orderBy("path", "sequence", "pid").collect()
    assert len(p) == 50 and {(c.sequence, c.pid) for c in p if c.path.endswith("a.db3")} == {(0, k) for k in range(5)} | {(2, k) for k in range(40)}
    assert all((c.intensity is None) == (c.sequence == 2) for c in p) and p[0].ts_ns == 12_000_000_345 and p[0].x == xyz[0][0, 0]
    t = bags.transforms(spark, str(tmp_path), "/tf", 2).orderBy("ts_ns", "place").collect()
    assert [(m.sequence, m.place, m.child, m.qw) for m in t] == [(51, 0, "base1", 0.5), (51, 1, "base1", 0.5), *((52, k, "base2", 0.5) for k in range(3))]
    for bad in (clouds[0][:-30], b"\x09\x01\x00\x00", b""):
        with pytest.raises(ValueError):
            bags.decode_cloud(bad)


def test_arrow_readers_and_c_data(spark):
    import ctypes

    import pyarrow as pa

    df = spark.range(1000).selectExpr("id as pid", "id * 0.5D as x", "cast(id % 3 as int) as class")
    batches = list(arrow.reader(df, 100))
    assert all(b.num_rows <= 100 for b in batches) and sum(b.num_rows for b in batches) == 1000
    back = arrow.from_reader(spark, pa.RecordBatchReader.from_batches(batches[0].schema, iter(batches)))
    assert back.exceptAll(df).isEmpty() and back.count() == 1000
    assert [b.num_rows for b in arrow.memory_sink(df.coalesce(1), 400)] == [400, 400, 200]
    held = [ctypes.create_string_buffer(128) for _ in range(2)]  # room for the two structs
    at = [ctypes.addressof(c) for c in held]
    arrow.to_c(df, *at)
    assert arrow.from_c(spark, *at).exceptAll(df).isEmpty()
