import math

import numpy as np
import pytest

from pointweave import traits
from pointweave.operators import points as pts
from pointweave.operators import regions


def test_region_growing_against_brute_force(spark):
    r = np.random.default_rng(1)
    n = 150
    x = r.random((n, 3)) * [6, 6, 0.2]
    normal = np.array([[0, 0, 1.0]] * n) + r.normal(0, 0.25, (n, 3))
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    curve = r.random(n) * 0.1
    df = spark.createDataFrame([(k, *map(float, (*x[k], *normal[k], curve[k]))) for k in range(n)], "pid long, x double, y double, z double, nx double, ny double, nz double, curvature double")
    d2 = ((x[:, None] - x) ** 2).sum(2)
    for flat, least in ((0.05, 1), (0.0, 2), (1.0, 3)):
        done, regions_of = [False] * n, []
        for start in sorted(range(n), key=lambda k: (curve[k], k)):
            if done[start]:
                continue
            done[start], queue, region = True, [start], [start]
            while queue:
                c = queue.pop(0)
                for m in sorted((m for m in range(n) if m != c), key=lambda m: (d2[c, m], m))[:6]:
                    if not done[m] and abs(normal[c] @ normal[m]) >= math.cos(0.3):
                        done[m] = True
                        region.append(m)
                        if curve[m] <= flat:
                            queue.append(m)
            regions_of.append(region)
        fit = [g for g in regions_of if len(g) >= least]
        want = {k: -1 for k in range(n)} | {k: i for i, g in enumerate(fit) for k in g}
        got = {p.pid: p.label for p in regions.region_growing(df.repartition(5), 6, 0.3, flat, least).collect()}
        assert got == want


def test_cylinder(spark):
    r = np.random.default_rng(2)
    a = r.random(200) * 2 * np.pi
    n = np.column_stack((np.cos(a), np.sin(a), np.zeros(200)))
    x = np.column_stack((3 + 2 * n[:, 0], 1 + 2 * n[:, 1], r.random(200) * 5))
    x[:40] = r.random((40, 3)) * 20 + 20
    df = spark.createDataFrame([(k, *map(float, (*x[k], *n[k]))) for k in range(200)], "pid long, x double, y double, z double, nx double, ny double, nz double")
    m, marked = regions.ransac_cylinder(df, 0.05, 0.5, 5.0)
    assert abs(m[6] - 2) < 1e-6 and abs(abs(m[5]) - 1) < 1e-6 and marked.where("inlier").count() == 160
    with pytest.raises(ValueError):
        regions.ransac_cylinder(df, 0.05, 1e9)


def test_pixel_components_and_distances(spark):
    r = np.random.default_rng(3)
    masks = [(r.random((14, 17)) < p).astype(int) for p in (0.5, 0.65)]
    rows = [(i, y, x, int(m[y, x])) for i, m in enumerate(masks) for y in range(14) for x in range(17)] + [(2, 0, 0, 1), (2, 0, 1, 1)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, v int").repartition(5)
    for diagonal in (False, True):
        got = {(c.image_id, c.label): c for c in regions.image_components(df.where("v = 1"), 17, diagonal).collect()}
        n = 0
        for i, m in enumerate(masks):
            seen, label = np.zeros_like(m), 0
            for y in range(14):
                for x in range(17):
                    if not m[y, x] or seen[y, x]:
                        continue
                    label, queue, mine = label + 1, [(y, x)], []
                    seen[y, x] = 1
                    while queue:
                        cy, cx = queue.pop()
                        mine.append((cy, cx))
                        for dy in (-1, 0, 1):
                            for dx in (-1, 0, 1):
                                ny, nx = cy + dy, cx + dx
                                if (diagonal or dy * dx == 0) and 0 <= ny < 14 and 0 <= nx < 17 and m[ny, nx] and not seen[ny, nx]:
                                    seen[ny, nx] = 1
                                    queue.append((ny, nx))
                    c, p = got[i, label], np.array(mine)
                    assert (c.area, c.x0, c.y0, c.x1, c.y1) == (len(p), *p.min(0)[::-1], *(p.max(0)[::-1] + 1)) and np.allclose((c.cx, c.cy), p.mean(0)[::-1])
            n += label
        assert len(got) == n + 1
    got = {(c.image_id, c.y, c.x): c.distance for c in regions.distance_transform(df, 2.0, 1.0).collect()}
    for i, m in enumerate(masks):
        oy, ox = np.nonzero(m == 0)
        for y in range(14):
            for x in range(17):
                assert math.isclose(got[i, y, x], np.sqrt((2 * (oy - y)) ** 2 + (ox - x) ** 2).min())
    assert got[2, 0, 0] == got[2, 0, 1] == math.inf


def test_soft_suppression_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(k, k % 2, *(a := r.random(2) * 20).tolist(), *(a + 2 + r.random(2) * 9).tolist(), float(round(r.random(), 1))) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, image_id int, x0 double, y0 double, x1 double, y1 double, score double")

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return 0.0 if w <= 0 or h <= 0 else w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)

    for method in ("hard", "linear", "gaussian"):
        want = []
        for image in (0, 1):
            left, n = {x[0]: [x, x[6]] for x in rows if x[1] == image}, 0
            while left:
                k = min(left, key=lambda k: (-left[k][1], k))
                if left[k][1] < 0.2:
                    break
                box, s = left.pop(k)
                want.append((image, k, s, n))
                n += 1
                for v in left.values():
                    o = iou(box, v[0])
                    if method == "gaussian":
                        v[1] *= math.exp(-o * o / 0.5)
                    elif o > 0.3:
                        v[1] *= 0 if method == "hard" else 1 - o
        got = sorted((x.image_id, x.ord, x.id, x.score) for x in regions.soft_nms(df, 0.2, 0.3, method).collect())
        want.sort(key=lambda w: (w[0], w[3]))
        assert [(g[0], g[2], g[1]) for g in got] == [(w[0], w[1], w[3]) for w in want] and np.allclose([g[3] for g in got], [w[2] for w in want])


def test_chains_and_sessions(spark):
    df = spark.createDataFrame([(k, float(k), 0.0, 0.0, [float(k), 1.0] if k % 4 else None) for k in range(10)], "pid long, x double, y double, z double, features array<double>")
    half = traits.Closure("half", lambda d: pts.scale(d, 0.5))
    crop = traits.Closure("crop", lambda d: pts.crop_box(d, (1, -1, -1), (3, 1, 1)))
    assert isinstance(half, traits.CloudFilter) and isinstance(half, traits.GraphOperator) and not isinstance(half, traits.Segmenter)
    assert sorted(r.x for r in traits.Chain((half, crop)).filter(df).collect()) == [1.0, 1.5, 2.0, 2.5, 3.0]
    assert half.apply([df])[0].count() == 10
    with pytest.raises(ValueError):
        half.apply([df, df])
    w1, w2 = ((1.0, -1.0), (0.0, 1.0)), ((2.0,), (1.0,))
    s = traits.Session(traits.MatrixBackend(((w1, (0.5, 0.0)), (w2, (1.0,)))), 2, 1, batch=3)
    for r in s.infer(df, "features").collect():
        if r.features is None:
            assert r.output is None
        else:
            h = np.maximum(np.array(r.features) @ np.array(w1) + [0.5, 0], 0)
            assert np.allclose(r.output, h @ np.array(w2) + 1)
    mock = traits.EntityEmbedder(traits.Session(traits.MockBackend((3.0, 4.0)), 2, 2))
    assert {tuple(r.embedding) for r in mock.estimate(df).collect() if r.embedding} == {(0.6, 0.8)}
    with pytest.raises(Exception, match="rows of 5 numbers"):
        traits.Session(traits.MockBackend((1.0,)), 5, 1).infer(df, "features").collect()
