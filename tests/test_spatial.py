import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelwise.functions import clip, geo
from parcelwise.functions.cells import disk_cells, squares
from parcelwise.functions.sweep import union_area
from parcelwise.operators import counts, overlap
from parcelwise.operators import dissolve as D
from parcelwise.operators import spatial as X


def hav(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    pts = [(rng.uniform(-100, -90), rng.uniform(30, 40)) for _ in range(150)]
    # A third of the points share one spot.
    pts += [(-95.0, 35.0)] * 75
    feats = [(rng.uniform(-101, -89), rng.uniform(29, 41)) for _ in range(120)] + [(-95.01, 35.01)] * 40
    p = spark.createDataFrame([(i, *c) for i, c in enumerate(pts)], "pid long, lng double, lat double")
    f = spark.createDataFrame([(i, *c) for i, c in enumerate(feats)], "fid long, f_lng double, f_lat double")
    return pts, feats, p, f


def test_radius_equals_brute_force(spark, world):
    pts, feats, p, f = world
    got = {(r.pid, r.fid) for r in X.within_radius(p, f, 60_000.0).select("pid", "fid").collect()}
    want = {(i, j) for i, a in enumerate(pts) for j, b in enumerate(feats) if hav(a, b) <= 60_000.0}
    assert got == want


def test_hot_cells_are_split_by_adaptive_execution(spark, world):
    """Equal rows of one cell, on either side, spread over several tasks, with every pair kept."""
    _, _, p, f = world
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        hot = spark.createDataFrame([(10_000 + i, -95.0, 35.0) for i in range(4000)], "pid long, lng double, lat double")
        for points in (hot, p.unionByName(hot)):
            out = X.within_radius(points.repartition(16), f, 5_000.0)
            n = out.count()
            out.collect()
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
            assert n >= 4000 * 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nearest_by_degrees_is_picked_before_the_metre_test(spark):
    """At 60 N: 0.0046 north is 511 m, 0.005 east is 278 m; the first is nearer in degrees and too far in metres."""
    p = spark.createDataFrame([(1, 10.0, 60.0), (2, 10.0, 0.0)], "pid long, lng double, lat double")
    f = spark.createDataFrame([(1, 10.0, 60.0046), (2, 10.005, 60.0), (3, 10.001, 0.0)], "fid long, f_lng double, f_lat double")
    got = {r.pid: r.fid for r in X.nearest_within(p, f, "pid", 500.0, "fid", [], geo.HAVERSINE, geo.DEGREE).collect()}
    assert got == {1: None, 2: 3}


def test_nearest_line_equals_brute_force(spark, world):
    rng = random.Random(9)
    pts, _, p, _ = world
    segs = [(rng.uniform(-101, -89), rng.uniform(29, 41)) for _ in range(60)]
    segs = [(x, y, x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)) for x, y in segs] + [(-60.0, 10.0, -60.0, 10.0)]
    s = spark.createDataFrame([(i, *c) for i, c in enumerate(segs)], "sid long, ax double, ay double, bx double, by double")
    far = spark.createDataFrame([(900, 170.0, -40.0), (901, -60.0, 12.0)], "pid long, lng double, lat double")
    k = geo.SPHERE_M_PER_DEG

    def plain(x, y, c):
        kx = math.cos(math.radians(y)) * k
        px, py, dx, dy = (c[0] - x) * kx, (c[1] - y) * k, (c[2] - c[0]) * kx, (c[3] - c[1]) * k
        t = max(0.0, min(1.0, -(px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(px + t * dx, py + t * dy)

    got = {r.pid: (r.sid, r.dist) for r in X.nearest_line(p.unionByName(far), s, "pid", "sid", []).collect()}
    for pid, (x, y) in [*enumerate(pts), (900, (170.0, -40.0)), (901, (-60.0, 12.0))]:
        want = min((plain(x, y, c), i) for i, c in enumerate(segs))
        assert got[pid][0] == want[1] and math.isclose(got[pid][1], want[0], rel_tol=1e-9)


def test_radius_count_collapses_copies(spark, world):
    pts, feats, p, f = world
    got = {r.pid: r.n for r in counts.radius_count(p, f, "pid", 60_000.0).collect()}
    assert got == {i: sum(hav(a, b) <= 60_000.0 for b in feats) for i, a in enumerate(pts)}


@pytest.mark.parametrize("cell", [0.25, 3.0])
def test_nearest_equals_brute_force(spark, world, cell):
    pts, feats, p, f = world
    got = {r.pid: (r.fid, r.dist) for r in X.nearest(p, f, "pid", "fid", [], cell=cell).collect()}
    for i, a in enumerate(pts):
        d, j = min((hav(a, b), j) for j, b in enumerate(feats))
        assert got[i][1] == pytest.approx(d, abs=1e-6) and got[i][0] == j


def test_nearest_far_from_everything(spark):
    p = spark.createDataFrame([(1, -70.0, 65.0), (2, 170.0, -10.0)], "pid long, lng double, lat double")
    f = spark.createDataFrame([(1, -120.0, 64.0), (2, -71.0, 20.0), (3, -110.0, 66.0)], "fid long, f_lng double, f_lat double")
    got = {r.pid: r.fid for r in X.nearest(p, f, "pid", "fid", [], cell=0.5).collect()}
    assert got[1] == min((hav((-70.0, 65.0), (a, b)), i) for i, a, b in ((1, -120.0, 64.0), (2, -71.0, 20.0), (3, -110.0, 66.0)))[1]


def test_k_nearest(spark, world):
    pts, feats, p, f = world
    rows = X.k_nearest_within(p, f, "pid", 150_000.0, "fid", 3).collect()
    got = {}
    for r in rows:
        got.setdefault(r.pid, {})[r["rank"]] = r.fid
    for i, a in enumerate(pts):
        near = sorted((hav(a, b), j) for j, b in enumerate(feats) if hav(a, b) <= 150_000.0)[:3]
        assert [got.get(i, {}).get(k + 1) for k in range(len(near))] == [j for _, j in near]


def test_points_in_polygons_any_cell(spark):
    tri = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 1.0)], "gid long, x double, y double")
    polys = X.with_extent(
        tri.withColumn("rings", geo.ring([(F.col("x"), F.col("y")), (F.col("x") + 2, F.col("y")), (F.col("x") + 1, F.col("y") + 2)]))
    ).drop("x", "y")
    pts = spark.range(400).select(F.col("id").alias("pid"), ((F.col("id") % 20) / 4.0 + 0.013).alias("lng"), (F.floor(F.col("id") / 20) / 5.0 + 0.017).alias("lat"))
    want = {(r.pid, r.gid) for r in pts.crossJoin(polys).filter(geo.contains("rings", "lng", "lat")).collect()}
    assert len(want) > 20
    for cell in (0.3, 1.0, 7.0):
        got = {(r.pid, r.gid) for r in X.points_in_polygons(pts, polys, cell).collect()}
        assert got == want


def test_polygon_pairs_reported_once(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0)], "aid long, x0 double, y0 double, x1 double, y1 double").withColumn("rings", geo.box_rings("x0", "y0", "x1", "y1"))
    b = spark.createDataFrame([(1, 1.0, 1.0, 9.0, 9.0), (2, 5.0, 0.0, 6.0, 2.0), (3, 7.0, 0.0, 8.0, 1.0)], "bid long, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    b = b.withColumn("b_rings", geo.box_rings("b_x0", "b_y0", "b_x1", "b_y1"))
    got = sorted(r.bid for r in X.polygons_touching(a, b, 0.7).collect())
    assert got == [1, 2]


def _area(spark, a, b):
    rows = spark.createDataFrame([(1,)], "i int").select(
        geo.ring([(float(x), float(y)) for x, y in a]).alias("a"), geo.ring([(float(x), float(y)) for x, y in b]).alias("b")
    )
    from parcelwise.functions.clip import overlap_area

    r = rows.select(overlap_area("a", "b").alias("ab"), overlap_area("b", "a").alias("ba")).first()
    return r.ab, r.ba


def test_overlap_area_concave_and_symmetric(spark):
    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    square = [(0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3)]
    ab, ba = _area(spark, ell, square)
    # L-shape inside the square: 2.5×0.5 across plus 0.5×2 up.
    assert ab == pytest.approx(2.5 * 0.5 + 0.5 * 2.0) and ba == pytest.approx(ab)
    star = [(0, 3), (1, 1), (3, 0), (1, -1), (0, -3), (-1, -1), (-3, 0), (-1, 1)]
    ab, ba = _area(spark, star, list(reversed(ell)))
    n, hits = 300, 0

    def inside(poly, px, py):
        odd = False
        for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    for i in range(n):
        for j in range(n):
            x, y = 4 * (i + 0.5) / n, 4 * (j + 0.5) / n
            hits += inside(star, x, y) and inside(ell, x, y)
    assert ab == pytest.approx(ba) and ab == pytest.approx(hits * 16 / n / n, abs=0.03)


def _boxes(spark, rows, key="kind"):
    df = spark.createDataFrame(rows, f"{key} string, x0 double, y0 double, x1 double, y1 double")
    return df.withColumn("rings", geo.box_rings("x0", "y0", "x1", "y1"))


def test_union_cover_counts_overlap_once(spark):
    parcel = spark.createDataFrame([(1, 0.0, 0.0, 1000.0)], "loc_id long, lng double, lat double, acres double")
    layer = _boxes(spark, [("w", -1.0, -1.0, 1.0, 1.0), ("w", -1.0, -1.0, 1.0, 1.0)])
    boxed = X.with_extent(parcel.withColumn("rings", geo.parcel_rings("lng", "lat", "acres")))
    acres = geo.deg2_to_acres("area_deg2", F.lit(0.0)).alias("acres")
    assert overlap.union_cover(boxed, layer, "loc_id", "kind", 1.0).select(acres).first().acres == pytest.approx(1000.0)
    assert overlap.summed_overlap(boxed, layer, "loc_id", 1.0).select(acres).first().acres == pytest.approx(2000.0)


def test_union_cover_equals_coordinate_compression(spark):
    """Rectangles on whole coordinates, up to hundreds over one parcel, copies included: cells counted one by one."""
    rng = np.random.default_rng(6)
    parcels = _boxes(spark, [("a", 0.0, 0.0, 40.0, 30.0), ("b", 50.0, 50.0, 60.0, 70.0), ("c", 200.0, 200.0, 201.0, 201.0), ("d", 5.0, 5.0, 5.0, 9.0)], "loc_id")
    rows = [("few", 1.0, 1.0, 4.0, 4.0), ("few", 55.0, 40.0, 80.0, 60.0)]
    for _ in range(500):
        x, y = rng.integers(-5, 45), rng.integers(-5, 35)
        rows.append(("many", float(x), float(y), float(x + rng.integers(1, 4)), float(y + rng.integers(1, 4))))
    rows += rows[2:200]
    got = {(r.loc_id, r.kind): r.area_deg2 for r in overlap.union_cover(parcels, _boxes(spark, rows), "loc_id", "kind", 3.0).collect()}
    grid = np.zeros((40, 30), bool)
    for kind, x0, y0, x1, y1 in rows[2:]:
        grid[max(int(x0), 0) : max(int(x1), 0), max(int(y0), 0) : max(int(y1), 0)] = True
    assert got == {("a", "few"): pytest.approx(9.0), ("b", "few"): pytest.approx(50.0), ("a", "many"): pytest.approx(float(grid.sum()))}


def _star(rng, x, y):
    angle = np.sort(np.arange(9) * 2 * np.pi / 9 + rng.uniform(0, 0.6, 9))
    r = rng.uniform(0.2, 1.0, 9)
    px, py = x + r * np.cos(angle), y + r * np.sin(angle)
    return [[{"x": float(a), "y": float(b)} for a, b in zip([*px, px[0]], [*py, py[0]])]]


def test_overlap_kernel_and_sweep_agree_on_concave_polygons():
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    rng = np.random.default_rng(2)
    a, b = (pa.array([_star(rng, *rng.uniform(-120, -119, 2)) for _ in range(80)], kind) for _ in range(2))
    parts = clip.common_parts(a, b).to_pylist()
    ea, eb = clip.ring_edges(a), clip.ring_edges(b)
    for i, part in enumerate(parts):
        m, n = ea[0] == i, eb[0] == i
        edges = [np.concatenate((p[m], q[n])) for p, q in zip(ea[1:], eb[1:])]
        owner = np.repeat([0, 1], [m.sum(), n.sum()])
        assert union_area((-130.0, -130.0, -110.0, -110.0), owner, *edges) == pytest.approx(part["area"], abs=1e-12)
        if part["area"] > 0.3:
            # The centroid by sampling.
            p = rng.uniform(-121.2, -117.8, (60_000, 2))
            held = np.ones(len(p), bool)
            for e, mask in ((ea, m), (eb, n)):
                odd = np.zeros(len(p), bool)
                for x0, y0, x1, y1 in zip(*(c[mask] for c in e[1:])):
                    odd ^= ((y0 > p[:, 1]) != (y1 > p[:, 1])) & (p[:, 0] < (x1 - x0) * (p[:, 1] - y0) / (y1 - y0) + x0)
                held &= odd
            assert np.allclose(p[held].mean(axis=0), [part["lng"], part["lat"]], atol=0.03)
    assert sum(p["area"] > 0.3 for p in parts) > 5
    square = lambda x0, y0, x1, y1: [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]
    pairs = [(square(0, 0, 1, 1), square(1, 1, 2, 2)), (square(0, 0, 1, 1), square(0.2, 0.2, 0.3, 0.3)), (square(0, 0, 1, 1), square(1.5, 0, 2, 1)), (square(0.2, 0.2, 0.3, 0.3), square(0, 0, 1, 1))]
    found = clip.common_parts(pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)).to_pylist()
    assert [p["meets"] for p in found] == [True, True, False, True] and found[0]["area"] == 0 and found[0]["lng"] is None


def _odd(rings, x, y):
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for p, q in zip(ring, ring[1:]):
            if p["y"] != q["y"]:
                odd ^= ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * ((y - p["y"]) / (q["y"] - p["y"])) + p["x"])
    return odd


def test_sums_in_polygons_equal_brute_force(spark):
    """Concave shapes, one far larger than the grid, one with a hole, one tiny; a third of the features on one spot."""
    rng = np.random.default_rng(11)
    x, y = np.concatenate((rng.uniform(-121, -119, 800), np.full(400, -120.1))), np.concatenate((rng.uniform(-121, -119, 800), np.full(400, -120.2)))
    group, weight = rng.integers(0, 3, len(x)), rng.integers(1, 9, len(x))
    square = lambda a, b, c, d: [{"x": float(p), "y": float(q)} for p, q in ((a, b), (c, b), (c, d), (a, d), (a, b))]
    shapes = [_star(rng, *rng.uniform(-120.5, -119.5, 2)) for _ in range(25)]
    shapes += [[square(-150, -150, -119.9, -100)], [square(-120.6, -120.6, -119.6, -119.6), square(-120.2, -120.3, -120.0, -120.0)], [square(-120.11, -120.21, -120.09, -120.19)], [square(0, 0, 1, 1)]]
    polygons = X.with_extent(spark.createDataFrame([(i, r) for i, r in enumerate(shapes)], "shape long, rings array<array<struct<x:double,y:double>>>"))
    features = spark.createDataFrame([(float(a), float(b), int(g), int(w)) for a, b, g, w in zip(x, y, group, weight)], "f_lng double, f_lat double, g int, w long")
    measures = {"n": F.count(F.lit(1)), "heavy": F.sum("w")}
    want = {}
    for i, r in enumerate(shapes):
        held = _odd(r, x, y)
        want |= {(i, g): (int(m.sum()), int(weight[m].sum())) for g in range(3) if (m := held & (group == g)).any()}
    got = {(r.shape, r.g): (r.n, r.heavy) for r in counts.sums_in_polygons(polygons, features, "shape", measures, ["g"]).collect()}
    assert got == want and len(got) > 60


@pytest.mark.parametrize("metric, radius", [(geo.HAVERSINE, 70_000.0), (geo.MERCATOR, 70_000.0), (geo.DEGREE, 0.6), (geo.FLAT, 60_000.0)])
def test_sums_within_radius_equal_pair_list(spark, metric, radius):
    rng = np.random.default_rng(12)
    features = spark.createDataFrame([(float(a), float(b)) for a, b in rng.uniform(0, 3, (900, 2)) + [-100, 55]] + [(-98.5, 56.5)] * 300, "f_lng double, f_lat double")
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-0.5, 3.5, (60, 2)) + [-100, 55])] + [(100 + i, -98.5, 56.5) for i in range(20)], "pid long, lng double, lat double")
    pairs = X.within_radius(points, features, radius, metric).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    got = counts.sums_within_radius(points, features, "pid", radius, {"n": F.count(F.lit(1))}, metric)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and pairs.count() > 60


def test_a_disk_costs_its_boundary_not_its_features():
    """16 times the features cost about 4 times the rows a disk; the pair list costs 16 times."""
    rng, rows, pairs = np.random.default_rng(1), [], []
    for n in (4_000, 64_000):
        p = rng.uniform(0, 10, (n, 2))
        cell = math.sqrt(100 / n)
        c0, r0, state = disk_cells(5.0, 5.0, (2.0, 2.0), 2.0, "degree", cell)
        level, _, _ = squares(c0, r0, state, int(math.log2(2.0 / cell)))
        place = np.floor(p / cell).astype(int) - [c0, r0]
        near = ((place >= 0) & (place < state.shape)).all(axis=1)
        rows.append(len(level) + (state[tuple(place[near].T)] == 1).sum())
        pairs.append((np.hypot(*(p - 5).T) <= 2).sum())
    assert pairs[1] > 12 * pairs[0] and rows[1] < 5 * rows[0] and rows[1] < pairs[1] / 4


def test_nearest_in_a_dense_place_meets_few_candidates(spark):
    """3,000 features in one cell of 0.01 degrees, some far away: a bounded number of candidates a point, the right answers."""
    rng = np.random.default_rng(21)
    xy = np.concatenate((rng.uniform(0, 0.01, (3000, 2)) + [-100, 40], rng.uniform(-1, 1, (30, 2)) + [-100, 40]))
    at = np.concatenate((rng.uniform(0, 0.01, (40, 2)) + [-100, 40], rng.uniform(-0.4, 0.4, (10, 2)) + [-100, 40]))
    features = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(9000 + i, float(xy[0][0]), float(xy[0][1])) for i in range(500)], "fid long, f_lng double, f_lat double")
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "pid long, lng double, lat double")
    spots = X.one_per_spot(features, "fid", [])
    per_point = {r.pid: r.n for r in X.close_pairs(points, spots, 80_000.0, 3).groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(per_point[i] for i in range(40)) < 150 and len(per_point) == 50
    everything = [(i, *p) for i, p in enumerate(xy)] + [(9000 + i, *xy[0]) for i in range(500)]
    want = {(pid, rank + 1): f for pid, p in enumerate(at) for rank, (_, f) in enumerate(sorted((hav(p, q[1:]), q[0]) for q in everything if hav(p, q[1:]) <= 80_000)[:3])}
    assert {(r.pid, r.rank): r.fid for r in X.k_nearest_within(points, features, "pid", 80_000.0, "fid", 3).collect()} == want
    # The grid of an unbounded search follows the density.
    cell = X.density_cell(features)
    cells = X.own_cell(spots, cell, "f_lng", "f_lat")
    links = X.cell_candidates(X.own_cell(points, cell).select(*X.CELL).distinct(), cells.select(*X.CELL).distinct(), cell, geo.HAVERSINE)
    pairs = X.own_cell(points, cell).join(links, X.CELL).join(cells.withColumnsRenamed({"_cx": "_fx", "_cy": "_fy"}), ["_fx", "_fy"]).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    assert max(r.n for r in pairs.collect()) < 300
    assert {r.pid: r.fid for r in X.nearest(points, features, "pid", "fid", []).collect()} == {p: f for (p, rank), f in want.items() if rank == 1}


def test_dissolve_gives_one_ring_with_the_exact_perimeter(spark):
    """Tiles of unequal size (corners on neighbours' edges), a hole, a copy, a tile that touches in one corner."""
    tiles = [("one", i, 0, i + 1, 1) for i in range(6)] + [("one", 0, 1, 2, 2), ("one", 2, 1, 6, 2), ("one", 2, 1, 6, 2)]
    tiles += [("ring", x, y, x + 1, y + 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [("ring", 3, 3, 4, 4), (None, 0, 0, 1, 1)]
    df = _boxes(spark, [(g, *map(float, t)) for g, *t in tiles], "region")
    out = {}
    for r in D.dissolve(df, "region").collect():
        out.setdefault((r.region, r.ring), {})[r.place] = (r.ax, r.ay, r.bx, r.by)
    rings = {}
    for (region, _), steps in out.items():
        path = [steps[i] for i in range(len(steps))]
        assert all(p[2:] == q[:2] for p, q in zip(path, path[1:] + path[:1]))
        area = sum(a * d - c * b for a, b, c, d in path) / 2
        rings.setdefault(region, []).append((area, sum(math.hypot(c - a, d - b) for a, b, c, d in path)))
    assert {k: sorted(v) for k, v in rings.items()} == {"one": [(12.0, 16.0)], "ring": [(-1.0, 4.0), (1.0, 4.0), (9.0, 12.0)]}
    summary = {r.region: (r.members, r.rings, r.perimeter_deg, r.area_deg2) for r in D.dissolve_summary(df, "region").collect()}
    assert summary == {"one": (8, 1, 16.0, 12.0), "ring": (9, 3, 20.0, 9.0)}


def test_exploded_sides_are_never_broadcast(spark, world):
    """Spark sizes an exploded side by the rows before; a small layer with a wide reach would be collected on the driver."""
    _, _, p, f = world
    box = F.struct(F.lit(-99.0).alias("x"), F.lit(31.0).alias("y"))
    polygons = X.with_extent(f.select(F.col("fid").alias("zid"), geo.box_rings(F.col("f_lng"), F.col("f_lat"), F.col("f_lng") + 1, F.col("f_lat") + 1).alias("rings")))
    lines = f.select(F.col("fid").alias("sid"), F.col("f_lng").alias("ax"), F.col("f_lat").alias("ay"), (F.col("f_lng") + 0.3).alias("bx"), F.col("f_lat").alias("by"))
    at = p.select(F.col("pid"), "lng", "lat", box.alias("_box"))
    plans = {
        "radius": X.within_radius(at, f, 60_000.0),
        "polygons": X.points_in_polygons(at, polygons, 0.5),
        "lines": X.lines_within(at, lines, 50_000.0),
        "counts": counts._summed(
            f.select(F.struct("fid").alias("_shape"), F.lit(0).alias("_level"), X.cell_index(F.col("f_lng"), 0.5).alias("_cx"), X.cell_index(F.col("f_lat"), 0.5).alias("_cy")),
            counts.spot_sums(f, {"n": F.count(F.lit(1))}, []), ["n"], [], "key", 0.5, 0, 0, F.lit(True),
        ),
    }
    for name, df in plans.items():
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_large_shapes_are_cut_a_few_at_a_time():
    """What a task holds while it cuts disks doesn't grow with the batch."""
    n = 3 * counts.SHAPES_A_STEP + 1
    xs = pa.array([float(i) for i in range(n)])
    key = pa.StructArray.from_arrays([xs, xs], ["lng", "lat"])
    reach = pa.array([0.4] * n)
    batch = pa.RecordBatch.from_arrays([key, xs, pa.array([1.0] * n), reach, reach, pa.array([40_000.0] * n)], ["_shape", "lng", "lat", "_dx", "_dy", "_radius"])
    out = list(counts._cut_disks(key.type, "haversine", 0.1, 1)(iter([batch])))
    assert len(out) == 4
    shapes = {s["lng"] for b in out for s in b.column("_shape").to_pylist()}
    assert len(shapes) == n


def test_segments_lie_only_in_the_cells_they_pass(spark):
    """A long diagonal takes cells in proportion to its length, not to its box, and none is missed."""
    rng = random.Random(3)
    segs = [(x, y, x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)) for x, y in ((rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(40))]
    segs += [(0.0, 0.0, 0.0, 3.0), (0.0, 0.0, 3.0, 0.0), (1.0, 1.0, 1.0, 1.0), (-3.0, -3.0, 3.0, 3.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(segs)], "sid long, ax double, ay double, bx double, by double")
    got = {(r.sid, r._cx, r._cy) for r in X.cells_along(df, F.lit(0.1)).select("sid", "_cx", "_cy").collect()}
    for i, (ax, ay, bx, by) in enumerate(segs):
        for t in np.linspace(0, 1, 997):
            assert (i, math.floor((ax + t * (bx - ax)) / 0.1), math.floor((ay + t * (by - ay)) / 0.1)) in got
        assert sum(s == i for s, _, _ in got) <= 4 * (abs(bx - ax) + abs(by - ay)) / 0.1 + 9


def test_line_distance_within_equals_pair_list(spark, world):
    """Keys may repeat; only the nearest within the radius counts."""
    rng = random.Random(11)
    _, _, p, _ = world
    p = p.unionByName(p.limit(20).withColumn("lng", F.col("lng") + 0.7))
    segs = [(rng.uniform(-101, -89), rng.uniform(29, 41)) for _ in range(60)]
    segs = [(x, y, x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)) for x, y in segs]
    s = spark.createDataFrame([(i, *c) for i, c in enumerate(segs)], "sid long, ax double, ay double, bx double, by double")
    want = X.lines_within(p, s, 30_000.0).groupBy("pid").agg(F.min(F.struct("dist", "sid")).alias("b")).select("pid", "b.*")
    got = X.line_distance_within(p, s, "pid", "sid", 30_000.0)
    assert {(r.pid, r.sid, r.dist) for r in got.collect()} == {(r.pid, r.sid, r.dist) for r in want.collect()}


def test_held_by_equals_pair_list_without_listing_it(spark, world):
    """Every aggregate equals that over all pairs, with repeated keys, copies of polygons and none at all."""
    rng = random.Random(5)
    _, _, p, _ = world
    p = p.unionByName(p.limit(20).withColumn("lng", F.col("lng") + 0.7))
    rows = []
    for i in range(60):
        x, y, r = rng.uniform(-100, -90), rng.uniform(30, 40), rng.choice([0.3, 1.0, 9.0])
        ring = [(x - r, y - r), (x + 1.2 * r, y - 0.8 * r), (x + 0.6 * r, y + 1.1 * r), (x - 0.9 * r, y + 0.7 * r), (x - r, y - r)]
        rows += [(i, "ab"[i % 2], [ring])] * (1 + i % 3)
    z = X.with_extent(spark.createDataFrame(rows, "zid long, kind string, rings array<array<struct<x:double,y:double>>>"))
    aggs = {"n": (F.count(F.lit(1)), F.sum), "first": (F.min(F.struct("zid", "kind")), F.min), "a": (F.bool_or(F.col("kind") == "a"), F.bool_or)}
    want = X.points_in_polygons(p, z, 1.0).groupBy("pid").agg(*[c.alias(n) for n, (c, _) in aggs.items()])
    rows_of = lambda df: {(r.pid, r.n, tuple(r.first), r.a) for r in df.select("pid", "n", "first", "a").collect()}
    for usual in (0.5, 4.0):
        assert rows_of(counts.held_by(p, z, "pid", aggs, usual)) == rows_of(want)
    assert counts.held_by(p, z.limit(0), "pid", aggs, 1.0).count() == 0


def test_settled_cells_meet_no_more_polygons(spark, world, monkeypatch):
    """First polygons and flags equal those over all pairs, and twenty times the polygons at a place leave a cell as few to test."""
    rng = random.Random(7)
    _, _, p, _ = world
    p = p.unionByName(p.limit(20).withColumn("lng", F.col("lng") + 0.7))

    def shapes(n):
        rows = []
        for i in range(n):
            x, y, r = rng.uniform(-100, -90), rng.uniform(30, 40), rng.choice([0.3, 1.0, 9.0])
            ring = [(x - r, y - r), (x + 1.2 * r, y - 0.8 * r), (x + 0.6 * r, y + 1.1 * r), (x - 0.9 * r, y + 0.7 * r), (x - r, y - r)]
            rows += [(None if i % 40 == 39 else i, None if i % 5 == 0 else "ab"[i % 2], [ring])] * (1 + i % 3)
        return X.with_extent(spark.createDataFrame(rows, "zid long, kind string, rings array<array<struct<x:double,y:double>>>"))

    for z, usual in ((shapes(30), 2.0), (shapes(200), 0.7)):
        pairs = X.points_in_polygons(p, z, 1.0)
        flags = {"a": F.col("kind") == "a", "c": F.col("kind") == "c", "any": F.lit(True)}
        hits = pairs.groupBy("pid").agg(F.min(F.struct("zid", "kind")).alias("h"), *[F.bool_or(c).alias(n) for n, c in flags.items()])
        first = X.first_polygon(p.select("pid", "lng", "lat"), z, usual, "pid", "zid", ["zid", "kind"])
        want = p.join(hits, "pid", "left").select("pid", "lng", "lat", "h.zid", "h.kind")
        assert sorted(map(str, first.collect())) == sorted(map(str, want.collect()))
        flagged = X.polygon_flags(p.select("pid", "lng", "lat"), z, usual, "pid", flags)
        want = p.join(hits, "pid", "left").select("pid", "lng", "lat", *[F.coalesce(n, F.lit(False)).alias(n) for n in flags])
        assert sorted(map(str, flagged.collect())) == sorted(map(str, want.collect()))

    met, plain = [], counts.meet

    def counted(left, right, on, how="inner"):
        out = plain(left, right, on, how)
        if "_edges" in out.columns and "f_lng" in out.columns:
            met.append(out.count())
        return out

    monkeypatch.setattr(counts, "meet", counted)
    at = spark.range(400).select(F.col("id").alias("pid"), (F.col("id") % 20 / 20.0).alias("lng"), (F.floor(F.col("id") / 20) / 20.0).alias("lat"))
    for n in (20, 400):
        boxes = [(i, x, y, x + 2.0, y + 2.0) for i, x, y in ((i, rng.uniform(-2, 1), rng.uniform(-2, 1)) for i in range(n))]
        z = spark.createDataFrame(boxes, "zid long, x0 double, y0 double, x1 double, y1 double").withColumn("rings", geo.ring([(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]))
        X.first_polygon(at, z, 2.0, "pid", "zid", ["zid"]).collect()
    assert met[1] <= 4 * max(met[0], 400)


def test_first_holders_and_counts_by_kind_equal_pair_list(spark, world):
    rng = random.Random(6)
    _, _, p, _ = world
    p = p.unionByName(p.limit(20).withColumn("lng", F.col("lng") + 0.7))
    rows = []
    for i in range(60):
        x, y, r = rng.uniform(-100, -90), rng.uniform(30, 40), rng.choice([0.3, 1.0, 9.0])
        ring = [(x - r, y - r), (x + 1.2 * r, y - 0.8 * r), (x + 0.6 * r, y + 1.1 * r), (x - 0.9 * r, y + 0.7 * r), (x - r, y - r)]
        rows += [(i, "ab"[i % 2], [ring])] * (1 + i % 3)
    z = X.with_extent(spark.createDataFrame(rows, "zid long, kind string, rings array<array<struct<x:double,y:double>>>"))
    pairs = X.points_in_polygons(p, z, 1.0)
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    want = X.top_k_per_key(pairs, ["pid", "kind"], [F.col("zid")], 2).select("pid", "kind", "zid", "rank")
    assert rows_of(counts.first_holders(p, z, "pid", ["kind"], "zid", 2, 4.0).select("pid", "kind", "zid", "rank")) == rows_of(want)
    n = {"n": (F.count(F.lit(1)), F.sum)}
    assert rows_of(counts.held_by(p, z, "pid", n, 4.0, by=["kind"])) == rows_of(pairs.groupBy("pid", "kind").agg(F.count(F.lit(1)).alias("n")))


def test_largest_within_equals_pair_list_and_reads_few_runs(spark, world):
    """Large values just outside the radius, ties, copies of features, repeated keys, fewer than k."""
    rng = random.Random(9)
    _, feats, p, f = world
    p = p.unionByName(p.limit(20).withColumn("lng", F.col("lng") + 0.7)).unionByName(p.limit(5))
    f = f.unionByName(f.limit(30)).withColumn("v", F.when(F.col("f_lng") > -95.0, 1000.0).otherwise(0.0) + F.col("fid") % 7)
    for radius in (20_000.0, 150_000.0):
        want = X.top_k_per_key(X.within_radius(p, f, radius), ["pid"], [F.desc("v"), F.col("fid")], 3)
        got = X.largest_within(p, f, "pid", radius, "v", "fid", 3)
        rows_of = lambda df: sorted(map(tuple, df.select("pid", "rank", "fid", "v").collect()))
        assert rows_of(got) == rows_of(want)
        assert got.agg(F.max("dist")).first()[0] <= radius
    # A crowd: 3,000 features in reach, of which a point meets some runs only.
    crowd = spark.createDataFrame([(i, -95 + rng.uniform(-1, 1), 35 + rng.uniform(-1, 1), rng.random()) for i in range(3000)], "fid long, f_lng double, f_lat double, v double")
    one = spark.createDataFrame([(1, -95.0, 35.0)], "pid long, lng double, lat double")
    met, keep = [], X.meet
    try:
        X.meet = lambda *a, **k: met.append(keep(*a, **k)) or met[-1]
        X.largest_within(one, crowd, "pid", 150_000.0, "v", "fid", 3)
    finally:
        X.meet = keep
    assert sum(m.count() for m in met) < 500


def test_k_nearest_by_group_equals_pair_list(spark, world):
    _, _, p, f = world
    f = f.withColumn("kind", F.substring(F.lit("abc"), (F.col("fid") % 3 + 1).cast("int"), 1))
    asked = p.unionByName(p.limit(5)).withColumn("kind", F.explode(F.array(*map(F.lit, "abc"))))
    pairs = X.within_radius(p.unionByName(p.limit(5)), f, 150_000.0)
    want = X.top_k_per_key(pairs, ["pid", "kind"], [F.col("dist"), F.col("fid")], 2)
    got = X.k_nearest_within(asked, f, "pid", 150_000.0, "fid", 2, by=["kind"])
    rows_of = lambda df: sorted(map(tuple, df.select("pid", "kind", "rank", "fid").collect()))
    assert rows_of(got) == rows_of(want)


def test_cells_of_a_small_layer_are_dealt_out(spark, world):
    """A nearest search puts features into the cells of many grids, and one task would hold those of a small table."""
    _, _, p, f = world
    plan = X.nearest(p, f, "pid", "fid", [])._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def _near_inputs(spark, seed=5):
    rng = random.Random(seed)
    points = [(i, rng.uniform(-100, -97), rng.uniform(30, 33)) for i in range(120)] + [(3, -98.0, 31.0), (4, -99.0, 32.0), (4, -99.0, 32.0)]
    shapes = []
    for i in range(60):
        x, y, s = rng.uniform(-100, -97), rng.uniform(30, 33), rng.choice([0.002, 0.05, 0.6, 1.4])
        shapes.append((i % 57, i % 7, "ab"[i % 2], [[(x, y), (x + s, y + s / 3), (x + s / 2, y + s), (x, y)]]))
    shapes.append(shapes[5])
    p = spark.createDataFrame(points, "pid long, lng double, lat double")
    z = spark.createDataFrame(shapes, "zid long, yr long, src string, rings array<array<struct<x:double,y:double>>>")
    return p, z.withColumns(geo.ring_extent("rings"))


@pytest.mark.parametrize("radius", [800.0, 30_000.0])
def test_near_boundaries_are_aggregated_as_pairs_would_be(spark, radius, monkeypatch):
    """Counts, first polygons and holders against the list of pairs, with repeated points and polygons."""
    p, z = _near_inputs(spark)
    pairs = overlap.boundary_distances(p, z, "pid", "zid", ["yr", "src"], radius, 0.8).cache()
    want = {(r.pid, r.src): (r.n, round(r.d, 6)) for r in pairs.groupBy("pid", "src").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("d")).collect()}
    got = overlap.boundary_counts(p, z, "pid", "zid", "src", radius, 0.8).collect()
    assert {(r.pid, r.src): (r.n, round(r.nearest_m, 6)) for r in got} == want and len(got) == len(want)
    for order in ([F.col("dist"), F.col("zid")], [F.desc("yr"), F.col("zid")]):
        listed = lambda df: sorted((r.pid, r["rank"], r.zid, r.yr, r.contains_point, round(r.dist, 6)) for r in df.collect())
        assert listed(overlap.first_boundaries(p, z, "pid", "zid", ["yr"], order, radius, 3, 0.8)) == listed(X.top_k_per_key(pairs, ["pid"], order, 3))
    best = pairs.groupBy("pid").agg(F.min(F.struct(~F.col("contains_point"), "dist", "zid", "yr", "contains_point")).alias("b"))
    own = overlap.holder_or_nearest(p, z, "pid", "zid", ["yr"], radius, 0.8)
    assert sorted((r.pid, r.zid, r.yr, r.contains_point) for r in own.collect()) == sorted((r.pid, r.b.zid, r.b.yr, r.b.contains_point) for r in best.collect())
    # Where no key repeats, no pairs are listed.
    monkeypatch.setattr(overlap, "boundary_distances", lambda *a: pytest.fail("lists pairs"))
    overlap.boundary_counts(p.dropDuplicates(["pid"]), z.dropDuplicates(["zid"]), "pid", "zid", "src", radius, 0.8).collect()


@pytest.mark.parametrize("radius", [2_000.0, 50_000.0])
def test_segments_near_counts_without_pairs(spark, radius):
    rng = random.Random(8)
    p = spark.createDataFrame([(i, rng.uniform(-100, -97), rng.uniform(58, 61)) for i in range(150)], "pid long, lng double, lat double")
    rows = []
    for i in range(80):
        x, y, s = rng.uniform(-100, -97), rng.uniform(58, 61), rng.choice([0.0, 0.01, 0.4, 6.0])
        rows.append(("ab"[i % 2], x, y, x + rng.uniform(-s, s), y + rng.choice([0.0, rng.uniform(-s, s)])))
    s = spark.createDataFrame([*rows, ("a", None, 59.0, -98.0, 59.0)], "src string, ax double, ay double, bx double, by double")
    at = p.crossJoin(s).withColumn("d", geo.segment_distance_m("lng", "lat", "ax", "ay", "bx", "by")).filter(F.col("d") <= radius)
    want = {(r.pid, r.src): r["count"] for r in at.groupBy("pid", "src").count().collect()}
    assert {(r.pid, r.src): r.n for r in counts.segments_near(p, s, "pid", radius, ["src"]).collect()} == want
    listed = {(r.pid, r.src): r["count"] for r in X.lines_within(p, s, radius).groupBy("pid", "src").count().collect()}
    assert listed == want


def test_lines_within_takes_cells_along_a_segment(spark):
    """A diagonal takes the cells near it, not those of its box."""
    s = spark.createDataFrame([(-100.0, 30.0, -97.0, 33.0)], "ax double, ay double, bx double, by double")
    assert X.cells_along(s, F.lit(0.03), F.lit(0.01), F.lit(0.01)).count() < 100 * 100 / 10


def test_union_cover_meets_cells_not_features(spark, monkeypatch):
    """Parcels meet the united features of a cell, however many lie over them; repeated parcels and features count once."""
    rng = random.Random(3)
    rows = [(("a", "b", None)[i % 3], x, y, x + rng.uniform(0.1, 2.0), y + rng.uniform(0.1, 2.0)) for i in range(90) for x, y in [(rng.uniform(0, 8), rng.uniform(0, 8))]]
    boxes = spark.createDataFrame([*rows, rows[0]], "kind string, x0 double, y0 double, x1 double, y1 double")
    own = [(1, 0.3, 0.2, 7.7, 8.1), (2, 2.01, 2.02, 2.03, 2.05), (3, -9.0, -9.0, -8.0, -8.0), (4, -1.0, 3.0, 12.0, 3.5), (4, -1.0, 3.0, 12.0, 3.5), (5, 1.0, 1.0, 1.0, 1.0)]
    parcels = spark.createDataFrame(own, "loc_id long, x0 double, y0 double, x1 double, y1 double")
    with_rings = lambda df: df.withColumn("rings", geo.box_rings("x0", "y0", "x1", "y1"))
    monkeypatch.setattr(X, "boxes_meeting", lambda *a: pytest.fail("lists pairs"))
    got = {(r.loc_id, r.kind): r.area_deg2 for r in overlap.union_cover(with_rings(parcels), with_rings(boxes), "loc_id", "kind", 1.2).collect()}
    want = {}
    for k, w, s, e, n in own:
        for kind in "ab":
            clipped = [(max(w, x0), max(s, y0), min(e, x1), min(n, y1)) for name, x0, y0, x1, y1 in rows if name == kind]
            clipped = [c for c in clipped if c[0] < c[2] and c[1] < c[3]]
            xs, ys = sorted({v for c in clipped for v in c[::2]}), sorted({v for c in clipped for v in c[1::2]})
            area = sum((x1 - x0) * (y1 - y0) for x0, x1 in zip(xs, xs[1:]) for y0, y1 in zip(ys, ys[1:]) if any(c[0] <= x0 and x1 <= c[2] and c[1] <= y0 and y1 <= c[3] for c in clipped))
            if area > 0:
                want[k, kind] = area
    assert got == pytest.approx(want, rel=1e-9)
