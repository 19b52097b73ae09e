import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import raster as G


@pytest.fixture(scope="module")
def dem():
    rng = np.random.default_rng(5)
    z = rng.normal(100, 20, (23, 31))
    z[4, 7] = np.nan
    return z


def cells(spark, z):
    rows = [(int(r), int(c), None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "row long, col long, v double")


@pytest.mark.parametrize("tile", [8, 256])
def test_slope_equals_numpy_gradient(spark, dem, tile):
    got = {(r.row, r.col): r.slope_deg for r in G.slope_aspect(cells(spark, dem), "v", 30.0, 30.0, tile).collect()}
    gy, gx = np.gradient(dem, 30.0, 30.0)
    want = np.degrees(np.arctan(np.hypot(gx, gy)))
    want[np.isnan(dem)] = np.nan
    for (r, c), s in got.items():
        assert (s is None) == bool(np.isnan(want[r, c]))
        if s is not None:
            assert s == pytest.approx(want[r, c])
    assert len(got) == dem.size


def test_aspect_faces_downhill(spark):
    south_facing = np.add.outer(np.arange(5)[::-1] * 3.0, np.zeros(5))
    rows = G.slope_aspect(cells(spark, south_facing), "v", 30.0, 30.0).collect()
    assert all(r.aspect_deg == pytest.approx(180.0) for r in rows)
    flat = G.slope_aspect(cells(spark, np.ones((4, 4))), "v", 30.0, 30.0).collect()
    assert all(r.aspect_deg is None and r.slope_deg == 0.0 for r in flat)


@pytest.mark.parametrize("tile", [8, 64])
def test_focal_mean_ignores_missing(spark, dem, tile):
    got = {(r.row, r.col): r.m for r in G.focal_means(cells(spark, dem), "v", {"m": 3.0}, tile).collect()}
    for r, c in ((0, 0), (4, 6), (10, 15), (22, 30)):
        vals = [dem[y, x] for y in range(23) for x in range(31) if (y - r) ** 2 + (x - c) ** 2 <= 9 and not np.isnan(dem[y, x])]
        assert got[(r, c)] == pytest.approx(np.mean(vals))
    assert got[(4, 7)] is None


@pytest.mark.parametrize("margin,tile", [(64, 256), (3, 8)])
def test_distance_equals_brute_force(spark, margin, tile):
    rng = np.random.default_rng(2)
    burn = rng.random((20, 40)) < 0.02
    burn[0, 0] = True
    rows = [(r, c, int(burn[r, c])) for r in range(20) for c in range(40)]
    df = spark.createDataFrame(rows, "row long, col long, b int")
    targets = np.argwhere(burn)
    for r in G.distance_to(df, F.col("b") == 1, 30.0, margin, tile).collect():
        want = np.sqrt(((targets - [r.row, r.col]) ** 2).sum(1)).min() * 30
        assert r.distance_m == pytest.approx(want)


def test_sampling_and_bilinear(spark):
    src = spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0), (1, 0, 30.0), (1, 1, -9999.0)], "row long, col long, v double")
    pts = spark.createDataFrame([(1, 0.5, 1.5), (2, 1.0, 1.0), (3, 5.0, 5.0), (4, 1.5, 0.5)], "k int, lng double, lat double")
    aff = {"x0": 0.0, "y0": 2.0, "px": 1.0, "py": 1.0}
    near = {r.k: r.v for r in G.sample(pts, src, ["v"], -9999.0, **aff).collect()}
    assert near == {1: 10.0, 2: None, 3: None, 4: None}
    mix = {r.k: r.v for r in G.resample_bilinear(pts, ["k"], src, "v", -9999.0, **aff).collect()}
    assert mix[1] == 10.0 and mix[2] == pytest.approx(20.0) and mix[3] is None


def test_rasters_are_never_broadcast(spark, folder):
    """A raster's file is a small part of its rows, so the driver would collect it."""
    from parcelwise.session import TABLE_CONF, tune

    spark.range(200_000).selectExpr("id DIV 1000 AS row", "id % 1000 AS col", "CAST(id % 7 AS DOUBLE) AS v").write.parquet(f"{folder}/r")
    pts = spark.createDataFrame([(1, 3.5, -2.5)], "pid long, lng double, lat double")
    read = G.sample(pts, spark.read.parquet(f"{folder}/r"), ["v"], -1.0, x0=0.0, y0=0.0, px=1.0, py=1.0)
    assert read.collect()[0].v == 2003 % 7
    assert "Broadcast" not in read._jdf.queryExecution().executedPlan().toString()
    size = lambda: int(str(spark.read.parquet(f"{folder}/r")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    before = size()
    try:
        tune(spark, TABLE_CONF)
        assert size() > 5 * before
    finally:
        spark.conf.unset("spark.sql.sources.fileCompressionFactor")
