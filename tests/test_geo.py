import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelwise.functions import geo

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_haversine_quarter_meridian(spark):
    r = one(spark, d=geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert r.d == pytest.approx(math.pi / 2 * 6_371_000.0, rel=1e-12)


def test_mercator_stretches_by_latitude(spark):
    r = one(
        spark,
        m=geo.mercator_m(F.lit(-100.0), F.lit(40.0), F.lit(-99.999), F.lit(40.0)),
        h=geo.haversine_m(F.lit(-100.0), F.lit(40.0), F.lit(-99.999), F.lit(40.0)),
    )
    assert r.m / r.h == pytest.approx(1 / math.cos(math.radians(40)), rel=2e-3)


def test_albers_round_trip_and_origin(spark):
    x, y = geo.albers_xy(F.lit(-119.05), F.lit(35.35))
    lng, lat = geo.albers_lng_lat(x, y)
    ox, oy = geo.albers_xy(F.lit(-120.0), F.lit(0.0))
    r = one(spark, x=x, y=y, lng=lng, lat=lat, ox=ox, oy=oy)
    assert (r.lng, r.lat) == (pytest.approx(-119.05, abs=1e-9), pytest.approx(35.35, abs=1e-8))
    assert (r.ox, r.oy) == (pytest.approx(0.0, abs=1e-6), pytest.approx(-4_000_000.0, abs=1e-6))


def test_albers_keeps_area(spark):
    corners = [geo.albers_xy(F.lit(a), F.lit(b)) for a, b in ((-120.0, 36.0), (-119.99, 36.0), (-119.99, 36.01), (-120.0, 36.01))]
    r = one(spark, **{f"c{i}{k}": v for i, c in enumerate(corners) for k, v in zip("xy", c)})
    pts = [(r[f"c{i}x"], r[f"c{i}y"]) for i in range(4)]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))) / 2
    # Ellipsoidal cell area at 36° within a tenth of a percent.
    assert area == pytest.approx(900.9 * 1109.7, rel=2e-3)


def test_hole_is_outside(spark):
    shell = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(4, 4), (4, 6), (6, 6), (6, 4), (4, 4)]
    rings = F.array(*[F.array(*[geo.point(float(x), float(y)) for x, y in r]) for r in (shell, hole)])
    r = one(spark, a=geo.contains(rings, F.lit(5.0), F.lit(5.0)), b=geo.contains(rings, F.lit(1.0), F.lit(1.0)), area=geo.polygon_area_deg2(rings))
    assert (r.a, r.b, r.area) == (False, True, 96.0)


def test_circle_is_closed_and_round(spark):
    r = one(spark, c=geo.circle_rings(F.lit(-97.0), F.lit(33.0), F.lit(3000.0))).c[0]
    assert len(r) == 49 and (r[0].x, r[0].y) == (r[48].x, r[48].y)
    for p in r:
        dx = (p.x + 97.0) * 111_320.0 * math.cos(math.radians(33.0))
        assert math.hypot(dx, (p.y - 33.0) * 111_320.0) == pytest.approx(3000.0, rel=1e-9)


def test_lattice_runs_south_to_north(spark):
    pts = one(spark, p=geo.lattice(F.lit(-97.0), F.lit(33.0), F.lit(200.0), 3)).p
    assert len(pts) == 9 and pts[0].lat < pts[8].lat and pts[0].lng < pts[2].lng
    assert (pts[4].lng, pts[4].lat) == (pytest.approx(-97.0), pytest.approx(33.0))


@quick
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-1, 1)), min_size=3, max_size=7), st.floats(-1, 1), st.floats(-1, 1))
def test_contains_matches_crossings(spark, corners, x, y):
    def python(px, py):
        inside = False
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            if (ay > py) != (by > py) and px < (bx - ax) * ((py - ay) / (by - ay)) + ax:
                inside = not inside
        return inside

    rings = geo.ring([(float(a), float(b)) for a, b in corners])
    r = one(spark, c=geo.contains(rings, F.lit(x), F.lit(y)), e=geo.odd_crossings(geo.ring_edges(rings), F.lit(x), F.lit(y)))
    assert r.c == r.e == python(x, y)


def test_segment_distance(spark):
    r = one(
        spark,
        mid=geo.segment_distance_m(F.lit(0.5), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)),
        end=geo.segment_distance_m(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)),
        point=geo.segment_distance_m(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)),
    )
    degree = math.pi / 180 * 6_371_000.0
    assert r.mid == pytest.approx(degree) and r.end == pytest.approx(degree) and r.point == pytest.approx(degree)
