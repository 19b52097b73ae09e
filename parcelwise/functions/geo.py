"""Geodesic and planar column functions.

Points are ``lng``/``lat`` doubles in degrees. Polygons are
``ARRAY<ARRAY<STRUCT<x, y>>>`` of closed rings read with the even-odd rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    EARTH_RADIUS_M,
    METRES_PER_DEGREE,
    MIN_COS_LAT,
    SQUARE_METRES_PER_ACRE,
    WEB_MERCATOR_RADIUS_M,
)

ColumnLike = Column | str | float
RING_TYPE = "array<array<struct<x:double,y:double>>>"
SPHERE_M_PER_DEG = math.pi / 180.0 * EARTH_RADIUS_M


def col(value: ColumnLike) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


# ── distances ───────────────────────────────────────────────────────────────
def haversine_m(lng1: ColumnLike, lat1: ColumnLike, lng2: ColumnLike, lat2: ColumnLike) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    sin_lat = F.sin((p2 - p1) / 2.0)
    sin_lng = F.sin(F.radians(col(lng2) - col(lng1)) / 2.0)
    a = sin_lat * sin_lat + F.cos(p1) * F.cos(p2) * sin_lng * sin_lng
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def degree_distance(lng1: ColumnLike, lat1: ColumnLike, lng2: ColumnLike, lat2: ColumnLike) -> Column:
    dx, dy = col(lng1) - col(lng2), col(lat1) - col(lat2)
    return F.sqrt(dx * dx + dy * dy)


def flat_m(lng1: ColumnLike, lat1: ColumnLike, lng2: ColumnLike, lat2: ColumnLike) -> Column:
    return degree_distance(lng1, lat1, lng2, lat2) * METRES_PER_DEGREE


def mercator_x(lng: ColumnLike) -> Column:
    return F.radians(col(lng)) * WEB_MERCATOR_RADIUS_M


def mercator_y(lat: ColumnLike) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2.0)) * WEB_MERCATOR_RADIUS_M


def mercator_m(lng1: ColumnLike, lat1: ColumnLike, lng2: ColumnLike, lat2: ColumnLike) -> Column:
    dx = mercator_x(lng1) - mercator_x(lng2)
    dy = mercator_y(lat1) - mercator_y(lat2)
    return F.sqrt(dx * dx + dy * dy)


def _reach_haversine(radius: Column, lat: Column) -> tuple[Column, Column]:
    dy = radius / SPHERE_M_PER_DEG * (1 + 1e-9)
    edge = F.least(F.abs(lat) + dy, F.lit(89.0))
    return dy / F.cos(F.radians(edge)), dy


def _reach_degree(radius: Column, lat: Column) -> tuple[Column, Column]:
    return radius * 1.0, radius * 1.0


def _reach_mercator(radius: Column, lat: Column) -> tuple[Column, Column]:
    d = F.degrees(radius / WEB_MERCATOR_RADIUS_M) * (1 + 1e-9)
    return d, d


def _reach_flat(radius: Column, lat: Column) -> tuple[Column, Column]:
    d = radius / METRES_PER_DEGREE
    return d, d


@dataclass(frozen=True)
class Metric:
    """A distance and the half-width of the box that holds its disk, in degrees."""

    name: str
    distance: Callable[..., Column]
    reach: Callable[[Column, Column], tuple[Column, Column]]
    degrees_per_unit: float

    def typical_reach(self, radius: float) -> float:
        return radius * self.degrees_per_unit


HAVERSINE = Metric("haversine", haversine_m, _reach_haversine, 1.0 / SPHERE_M_PER_DEG)
DEGREE = Metric("degree", degree_distance, _reach_degree, 1.0)
MERCATOR = Metric("mercator", mercator_m, _reach_mercator, math.degrees(1.0 / WEB_MERCATOR_RADIUS_M))
FLAT = Metric("flat", flat_m, _reach_flat, 1.0 / METRES_PER_DEGREE)


def metres_per_lng_degree(lat: ColumnLike) -> Column:
    return F.cos(F.radians(col(lat))) * SPHERE_M_PER_DEG


def segment_distance_m(
    lng: ColumnLike, lat: ColumnLike, ax: ColumnLike, ay: ColumnLike, bx: ColumnLike, by: ColumnLike, kx: ColumnLike | None = None
) -> Column:
    """Point to segment, in equirectangular metres at the point's latitude.

    ``kx`` is metres per degree of longitude when the caller has it per point.
    """
    kx = metres_per_lng_degree(lat) if kx is None else col(kx)
    px, py = (col(ax) - col(lng)) * kx, (col(ay) - col(lat)) * SPHERE_M_PER_DEG
    dx, dy = (col(bx) - col(ax)) * kx, (col(by) - col(ay)) * SPHERE_M_PER_DEG
    length2 = dx * dx + dy * dy
    along = F.when(length2 > 0, -(px * dx + py * dy) / F.nullif(length2, F.lit(0.0))).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = px + t * dx, py + t * dy
    return F.sqrt(ex * ex + ey * ey)


# ── rings ───────────────────────────────────────────────────────────────────
def point(x: ColumnLike, y: ColumnLike) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def ring(corners: list[tuple[ColumnLike, ColumnLike]]) -> Column:
    """Closed single-ring polygon from its corners in order."""
    return F.array(F.array(*[point(x, y) for x, y in corners + corners[:1]]))


def box_rings(x0: ColumnLike, y0: ColumnLike, x1: ColumnLike, y1: ColumnLike) -> Column:
    return ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def circle_rings(lng: ColumnLike, lat: ColumnLike, radius_m: ColumnLike, segments: int = 48) -> Column:
    """Circle polygon: vertex k sits at angle 2πk/n from north."""
    lng, lat, r = col(lng), col(lat), col(radius_m)
    kx = F.greatest(F.cos(F.radians(lat)), F.lit(MIN_COS_LAT)) * METRES_PER_DEGREE
    turn = 2.0 * math.pi / segments

    def vertex(k: Column) -> Column:
        angle = (k % segments) * turn
        return point(lng + r * F.sin(angle) / kx, lat + r * F.cos(angle) / METRES_PER_DEGREE)

    return F.array(F.transform(F.sequence(F.lit(0), F.lit(segments)), vertex))


def ring_extent(rings: ColumnLike) -> dict[str, Column]:
    """Bounding box columns ``x0, y0, x1, y1`` of a polygon column."""
    flat = F.flatten(col(rings))
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return {
        "x0": F.array_min(xs),
        "y0": F.array_min(ys),
        "x1": F.array_max(xs),
        "y1": F.array_max(ys),
    }


def _crossings(one_ring: Column, x: Column, y: Column) -> Column:
    def crosses(i: Column) -> Column:
        a, b = one_ring[i - 1], one_ring[i]
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return spans & (x < at)

    return F.size(F.filter(F.sequence(F.lit(1), F.size(one_ring) - 1), crosses))


def contains(rings: ColumnLike, lng: ColumnLike, lat: ColumnLike) -> Column:
    """Even-odd ray casting with half-open edges."""
    x, y = col(lng), col(lat)
    total = F.aggregate(col(rings), F.lit(0), lambda n, r: n + _crossings(r, x, y))
    return total % 2 == 1


def ring_edges(rings: ColumnLike) -> Column:
    """All edges of a polygon as ``ARRAY<STRUCT<ax, ay, bx, by>>``."""

    def edges(r: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(r) - 1),
            lambda i: F.struct(
                r[i - 1]["x"].alias("ax"),
                r[i - 1]["y"].alias("ay"),
                r[i]["x"].alias("bx"),
                r[i]["y"].alias("by"),
            ),
        )

    return F.flatten(F.transform(col(rings), edges))


# Slack against rounding of the cell bounds; it only keeps extra edges.
_EDGE_SLACK = 1e-9


def edges_in_band(edges: ColumnLike, y_lo: Column, y_hi: Column) -> Column:
    """Edges that reach into a latitude band."""
    return F.filter(
        col(edges),
        lambda e: (F.greatest(e["ay"], e["by"]) >= y_lo - _EDGE_SLACK) & (F.least(e["ay"], e["by"]) <= y_hi + _EDGE_SLACK),
    )


def edges_east_of(edges: ColumnLike, x_lo: Column) -> Column:
    """Edges that a rightward ray starting at or after ``x_lo`` can meet."""
    return F.filter(col(edges), lambda e: F.greatest(e["ax"], e["bx"]) >= x_lo - _EDGE_SLACK)


def odd_crossings(edges: ColumnLike, lng: ColumnLike, lat: ColumnLike) -> Column:
    """Even-odd containment from an edge list; half-open edges."""
    x, y = col(lng), col(lat)

    def crosses(e: Column) -> Column:
        at = (e["bx"] - e["ax"]) * F.try_divide(y - e["ay"], e["by"] - e["ay"]) + e["ax"]
        return ((e["ay"] > y) != (e["by"] > y)) & (x < at)

    return F.size(F.filter(col(edges), crosses)) % 2 == 1


def ring_area_deg2(r: Column) -> Column:
    """Signed area of a closed ring, positive when it runs counter-clockwise.

    Corners are taken relative to the first one to keep small areas exact.
    """
    twice = F.aggregate(
        F.sequence(F.lit(1), F.size(r) - 1),
        F.lit(0.0),
        lambda s, i: s
        + (r[i - 1]["x"] - r[0]["x"]) * (r[i]["y"] - r[0]["y"])
        - (r[i]["x"] - r[0]["x"]) * (r[i - 1]["y"] - r[0]["y"]),
    )
    return twice / 2.0


def oriented(rings: ColumnLike) -> Column:
    """Rings of one polygon with the shell counter-clockwise and holes clockwise."""
    return F.transform(col(rings), lambda r, i: F.when((F.size(r) > 1) & ((ring_area_deg2(r) > 0) != (i == 0)), F.reverse(r)).otherwise(r))


def polygon_area_deg2(rings: ColumnLike) -> Column:
    """Area in squared degrees; holes run opposite to their shell."""
    return F.abs(F.aggregate(col(rings), F.lit(0.0), lambda s, r: s + ring_area_deg2(r)))


def deg2_to_m2(lat: ColumnLike) -> Column:
    return F.lit(METRES_PER_DEGREE**2) * F.cos(F.radians(col(lat)))


def deg2_to_acres(area: ColumnLike, lat: ColumnLike) -> Column:
    return col(area) * deg2_to_m2(lat) / SQUARE_METRES_PER_ACRE


# ── parcels and lattices ────────────────────────────────────────────────────
def parcel_side_m(acres: ColumnLike) -> Column:
    return F.sqrt(col(acres) * SQUARE_METRES_PER_ACRE)


def parcel_half_width(side_m: ColumnLike, lat: ColumnLike) -> tuple[Column, Column]:
    """Half width in degrees of a square of this side: (longitude, latitude)."""
    kx = F.greatest(F.cos(F.radians(col(lat))), F.lit(MIN_COS_LAT)) * METRES_PER_DEGREE
    return col(side_m) / kx / 2.0, col(side_m) / METRES_PER_DEGREE / 2.0


def parcel_rings(lng: ColumnLike, lat: ColumnLike, acres: ColumnLike) -> Column:
    hx, hy = parcel_half_width(parcel_side_m(acres), lat)
    return box_rings(col(lng) - hx, col(lat) - hy, col(lng) + hx, col(lat) + hy)


def lattice(lng: ColumnLike, lat: ColumnLike, side_m: ColumnLike, n: int) -> Column:
    """n×n points over a square; row 0 is south, column 0 is west."""
    hx, hy = parcel_half_width(side_m, lat)
    west, south = col(lng) - hx, col(lat) - hy
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    return F.flatten(
        F.transform(
            axis,
            lambda i: F.transform(
                axis,
                lambda j: F.struct(
                    i.alias("i"),
                    j.alias("j"),
                    (west + hx * 2.0 * j / (n - 1)).alias("lng"),
                    (south + hy * 2.0 * i / (n - 1)).alias("lat"),
                ),
            ),
        )
    )


# ── equal-area conic (California Albers, GRS80) ─────────────────────────────
# fixed values: projection parameters
_A = 6_378_137.0
_F = 1.0 / 298.257222101
_PHI1, _PHI2, _PHI0, _LAM0 = 34.0, 40.5, 0.0, -120.0
_FALSE_NORTHING = -4_000_000.0
_E2 = _F * (2.0 - _F)
_E = math.sqrt(_E2)


def _q_const(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (
        s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E)
    )


def _m_const(phi: float) -> float:
    s = math.sin(phi)
    return math.cos(phi) / math.sqrt(1 - _E2 * s * s)


_M1, _M2 = _m_const(math.radians(_PHI1)), _m_const(math.radians(_PHI2))
_Q0, _Q1, _Q2 = (_q_const(math.radians(p)) for p in (_PHI0, _PHI1, _PHI2))
_N = (_M1**2 - _M2**2) / (_Q2 - _Q1)
_C = _M1**2 + _N * _Q1
_RHO0 = _A * math.sqrt(_C - _N * _Q0) / _N


def albers_xy(lng: ColumnLike, lat: ColumnLike) -> tuple[Column, Column]:
    s = F.sin(F.radians(col(lat)))
    q = (s / (1 - s * s * _E2) - F.log((1 - s * _E) / (1 + s * _E)) / (2 * _E)) * (1 - _E2)
    rho = F.sqrt(F.lit(_C) - q * _N) * (_A / _N)
    theta = F.radians(col(lng) - _LAM0) * _N
    return rho * F.sin(theta), F.lit(_RHO0) - rho * F.cos(theta) + _FALSE_NORTHING


def albers_lng_lat(x: ColumnLike, y: ColumnLike) -> tuple[Column, Column]:
    """Inverse, by the authalic-latitude series (better than 1e-9 degrees)."""
    dx, dy = col(x), F.lit(_RHO0) - (col(y) - _FALSE_NORTHING)
    rho = F.sqrt(dx * dx + dy * dy)
    q = (F.lit(_C) - (rho * _N / _A) * (rho * _N / _A)) / _N
    qp = _q_const(math.pi / 2)
    beta = F.asin(q / qp)
    e4, e6 = _E2**2, _E2**3
    phi = (
        beta
        + F.sin(beta * 2) * (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040)
        + F.sin(beta * 4) * (23 * e4 / 360 + 251 * e6 / 3780)
        + F.sin(beta * 6) * (761 * e6 / 45360)
    )
    return F.degrees(F.atan2(dx, dy) / _N) + _LAM0, F.degrees(phi)
