"""Vectorised polygon overlap used inside Arrow batches.

A polygon is the signed sum of the regions below its edges, so the common part of
two polygons is the signed sum, over pairs of their edges, of the region below
both. Each term has a closed form; nothing is clipped, padded or triangulated, and
only edges that share a stretch of longitude meet. Holes run opposite to their
shell.

Registered for pickling by value, so executors need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import segment_distance

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs of edges held at once.
PAIRS = 1 << 20


def ring_points(rings: pa.Array):
    """(rings per row, points per ring, xs, ys) of a polygon column."""
    inner = rings.flatten()
    points = inner.flatten()
    xs = points.field("x").to_numpy(zero_copy_only=False)
    ys = points.field("y").to_numpy(zero_copy_only=False)
    per_row = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    per_ring = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
    return per_row.astype(np.int64), per_ring.astype(np.int64), xs, ys


def ring_edges(rings: pa.Array):
    """(row, ax, ay, bx, by) of every edge; rows ascend."""
    per_row, per_ring, xs, ys = ring_points(rings)
    ring_of = np.repeat(np.arange(len(per_ring)), per_ring)
    row_of = np.repeat(np.arange(len(per_row)), per_row)[ring_of]
    start = np.flatnonzero(ring_of[1:] == ring_of[:-1]) if len(ring_of) else np.empty(0, np.int64)
    return row_of[start], xs[start], ys[start], xs[start + 1], ys[start + 1]


def edge_lists(edges: pa.Array):
    """The same of a column of edge lists."""
    size = pc.fill_null(pc.list_value_length(edges), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = edges.flatten()
    return np.repeat(np.arange(len(edges)), size), *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by"))


def _pairs(row_a: np.ndarray, row_b: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of edges of the same row, a bounded number at a time."""
    first = np.searchsorted(row_b, np.arange(rows + 1))
    count = (first[1:] - first[:-1])[row_a]
    total = np.concatenate(([0], np.cumsum(count)))
    at = 0
    while at < len(row_a):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        a = np.repeat(np.arange(at, stop), count[at:stop])
        yield a, first[row_a[a]] + np.arange(len(a)) - (total[a] - total[at])
        at = stop


def _low_corner(rows: int, edges) -> tuple[np.ndarray, np.ndarray]:
    row, ax, ay, _, _ = edges
    x, y = np.full(rows, np.inf), np.full(rows, np.inf)
    np.minimum.at(x, row, ax)
    np.minimum.at(y, row, ay)
    return x, y


def common_moments(a: pa.Array, b: pa.Array):
    """Per row the area of a ∩ b and its first moments about the lower left corner of the common box, and that corner.

    A polygon is given by rings, or by a list of the edges that reach into the other's longitudes."""
    rows = len(a)
    sides = [edge_lists(p) if pa.types.is_struct(p.type.value_type) else ring_edges(p) for p in (a, b)]
    corners = [_low_corner(rows, s) for s in sides]
    x0, y0 = (np.nan_to_num(np.maximum(corners[0][k], corners[1][k]), posinf=0.0) for k in (0, 1))
    flat = []
    for row, ax, ay, bx, by in sides:
        use = np.flatnonzero(ax != bx)
        row = row[use]
        ax, bx, ay, by = ax[use] - x0[row], bx[use] - x0[row], ay[use] - y0[row], by[use] - y0[row]
        sign = np.where(bx < ax, 1.0, -1.0)
        left = bx < ax
        flat.append((row, np.where(left, bx, ax), np.where(left, by, ay), np.where(left, ax, bx), np.where(left, ay, by), sign))
    (row_a, ax0, ay0, ax1, ay1, sa), (row_b, bx0, by0, bx1, by1, sb) = flat
    slope_a, slope_b = (ay1 - ay0) / (ax1 - ax0), (by1 - by0) / (bx1 - bx0)
    out, size = np.zeros((3, rows)), np.zeros(rows)
    for i, j in _pairs(row_a, row_b, rows):
        left, right = np.maximum(ax0[i], bx0[j]), np.minimum(ax1[i], bx1[j])
        meet = left < right
        i, j, left, right = i[meet], j[meet], left[meet], right[meet]
        a_left, a_right = ay0[i] + slope_a[i] * (left - ax0[i]), ay0[i] + slope_a[i] * (right - ax0[i])
        b_left, b_right = by0[j] + slope_b[j] * (left - bx0[j]), by0[j] + slope_b[j] * (right - bx0[j])
        d_left, d_right = a_left - b_left, a_right - b_right
        crossing = d_left * d_right < 0
        t = np.divide(d_left, d_left - d_right, out=np.zeros_like(left), where=crossing)
        middle = left + t * (right - left)
        at_middle = np.where(crossing, a_left + t * (a_right - a_left), np.minimum(a_left, b_left))
        sign = sa[i] * sb[j]
        for xa, xb, ya, yb in ((left, middle, np.minimum(a_left, b_left), at_middle), (middle, right, at_middle, np.minimum(a_right, b_right))):
            w = sign * (xb - xa)
            for k, value in enumerate((w * (ya + yb) / 2.0, w * (xa * (2 * ya + yb) + xb * (ya + 2 * yb)) / 6.0, w * (ya * ya + ya * yb + yb * yb) / 6.0)):
                out[k] += np.bincount(row_a[i], value, rows)
            size += np.bincount(row_a[i], np.abs(w * (ya + yb)), rows)
    # What rounding leaves of terms that cancel is no area.
    out[:, np.abs(out[0]) <= 1e-13 * size] = 0.0
    # Both shells counter-clockwise, or both clockwise, give a positive sum.
    turn = np.where(out[0] < 0, -1.0, 1.0)
    return out[0] * turn, out[1] * turn, out[2] * turn, x0, y0


def overlap_areas(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area of a ∩ b per row."""
    return pa.array(common_moments(a, b)[0])


def _inside(row_p: np.ndarray, px: np.ndarray, py: np.ndarray, edges, rows: int) -> np.ndarray:
    """Even-odd test of one point per listed row against the edges of that row."""
    row, ax, ay, bx, by = edges
    odd = np.zeros(len(row_p), bool)
    for i, j in _pairs(row_p, row, rows):
        spans = (ay[j] > py[i]) != (by[j] > py[i])
        i, j = i[spans], j[spans]
        east = px[i] < (bx[j] - ax[j]) * ((py[i] - ay[j]) / (by[j] - ay[j])) + ax[j]
        odd ^= np.bincount(i[east], minlength=len(row_p)) % 2 == 1
    return odd


def shares_point(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two polygons have at least a point in common, boundaries included."""
    rows = len(a)
    ea, eb = ring_edges(a), ring_edges(b)
    found = np.zeros(rows, bool)
    for i, j in _pairs(ea[0], eb[0], rows):
        (ax, ay, bx, by), (cx, cy, dx, dy) = (tuple(c[i] for c in ea[1:]), tuple(c[j] for c in eb[1:]))
        near = (np.minimum(ax, bx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(ax, bx))
        near &= (np.minimum(ay, by) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(ay, by))
        side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
        cross = (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) <= 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) <= 0)
        found[ea[0][i[near & cross]]] = True
    # Without a crossing, one polygon may still hold the other, ring by ring.
    for own, other in ((a, eb), (b, ea)):
        per_row, per_ring, xs, ys = ring_points(own)
        some = np.flatnonzero(per_ring > 0)
        start = (np.cumsum(per_ring) - per_ring)[some]
        row = np.repeat(np.arange(rows), per_row)[some]
        held = _inside(row, xs[start], ys[start], other, rows)
        found[row[held]] = True
    return pa.array(found)


def common_parts(a: pa.Array, b: pa.Array) -> pa.Array:
    """Per row: area and centroid of a ∩ b, and whether they share a point; the centroid is null without an area."""
    area, mx, my, x0, y0 = common_moments(a, b)
    meets = area > 0
    rest = np.flatnonzero(~meets)
    if len(rest):
        meets[rest] = shares_point(a.take(pa.array(rest)), b.take(pa.array(rest))).to_numpy(zero_copy_only=False)
    safe = np.where(area > 0, area, 1.0)
    centre = (pa.array(v, mask=area <= 0) for v in (x0 + mx / safe, y0 + my / safe))
    return pa.StructArray.from_arrays([pa.array(area), *centre, pa.array(meets)], ["area", "lng", "lat", "meets"])


def point_tests(edges: pa.Array, lng: pa.Array, lat: pa.Array, kx: pa.Array) -> pa.Array:
    """Per row whether the edges hold the point (even-odd, half-open), and its distance from the nearest of them, 0 where they do."""
    rows = len(edges)
    row, ax, ay, bx, by = edge_lists(edges)
    size = np.bincount(row, minlength=rows)
    px, py, k = (v.to_numpy(zero_copy_only=False)[row] for v in (lng, lat, kx))
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = ((ay > py) != (by > py)) & (px < (bx - ax) * ((py - ay) / (by - ay)) + ax)
    held = np.bincount(row[crosses], minlength=rows) % 2 == 1
    dist = np.full(rows, np.inf)
    some = np.flatnonzero(size > 0)
    if len(some):
        dist[some] = np.minimum.reduceat(segment_distance(px, py, ax, ay, bx, by, k), (np.cumsum(size) - size)[some])
    return pa.StructArray.from_arrays([pa.array(held), pa.array(np.where(held, 0.0, dist))], ["contains_point", "dist"])


overlap_area = F.arrow_udf(overlap_areas, T.DoubleType())
_PARTS = T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("area", "lng", "lat")), T.StructField("meets", T.BooleanType())])
overlap_parts = F.arrow_udf(common_parts, _PARTS)
point_test = F.arrow_udf(point_tests, T.StructType([T.StructField("contains_point", T.BooleanType()), T.StructField("dist", T.DoubleType())]))
have_common_point = F.arrow_udf(shares_point, T.BooleanType())
