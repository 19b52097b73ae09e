"""Shapes as sets of grid cells, worked out per Arrow batch.

A shape's grid cells fall into three kinds: wholly inside, on the boundary, outside.
Inside cells are joined up to the largest aligned squares (level k has 2**k cells a
side), so a shape needs about as many squares as boundary cells. Doubtful cells count
as boundary, where features are tested one by one.

Registered for pickling by value, so executors need no copy of this package.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPHERE_RADIUS_M = 6_371_000.0
MERCATOR_RADIUS_M = 6_378_137.0
#: Relative slack that turns a doubtful cell into a boundary cell.
SLACK = 1e-9
#: Pairs of segments and cells held at once.
HELD = 1 << 18


def _haversine(lng1, lat1, lng2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * SPHERE_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _mercator_y(lat):
    return np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * MERCATOR_RADIUS_M


def _gap(low, high, value):
    """Distance from a value to an interval, and to its farther end."""
    return np.maximum(np.maximum(low - value, value - high), 0.0), np.maximum(np.abs(low - value), np.abs(high - value))


def disk_cells(lng: float, lat: float, reach: tuple[float, float], radius: float, metric: str, cell: float):
    """(first column, first row, state) of a disk: 2 inside, 1 boundary, 0 outside."""
    columns = np.arange(np.floor((lng - reach[0]) / cell), np.floor((lng + reach[0]) / cell) + 1)
    rows = np.arange(np.floor((lat - reach[1]) / cell), np.floor((lat + reach[1]) / cell) + 1)
    x0, x1, y0, y1 = columns * cell, (columns + 1) * cell, rows * cell, (rows + 1) * cell
    near_x, far_x = _gap(x0, x1, lng)
    if metric == "mercator":
        scale = np.radians(1.0) * MERCATOR_RADIUS_M
        near_y, far_y = _gap(_mercator_y(y0), _mercator_y(y1), _mercator_y(lat))
        near, far = np.hypot(near_x[:, None] * scale, near_y), np.hypot(far_x[:, None] * scale, far_y)
    elif metric == "haversine":
        near_y = _gap(y0, y1, lat)[0]
        # The farthest point of a cell is a corner; the nearest is no nearer than this.
        flat = np.minimum(np.cos(np.radians(y0)), np.cos(np.radians(y1)))
        a = np.sin(np.radians(near_y) / 2) ** 2 + np.cos(np.radians(lat)) * flat * np.sin(np.radians(near_x[:, None]) / 2) ** 2
        near = 2 * SPHERE_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))
        far_lng = lng + far_x[:, None]
        far = np.maximum(_haversine(lng, lat, far_lng, y0), _haversine(lng, lat, far_lng, y1))
    else:
        unit = 1.0 if metric == "degree" else 111_320.0
        near_y, far_y = _gap(y0, y1, lat)
        near, far = np.hypot(near_x[:, None], near_y) * unit, np.hypot(far_x[:, None], far_y) * unit
    state = np.where(far <= radius * (1 - SLACK), 2, np.where(near > radius * (1 + SLACK), 0, 1))
    return int(columns[0]), int(rows[0]), state


def polygon_cells(ax, ay, bx, by, cell: float):
    """The same for a polygon given by its edges, with the even-odd rule."""
    c0, r0 = int(np.floor(min(ax.min(), bx.min()) / cell)), int(np.floor(min(ay.min(), by.min()) / cell))
    nc = int(np.floor(max(ax.max(), bx.max()) / cell)) - c0 + 1
    nr = int(np.floor(max(ay.max(), by.max()) / cell)) - r0 + 1
    left, right = np.minimum(ax, bx), np.maximum(ax, bx)
    x0 = (c0 + np.arange(nc)) * cell
    # Rows that an edge reaches within each column, a little more than it needs.
    slack = SLACK * (1.0 + np.abs(x0).max() + np.abs(ay).max())
    lo, hi = np.maximum(left[:, None], x0), np.minimum(right[:, None], x0 + cell)
    meets = lo <= hi + slack
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(bx != ax, (by - ay) / (bx - ax), 0.0)[:, None]
    upright = (bx == ax)[:, None]
    y_lo = np.where(upright, ay[:, None], ay[:, None] + slope * (lo - ax[:, None]))
    y_hi = np.where(upright, by[:, None], ay[:, None] + slope * (hi - ax[:, None]))
    edge, column = np.nonzero(meets)
    first = np.clip(np.floor((np.minimum(y_lo, y_hi)[edge, column] - slack) / cell).astype(int) - r0, 0, nr - 1)
    last = np.clip(np.floor((np.maximum(y_lo, y_hi)[edge, column] + slack) / cell).astype(int) - r0, 0, nr - 1)
    steps = np.zeros((nc, nr + 1), int)
    np.add.at(steps, (column, first), 1)
    np.add.at(steps, (column, last + 1), -1)
    boundary = np.cumsum(steps, axis=1)[:, :nr] > 0
    # Edges to the right of a centre, counted row by row.
    cy, cx = (r0 + np.arange(nr) + 0.5) * cell, x0 + 0.5 * cell
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (bx - ax) * ((cy[:, None] - ay) / (by - ay)) + ax
    at = np.where((ay > cy[:, None]) != (by > cy[:, None]), at, -np.inf)
    odd = np.zeros((nc, nr), bool)
    for row, crossing in enumerate(np.sort(at, axis=1)):
        odd[:, row] = (len(crossing) - np.searchsorted(crossing, cx, "right")) % 2 == 1
    return c0, r0, np.where(boundary, 1, np.where(odd, 2, 0))


def segment_distance(px, py, ax, ay, bx, by, kx):
    """Point to segment in flat metres, ``kx`` of them to a degree of longitude."""
    ky = np.radians(1.0) * SPHERE_RADIUS_M
    x, y, dx, dy = (ax - px) * kx, (ay - py) * ky, (bx - ax) * kx, (by - ay) * ky
    length2 = dx * dx + dy * dy
    t = np.clip(np.divide(-(x * dx + y * dy), length2, out=np.zeros_like(length2), where=length2 > 0), 0.0, 1.0)
    ex, ey = x + t * dx, y + t * dy
    return np.sqrt(ex * ex + ey * ey)


def segment_cells(ax, ay, bx, by, cell, radius: float):
    """(segment, column, row, inside) of the cells that reach within a radius of each segment, in flat metres at a point's
    latitude; ``inside`` tells those that lie within it wholly. ``cell`` may differ by segment."""
    unit = np.radians(1.0) * SPHERE_RADIUS_M
    cell = np.broadcast_to(np.asarray(cell, float), ax.shape)
    dy = radius / unit * (1 + 1e-6)
    dx = dy / np.cos(np.radians(np.minimum(np.maximum(np.abs(ay), np.abs(by)) + dy, 89.0)))
    c0, c1 = (np.floor(v / cell).astype(np.int64) for v in (np.minimum(ax, bx) - dx, np.maximum(ax, bx) + dx))
    r0, r1 = (np.floor(v / cell).astype(np.int64) for v in (np.minimum(ay, by) - dy, np.maximum(ay, by) + dy))
    tall = r1 - r0 + 1
    count = (c1 - c0 + 1) * tall
    total = np.concatenate(([0], np.cumsum(count)))
    parts, at = [(np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)], 0
    while at < len(ax):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + HELD, "right")) - 1)
        e = np.repeat(np.arange(at, stop), count[at:stop])
        k = np.arange(len(e)) - (total[e] - total[at])
        c, r, w = c0[e] + k // tall[e], r0[e] + k % tall[e], cell[e]
        ends = tuple(v[e] for v in (ax, ay, bx, by))
        south, north = r * w, (r + 1) * w
        # A degree of longitude is longest at the latitude of the cell next to the equator; distances grow with it.
        low = np.where((south <= 0) & (north >= 0), 0.0, np.minimum(np.abs(south), np.abs(north)))
        high = np.minimum(np.maximum(np.abs(south), np.abs(north)), 90.0)
        short = np.cos(np.radians(high)) * unit
        near = segment_distance((c + 0.5) * w, (r + 0.5) * w, *ends, short) - np.hypot(w / 2 * short, w / 2 * unit)
        use = near <= radius * (1 + SLACK) + 1e-6
        e, c, r, w, south, north, low = (v[use] for v in (e, c, r, w, south, north, low))
        ends = tuple(v[use] for v in ends)
        # The distance from a segment is convex, so a corner is farthest.
        long = np.cos(np.radians(low)) * unit
        far = np.max([segment_distance(x, y, *ends, long) for x in (c * w, (c + 1) * w) for y in (south, north)], axis=0)
        parts.append((e, c, r, far <= radius * (1 - SLACK) - 1e-6))
        at = stop
    return tuple(np.concatenate(v) for v in zip(*parts))


def merged(shape, column, row, levels: int):
    """(level, shape, column, row) of the largest aligned squares of whole cells, for many shapes at once."""
    out = []
    for level in range(levels):
        order = np.lexsort((row >> 1, column >> 1, shape))
        shape, column, row = shape[order], column[order], row[order]
        new = np.ones(len(shape), bool)
        new[1:] = (shape[1:] != shape[:-1]) | (column[1:] >> 1 != column[:-1] >> 1) | (row[1:] >> 1 != row[:-1] >> 1)
        first = np.flatnonzero(new)
        full = np.diff(np.append(first, len(shape))) == 4
        rest = ~np.repeat(full, np.diff(np.append(first, len(shape))))
        out.append((np.full(int(rest.sum()), level), shape[rest], column[rest], row[rest]))
        shape, column, row = shape[first[full]], column[first[full]] >> 1, row[first[full]] >> 1
    out.append((np.full(len(shape), levels), shape, column, row))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def polygon_cells_within(ax, ay, bx, by, cell: float, radius: float):
    """(first column, first row, state, (edge, column, row)): the cells of a polygon and of what is within a radius of its
    boundary: 2 inside the polygon, 1 partly or near, 0 neither; and the cells that an edge is near."""
    c0, r0, own = polygon_cells(ax, ay, bx, by, cell)
    edge, column, row, _ = segment_cells(ax, ay, bx, by, cell, radius)
    n0, m0 = min(c0, int(column.min())), min(r0, int(row.min()))
    state = np.zeros((max(c0 + own.shape[0], int(column.max()) + 1) - n0, max(r0 + own.shape[1], int(row.max()) + 1) - m0), int)
    state[column - n0, row - m0] = 1
    here = state[c0 - n0 : c0 - n0 + own.shape[0], r0 - m0 : r0 - m0 + own.shape[1]]
    here[...] = np.where(own > 0, own, here)
    return n0, m0, state, (edge, column, row)


def squares(first_column: int, first_row: int, state: np.ndarray, levels: int):
    """(level, column, row) of the largest aligned inside squares, and of boundary cells as level -1."""
    # Grow to whole squares of the highest level.
    size = 1 << levels
    c0, r0 = first_column // size * size, first_row // size * size
    nc, nr = -(-(first_column + state.shape[0] - c0) // size) * size, -(-(first_row + state.shape[1] - r0) // size) * size
    full = np.zeros((nc, nr), np.int8)
    full[first_column - c0 : first_column - c0 + state.shape[0], first_row - r0 : first_row - r0 + state.shape[1]] = state
    c, r = np.nonzero(full == 1)
    out = [(np.full(len(c), -1), c + c0, r + r0)]
    inside = [full == 2]
    for _ in range(levels):
        low = inside[-1]
        inside.append(low[0::2, 0::2] & low[1::2, 0::2] & low[0::2, 1::2] & low[1::2, 1::2])
    for level, here in enumerate(inside):
        if level < levels:
            here = here & ~np.repeat(np.repeat(inside[level + 1], 2, axis=0), 2, axis=1)
        c, r = np.nonzero(here)
        out.append((np.full(len(c), level), c + (c0 >> level), r + (r0 >> level)))
    return tuple(np.concatenate(parts) for parts in zip(*out))
