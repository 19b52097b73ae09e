"""Exact area of a union of polygons inside a polygon, by a plane sweep.

Between two neighbouring event abscissas no edges cross, so the covered length is
linear there and its value in the middle times the width is the area. Events are
the ends of edges, their crossings with each other and with the window's lower and
upper side. Polygons are read with the even-odd rule.

Registered for pickling by value, so executors need no copy of this package.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs of edges, or of strips and edges, held at once.
HELD = 1 << 20
_PARCEL = 1 << 40


def _crossings(x0, y0, x1, y1) -> np.ndarray:
    """Abscissas where two of the edges (x0 < x1) cross."""
    slope = (y1 - y0) / (x1 - x0)
    order = np.argsort(x0, kind="stable")
    x0, y0, x1, y1, slope = (v[order] for v in (x0, y0, x1, y1, slope))
    # Partners of an edge are those that begin before it ends.
    count = np.searchsorted(x0, x1, "left") - np.arange(len(x0)) - 1
    total = np.concatenate(([0], np.cumsum(np.maximum(count, 0))))
    found, at = [np.empty(0)], 0
    while at < len(x0):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + HELD, "right")) - 1)
        i = np.repeat(np.arange(at, stop), np.maximum(count[at:stop], 0))
        j = i + 1 + np.arange(len(i)) - (total[i] - total[at])
        left, right = x0[j], np.minimum(x1[i], x1[j])
        d_left = y0[i] + slope[i] * (left - x0[i]) - y0[j]
        d_right = d_left + (slope[i] - slope[j]) * (right - left)
        cross = d_left * d_right < 0
        d_left, d_right, left, right = d_left[cross], d_right[cross], left[cross], right[cross]
        found.append(left + (right - left) * d_left / (d_left - d_right))
        at = stop
    return np.concatenate(found)


def _edges_from(window, owner, ax, ay, bx, by):
    """Edges from west to east that reach into the window, relative to its corner, and the events that part its strips."""
    west, south, east, north = window
    ax, bx, ay, by = ax - west, bx - west, ay - south, by - south
    width, height = east - west, north - south
    flip = bx < ax
    x0, y0, x1, y1 = np.where(flip, bx, ax), np.where(flip, by, ay), np.where(flip, ax, bx), np.where(flip, ay, by)
    use = (x0 < x1) & (x1 > 0) & (x0 < width)
    owner, x0, y0, x1, y1 = (v[use] for v in (owner, x0, y0, x1, y1))
    if not len(x0) or width <= 0 or height <= 0:
        return owner[:0], x0[:0], y0[:0], x1[:0], x0[:0], np.empty(0)
    slope = (y1 - y0) / (x1 - x0)
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = [x0 + (level - y0) / slope for level in (0.0, height)]
    sides = [s[(s > x0) & (s < x1)] for s in sides]
    events = np.concatenate((np.array([0.0, width]), x0, x1, *sides, _crossings(x0, y0, x1, y1)))
    return owner, x0, y0, x1, slope, np.unique(events[(events >= 0) & (events <= width)])


def _strips(owner, x0, y0, x1, slope, events):
    """(strip, edge, y in its middle) of the edges that span each strip, a bounded number at a time, ordered by strip, polygon and y."""
    middle = (events[1:] + events[:-1]) / 2.0
    first, last = np.searchsorted(middle, x0), np.searchsorted(middle, x1)
    depth = np.cumsum(np.bincount(first, minlength=len(middle) + 1) - np.bincount(last, minlength=len(middle) + 1))[: len(middle)]
    held, at = np.concatenate(([0], np.cumsum(depth))), 0
    while at < len(middle):
        stop = max(at + 1, int(np.searchsorted(held, held[at] + HELD, "right")) - 1)
        low, high = np.maximum(first, at), np.minimum(last, stop)
        count = np.maximum(high - low, 0)
        edge = np.repeat(np.arange(len(x0)), count)
        strip = low[edge] + np.arange(len(edge)) - (np.cumsum(count) - count)[edge]
        y = y0[edge] + slope[edge] * (middle[strip] - x0[edge])
        order = np.lexsort((y, owner[edge], strip))
        yield strip[order], edge[order], y[order]
        at = stop


def _turns(strip, who):
    """1 where an edge opens its polygon in the strip, -1 where it closes it."""
    new = np.flatnonzero(np.concatenate(([True], (strip[1:] != strip[:-1]) | (who[1:] != who[:-1]))))
    place = np.arange(len(who)) - np.repeat(new, np.diff(np.append(new, len(who))))
    return np.where(place % 2 == 0, 1, -1)


def union_pieces(window: tuple[float, float, float, float], owner: np.ndarray, ax, ay, bx, by) -> tuple[float, np.ndarray]:
    """The union of the polygons inside the window: its area, and trapezoids that make it up as rows of west, east, lower and
    upper side in the west, lower and upper side in the east. Edges that reach into the window's longitudes are enough."""
    west, south, _, north = window
    owner, x0, y0, x1, slope, events = _edges_from(window, owner, ax, ay, bx, by)
    found = [np.empty((0, 6))]
    for strip, edge, y in _strips(owner, x0, y0, x1, slope, events):
        if not len(strip):
            continue
        step = _turns(strip, owner[edge])
        order = np.lexsort((y, strip))
        strip, edge, step = strip[order], edge[order], step[order]
        cover = np.cumsum(step)
        opens, closes = np.flatnonzero(cover - step == 0), np.flatnonzero(cover == 0)
        left, right = events[strip[opens]], events[strip[opens] + 1]
        at = lambda e, x: np.clip(y0[e] + slope[e] * (x - x0[e]), 0.0, north - south)
        low, high = edge[opens], edge[closes]
        found.append(np.stack((left, right, at(low, left), at(high, left), at(low, right), at(high, right)), axis=1))
    rows = np.concatenate(found)
    size = (rows[:, 1] - rows[:, 0]) * (rows[:, 3] - rows[:, 2] + rows[:, 5] - rows[:, 4]) / 2.0
    rows, size = rows[size > 0], size[size > 0]
    rows[:, :2] += west
    rows[:, 2:] += south
    return float(size.sum()), rows


def union_area(window: tuple[float, float, float, float], owner: np.ndarray, ax, ay, bx, by) -> float:
    """Area inside the window and polygon 0 and any other polygon.

    ``owner`` numbers the polygon of each edge; 0 is the parcel.
    """
    height = window[3] - window[1]
    owner, x0, y0, x1, slope, events = _edges_from(window, owner, ax, ay, bx, by)
    wide, area = np.diff(events), 0.0
    for strip, edge, y in _strips(owner, x0, y0, x1, slope, events):
        if not len(strip):
            continue
        who = owner[edge]
        step = _turns(strip, who) * np.where(who == 0, _PARCEL, 1)
        order = np.lexsort((y, strip))
        strip, y, step = strip[order], np.clip(y[order], 0.0, height), step[order]
        # Every polygon closes in its strip, so the running sum starts each strip at zero.
        cover = np.cumsum(step)
        inside = (cover[:-1] > _PARCEL) & (strip[1:] == strip[:-1])
        area += float(np.sum(np.where(inside, y[1:] - y[:-1], 0.0) * wide[strip[:-1]]))
    return area
