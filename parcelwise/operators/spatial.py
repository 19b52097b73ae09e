"""Spatial joins as grid-cell equi-joins.

The layer side is exploded over the grid cells its (radius-expanded) box covers;
the point side keeps one row in its own cell. The equi-join on the cell is then
refined by an exact test, so every pair is found exactly once and no distinct is
needed. A crowded cell is one key of a plain shuffle join, so adaptive execution
splits it on either side by its measured size, as many cells as there are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, geo
from ..functions.geo import HAVERSINE, Metric
from ..session import spread

CELL = ["_cx", "_cy"]


def cell_index(value: Column, cell: float) -> Column:
    return F.floor(value / cell).cast("long")


def own_cell(df: DataFrame, cell: float, x: str = "lng", y: str = "lat") -> DataFrame:
    return df.withColumn("_cx", cell_index(F.col(x), cell)).withColumn("_cy", cell_index(F.col(y), cell))


def cover_cells(df: DataFrame, cell: float, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """One row per grid cell that the box touches."""
    return df.withColumn("_cx", F.explode(F.sequence(cell_index(x0, cell), cell_index(x1, cell)))).withColumn(
        "_cy", F.explode(F.sequence(cell_index(y0, cell), cell_index(y1, cell)))
    )


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which a side was exploded or cut into cells just before.

    Spark takes such a side to be as small as what it was made from, and would collect it on
    the driver to broadcast it; a merge join shuffles both sides, whatever their size.
    """
    return left.join(right.hint("merge"), on, how)


def suggest_cell(layer: DataFrame, floor: float = 1e-4) -> float:
    """Cell size from the layer's root-mean-square box size.

    With this size the whole layer covers at most about four cells per feature,
    however unequal the features are: Σ(eᵢ/c + 1)² ≤ 2Σ(eᵢ²/c² + 1) = 4n.
    """
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = layer.agg(F.sqrt(F.avg(extent * extent)).alias("rms")).first()
    return max(floor, float(box["rms"] or 1.0))


def with_extent(layer: DataFrame, rings: str = "rings") -> DataFrame:
    return layer.withColumns(geo.ring_extent(rings))


def cover_with_edges(polygons: DataFrame, cell: float) -> DataFrame:
    """One row per cell of a polygon's box with only the edges that cell needs.

    A ray cast to the right from a point of the cell can cross only edges that
    reach the cell's latitude band and are not wholly to its left, so a long
    boundary is never repeated whole. Bands are cut first, then cells.
    """
    south = F.col("_cy") * cell
    bands = (
        polygons.withColumn("_edges", geo.ring_edges("rings"))
        .drop("rings")
        .withColumn("_cy", F.explode(F.sequence(cell_index(F.col("y0"), cell), cell_index(F.col("y1"), cell))))
        .withColumn("_edges", geo.edges_in_band("_edges", south, south + cell))
    )
    return bands.withColumn(
        "_cx", F.explode(F.sequence(cell_index(F.col("x0"), cell), cell_index(F.col("x1"), cell)))
    ).withColumn("_edges", geo.edges_east_of("_edges", F.col("_cx") * cell))


# ── containment ─────────────────────────────────────────────────────────────
def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Inner join: every (point, polygon) with the point inside.

    ``points`` needs lng, lat; ``polygons`` needs rings, x0, y0, x1, y1. Other
    columns of both sides are kept, so their names must not clash.
    """
    left = own_cell(points, cell)
    right = cover_with_edges(polygons, cell)
    in_box = F.col("lng").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    return (
        meet(left, right, CELL)
        .filter(in_box)
        .filter(geo.odd_crossings("_edges", "lng", "lat"))
        .drop(*CELL, "_edges", "x0", "y0", "x1", "y1")
    )


def first_polygon(
    points: DataFrame, polygons: DataFrame, cell: float, key: str, order: str, attrs: list[str]
) -> DataFrame:
    """Left join to one containing polygon, the smallest ``order`` value. ``cell`` is the width of a usual polygon."""
    from .counts import held_by

    hit = F.struct(order, *[a for a in attrs if a != order])
    named = polygons.select(*dict.fromkeys([order, *attrs]), "rings", "x0", "y0", "x1", "y1")
    adds = F.col("_whole").isNull() | (hit < F.col("_whole._hit"))
    hits = held_by(points, named, key, {"_hit": (F.min(hit), F.min)}, cell, adds=adds)
    return points.join(hits, key, "left").select(*points.columns, *[F.col(f"_hit.{a}").alias(a) for a in attrs])


def polygon_flags(points: DataFrame, polygons: DataFrame, cell: float, key: str, flags: dict[str, Column]) -> DataFrame:
    """Existence flags for many layers in one pass; absent means false. ``cell`` is the width of a usual polygon."""
    from .counts import held_by

    named = polygons.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()], "rings", "x0", "y0", "x1", "y1")
    adds = reduce(Column.__or__, [F.col(n) & ~F.coalesce(F.col(f"_whole.{n}"), F.lit(False)) for n in flags])
    found = held_by(points, named, key, {n: (F.bool_or(n), F.bool_or) for n in flags}, cell, adds=adds)
    out = points.join(found, key, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in flags})


def boxes_meeting(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Inner join of polygons whose boxes meet, each pair once.

    ``a`` carries x0…y1 and ``b`` the same names prefixed ``b_``. A pair shares
    several cells; it is kept only in the one that holds the lower-left corner of
    the common box.
    """
    left = cover_cells(a, cell, *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    right = cover_cells(b, cell, *[F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    overlap = (
        (F.col("x0") <= F.col("b_x1"))
        & (F.col("b_x0") <= F.col("x1"))
        & (F.col("y0") <= F.col("b_y1"))
        & (F.col("b_y0") <= F.col("y1"))
    )
    home = (F.col("_cx") == cell_index(F.greatest("x0", "b_x0"), cell)) & (
        F.col("_cy") == cell_index(F.greatest("y0", "b_y0"), cell)
    )
    return meet(left, right, CELL).filter(overlap & home).drop(*CELL)


def polygons_touching(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of polygons that share at least a point (``rings`` and ``b_rings``)."""
    return boxes_meeting(a, b, cell).filter(clip.have_common_point("rings", "b_rings"))


# ── radius ──────────────────────────────────────────────────────────────────
def within_radius(
    points: DataFrame,
    features: DataFrame,
    radius: float | str,
    metric: Metric = HAVERSINE,
    max_radius: float | None = None,
) -> DataFrame:
    """Inner join of points and features no farther apart than the radius.

    Feature coordinates are ``f_lng, f_lat``. ``radius`` is a number or the name
    of a feature column (then ``max_radius`` bounds it and sizes the grid). The
    result has a ``dist`` column.
    """
    largest = float(max_radius if max_radius is not None else radius)
    cell = max(3.0 * metric.typical_reach(largest), 1e-4)
    reach = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    dx, dy = metric.reach(reach, F.col("f_lat"))
    return _in_boxes(points, features, dx, dy, cell).withColumn("dist", metric.distance("lng", "lat", "f_lng", "f_lat")).filter(F.col("dist") <= reach)


def _in_boxes(points: DataFrame, features: DataFrame, dx: Column, dy: Column, cell: float) -> DataFrame:
    """Pairs whose coordinates differ by at most dx and dy."""
    right = cover_cells(features, cell, F.col("f_lng") - dx, F.col("f_lat") - dy, F.col("f_lng") + dx, F.col("f_lat") + dy)
    near_box = (F.abs(F.col("lng") - F.col("f_lng")) <= dx) & (F.abs(F.col("lat") - F.col("f_lat")) <= dy)
    return meet(own_cell(points, cell), right, CELL).filter(near_box).drop(*CELL)


def collapse_copies(features: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Pre-aggregate features at identical coordinates before a radius join."""
    return features.groupBy("f_lng", "f_lat").agg(*[c.alias(n) for n, c in aggs.items()])


def one_per_spot(features: DataFrame, feature_key: str, attrs: list[str]) -> DataFrame:
    """Lowest key per position: ties in distance go to it anyway."""
    best = features.groupBy("f_lng", "f_lat").agg(F.min(F.struct(feature_key, *attrs)).alias("_f"))
    return best.select("f_lng", "f_lat", *[F.col(f"_f.{c}").alias(c) for c in (feature_key, *attrs)])


def lines_within(points: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """Join to segments (ax, ay, bx, by) within the radius; adds ``dist``. Segments take the cells near them, not those of their box."""
    reach = HAVERSINE.typical_reach(radius_m)
    cell = max(3.0 * reach, 1e-4)
    top = F.least(F.greatest(F.abs("ay"), F.abs("by")) + reach, F.lit(89.0))
    dx, dy = F.lit(reach) / F.cos(F.radians(top)) * (1 + 1e-6), F.lit(reach * (1 + 1e-6))
    left = own_cell(points.withColumn("_kx", geo.metres_per_lng_degree("lat")), cell)
    right = cells_along(segments, F.lit(cell), dx, dy)
    in_box = F.col("lat").between(F.least("ay", "by") - dy, F.greatest("ay", "by") + dy)
    return (
        meet(left, right, CELL)
        .filter(in_box)
        .withColumn("dist", geo.segment_distance_m("lng", "lat", "ax", "ay", "bx", "by", "_kx"))
        .filter(F.col("dist") <= radius_m)
        .drop(*CELL, "_kx")
    )


# ── nearest ─────────────────────────────────────────────────────────────────
def nearest_within(
    points: DataFrame,
    features: DataFrame,
    key: str,
    radius: float,
    feature_key: str,
    attrs: list[str],
    metric: Metric = HAVERSINE,
    order_metric: Metric | None = None,
) -> DataFrame:
    """Left join to the nearest feature in the radius, ties by feature key.

    With ``order_metric`` the nearest by that distance (degrees, say) is picked
    first and dropped if it lies beyond the radius in ``metric``; a feature that is
    second by ``order_metric`` is never a match. Candidates come from a box whose
    half side is the radius in degrees of longitude, the longer of the two: any
    feature within the radius lies in it, and what lies outside is beyond the radius.
    """
    rest = [a for a in attrs if a not in ("dist", feature_key)]
    slim, spots = points.select(key, "lng", "lat"), one_per_spot(features, feature_key, rest)
    if order_metric:
        # The reach grows with latitude; a tenth more covers a point north of its feature.
        dx, dy = metric.reach(F.lit(float(radius)), F.col("f_lat"))
        side = F.greatest(dx, dy) * 1.1
        pairs = _in_boxes(slim, spots, side, side, max(3.0 * metric.typical_reach(radius), 1e-4))
        pairs = pairs.withColumn("dist", metric.distance("lng", "lat", "f_lng", "f_lat"))
        rank = order_metric.distance("lng", "lat", "f_lng", "f_lat")
    else:
        pairs, rank = close_pairs(slim, spots, radius, 1, metric), F.col("dist")
    best = pairs.groupBy(key).agg(F.min(F.struct(rank.alias("_rank"), F.col(feature_key), F.col("dist"), *rest)).alias("_b"))
    best = best.filter(F.col("_b.dist") <= radius)
    out = [feature_key, "dist", *rest]
    return points.join(best, key, "left").select(*points.columns, *[F.col(f"_b.{a}").alias(a) for a in out])


#: Grids of a nearest search, each half as wide as the one before.
SEARCH_LEVELS = 14


def close_pairs(points: DataFrame, spots: DataFrame, radius: float, k: int, metric: Metric = HAVERSINE, by: list[str] | None = None) -> DataFrame:
    """Pairs within the radius that hold the k nearest spots of every point (positions must differ), with ``dist``.

    With ``by``, columns of both sides, a point meets only the spots that are equal in them.

    A point's search starts at the finest grid whose cell around the point holds k spots:
    their distance is at most the cell's diagonal, so only spots within that bound are candidates,
    however many the radius holds. A point without such a cell searches the whole radius.
    Spots lie in the cells of every grid.
    """
    if metric.name == "mercator":
        raise ValueError("cells do not bound projected distances")
    place = ["_l", *(by or []), *CELL]
    widest = metric.typical_reach(radius) / math.sqrt(2.0)
    size = F.lit(widest) / F.pow(F.lit(2.0), F.col("_l"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(SEARCH_LEVELS)))
    index = lambda c: F.floor(F.col(c) / size).cast("long")
    spread = spots.withColumn("_l", levels).withColumns({"_cx": index("f_lng"), "_cy": index("f_lat")})
    crowded = spread.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select(*place)
    own = points.withColumn("_l", levels).withColumns({"_cx": index("lng"), "_cy": index("lat")})
    start = meet(own, crowded, place, "left_semi").groupBy(*points.columns).agg(F.max("_l").alias("_l"))
    started = points.join(start, points.columns, "left").withColumn("_l", F.coalesce("_l", F.lit(0)))
    # Slack keeps the corners of the cell within the bound.
    bound = F.least(F.lit(float(radius)), size * (math.sqrt(2.0) / metric.degrees_per_unit * (1 + 1e-9)))
    bounded = started.withColumn("_bound", F.when(F.col("_l") > 0, bound).otherwise(float(radius)))
    dx, dy = metric.reach(F.col("_bound"), F.col("lat"))
    around = lambda c, d: F.explode(F.sequence(F.floor((F.col(c) - d) / size).cast("long"), F.floor((F.col(c) + d) / size).cast("long")))
    left = bounded.withColumns({"_dx": dx, "_dy": dy}).withColumn("_cx", around("lng", F.col("_dx"))).withColumn("_cy", around("lat", F.col("_dy"))).drop("_dx", "_dy")
    pairs = meet(left, spread, place).withColumn("dist", metric.distance("lng", "lat", "f_lng", "f_lat"))
    return pairs.filter(F.col("dist") <= F.col("_bound")).drop("_l", *CELL, "_bound")


def k_nearest_within(
    points: DataFrame, features: DataFrame, key: str, radius: float, feature_key: str, k: int, metric: Metric = HAVERSINE, by: list[str] | None = None
) -> DataFrame:
    """The k nearest features per point with their rank, ties by feature key. With ``by``, columns of
    both sides, those of each point and value, among the features of that value.

    Copies of a position beyond the first k can never be among the k nearest, so
    they go first; the rest of a spot's copies travel as a list. Only spots that can be among
    the k nearest become pairs, and each task keeps k rows a point before the shuffle.
    """
    by = by or []
    rest = [c for c in features.columns if c not in ("f_lng", "f_lat", *by)]
    few = top_k_per_key(features, [*by, "f_lng", "f_lat"], [F.col(feature_key)], k)
    spots = few.groupBy(*by, "f_lng", "f_lat").agg(F.collect_list(F.struct(*rest)).alias("_copies"))
    pairs = close_pairs(points.select(key, *by, "lng", "lat"), spots, radius, k, metric, by)
    every = pairs.select(key, *by, "lng", "lat", "f_lng", "f_lat", "dist", F.explode("_copies").alias("_f")).select("*", "_f.*").drop("_f")
    return top_k_per_key(every, [key, *by], [F.col("dist"), F.col(feature_key)], k)


def largest_within(
    points: DataFrame, features: DataFrame, key: str, radius: float, value: str, feature_key: str, k: int, metric: Metric = HAVERSINE
) -> DataFrame:
    """The k features of largest ``value`` (not null) within the radius of each point, with ``dist`` and ``rank``, ties by feature key.

    The features of a cell are ranked by value and put into runs of k, k, 2k, 4k, ... The first runs around
    a point give it k features in its radius, whose least value the others must reach: of the other
    runs only those are read whose largest value does. At one position only the k largest can be among them.
    """
    order = [F.desc(value), F.col(feature_key)]
    cell = max(metric.typical_reach(radius), 1e-4)
    few = own_cell(top_k_per_key(features, ["f_lng", "f_lat"], order, k).drop("rank"), cell, "f_lng", "f_lat")
    ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy(*CELL).orderBy(*order)))
    runs = ranked.withColumn("_run", F.when(F.col("_r") <= k, 0).otherwise(F.ceil(F.log2(F.col("_r") / k)).cast("int"))).drop("_r")
    dx, dy = metric.reach(F.lit(float(radius)), F.col("lat"))
    around = lambda c, d: F.explode(F.sequence(cell_index(F.col(c) - d, cell), cell_index(F.col(c) + d, cell)))
    at = points.select(key, "lng", "lat").withColumns({"_dx": dx, "_dy": dy}).withColumn("_cx", around("lng", F.col("_dx"))).withColumn("_cy", around("lat", F.col("_dy"))).drop("_dx", "_dy")

    def near(left: DataFrame, right: DataFrame, place: list[str]) -> DataFrame:
        return meet(left, right, place).drop(*CELL, "_run").withColumn("dist", metric.distance("lng", "lat", "f_lng", "f_lat")).filter(F.col("dist") <= radius)

    first = near(at, runs.filter("_run = 0"), CELL)
    least = top_k_per_key(first, [key], order, k).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_least")).filter(F.col("_n") >= k).drop("_n")
    reach = F.col("_least").isNull() | (F.col("_top") >= F.col("_least"))
    tops = runs.filter("_run > 0").groupBy(*CELL, "_run").agg(F.max(value).alias("_top"))
    asked = meet(at.join(least, key, "left"), tops, CELL).filter(reach).drop("_top", "_least")
    return top_k_per_key(first.unionByName(near(asked, runs.filter("_run > 0"), [*CELL, "_run"])), [key], order, k)


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Exact top-k per key; Spark's group limit cuts each task's rows to k before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def nearest(
    points: DataFrame,
    features: DataFrame,
    key: str,
    feature_key: str,
    attrs: list[str],
    cell: float | None = None,
    metric: Metric = HAVERSINE,
    extent: float = 360.0,
) -> DataFrame:
    """Nearest feature with no radius, exact, without a driver loop.

    ``extent`` bounds the coordinate range (degrees, or cells for a raster). Without a ``cell``
    the grid is as fine as the features are dense.

    Works on the grid first. For every occupied point cell, find the coarsest
    needed level: the smallest power-of-two cell whose 3×3 neighbourhood holds a
    feature. That bounds the distance, so only feature cells that could beat the
    bound are candidates. The cell tables grow with occupied area, not rows.
    """
    rest = [a for a in attrs if a not in ("dist", feature_key)]
    cell = cell or density_cell(features)
    base = own_cell(points.select(key, "lng", "lat"), cell)
    feats = own_cell(one_per_spot(spread(features.select("f_lng", "f_lat", feature_key, *rest), "f_lng", "f_lat"), feature_key, rest), cell, "f_lng", "f_lat").withColumnsRenamed(
        {"_cx": "_fx", "_cy": "_fy"}
    )
    feature_cells = feats.select(F.col("_fx").alias("_cx"), F.col("_fy").alias("_cy")).distinct()
    links = cell_candidates(base.select(*CELL).distinct(), feature_cells, cell, metric, extent)
    right = meet(links, feats, ["_fx", "_fy"]).drop("_fx", "_fy")
    pairs = meet(base, right, CELL).withColumn("dist", metric.distance("lng", "lat", "f_lng", "f_lat"))
    best = pairs.groupBy(key).agg(F.min(F.struct("dist", feature_key, *rest)).alias("_b"))
    return points.join(best, key, "left").select(
        *points.columns, *[F.col(f"_b.{a}").alias(a) for a in (feature_key, "dist", *rest)]
    )


#: Features that share a cell of a density grid with a feature, on average.
MATES = 4.0


def density_cell(features: DataFrame, coarsest: float = 1.0, levels: int = 16) -> float:
    """The widest cell (``coarsest`` halved some times) whose features have few others in their cell, however uneven they lie."""
    size = F.lit(float(coarsest)) / F.pow(F.lit(2.0), F.col("_l"))
    index = lambda c: F.floor(F.col(c) / size).cast("long")
    # A small table is one task's, and has many cells.
    spots = spread(features.select("f_lng", "f_lat"), "f_lng", "f_lat").distinct()
    cells = spots.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels)))).groupBy("_l", index("f_lng").alias("_cx"), index("f_lat").alias("_cy")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    mates = cells.groupBy("_l").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mates"))
    fit = mates.filter(F.col("mates") <= MATES).agg(F.min("_l")).first()[0]
    return coarsest / 2.0 ** (levels if fit is None else fit)


#: Cells that a segment of usual length covers along its length on the finest grid of a line search, at most.
SEGMENT_CELLS = 32


def nearest_line(
    points: DataFrame, segments: DataFrame, key: str, segment_key: str, attrs: list[str], cell: float | None = None, extent: float = 360.0
) -> DataFrame:
    """Nearest segment (ax, ay, bx, by) with no radius, exact, without a driver loop.

    The nearest segment end bounds the distance. A point then looks only into the
    cells around it at the grid level whose cells are as wide as its bound; segments
    lie in the cells of every level that they pass. A point is a segment with equal ends.
    Without a ``cell`` the finest grid follows the density of the ends.
    """
    rest = [a for a in attrs if a not in ("dist", segment_key)]
    at = points.select(key, "lng", "lat").withColumn("_kx", geo.metres_per_lng_degree("lat"))
    ends = segments.select(F.explode(F.array(geo.point("ax", "ay"), geo.point("bx", "by"))).alias("_e")).select(
        F.col("_e.x").alias("f_lng"), F.col("_e.y").alias("f_lat"), F.col("_e.x").alias("_ex"), F.col("_e.y").alias("_ey"), F.lit(0).alias("_end")
    )
    dense = cell or density_cell(ends)
    cell = cell or max(dense, _segment_length(segments) / SEGMENT_CELLS)
    bound = geo.segment_distance_m("lng", "lat", "_ex", "_ey", "_ex", "_ey", "_kx")
    bounded = at.join(nearest(at.select(key, "lng", "lat"), ends, key, "_end", ["_ex", "_ey"], dense).select(key, "_ex", "_ey"), key)
    levels = max(1, math.ceil(math.log2(extent / cell)) + 1)
    wide = F.greatest(bound / F.greatest(F.col("_kx"), F.lit(1.0)), bound / geo.SPHERE_M_PER_DEG) * (1 + 1e-9)
    level = F.greatest(F.lit(0), F.least(F.lit(levels), F.ceil(F.log2(F.greatest(wide, F.lit(1e-12)) / cell)).cast("int")))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_l"))
    index = lambda v: F.floor(v / size).cast("long")
    around = lambda v: F.explode(F.sequence(index(v) - 1, index(v) + 1))
    left = bounded.withColumn("_l", level).withColumn("_cx", around(F.col("lng"))).withColumn("_cy", around(F.col("lat"))).drop("_ex", "_ey")
    # Of equal segments the one of least key is the nearest anyway.
    alone = segments.groupBy("ax", "ay", "bx", "by").agg(F.min(F.struct(segment_key, *rest)).alias("_s")).select("ax", "ay", "bx", "by", *[F.col(f"_s.{c}").alias(c) for c in (segment_key, *rest)])
    every = alone.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    right = cells_along(every, size)
    pairs = meet(left, right, ["_l", *CELL]).withColumn("dist", geo.segment_distance_m("lng", "lat", "ax", "ay", "bx", "by", "_kx"))
    best = pairs.groupBy(key).agg(F.min(F.struct("dist", segment_key, *rest)).alias("_b"))
    return points.join(best, key, "left").select(*points.columns, *[F.col(f"_b.{a}").alias(a) for a in (segment_key, "dist", *rest)])


def cells_along(segments: DataFrame, size: Column, dx: Column | float = 0.0, dy: Column | float = 0.0) -> DataFrame:
    """One row per grid cell that a segment passes, or within dx and dy of it: in each column of cells only the rows it reaches there."""
    slack = 1e-9
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    west = F.greatest(low, F.col("_cx") * size - dx) - slack
    east = F.least(high, (F.col("_cx") + 1) * size + dx) + slack
    slope = F.coalesce(F.try_divide(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")), F.lit(0.0))
    upright = high - low <= slack
    bottom, top = F.least("ay", "by"), F.greatest("ay", "by")
    at = lambda x: F.least(F.greatest(F.col("ay") + (x - F.col("ax")) * slope, bottom), top)
    y0 = F.when(upright, bottom).otherwise(F.least(at(west), at(east))) - slack - dy
    y1 = F.when(upright, top).otherwise(F.greatest(at(west), at(east))) + slack + dy
    index = lambda v: F.floor(v / size).cast("long")
    columns = segments.withColumn("_cx", F.explode(F.sequence(index(low - slack - dx), index(high + slack + dx))))
    return columns.withColumn("_cy", F.explode(F.sequence(index(y0), index(y1))))


def _segment_length(segments: DataFrame) -> float:
    """Root mean square of the longer side of the segments' boxes."""
    side = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    return float(segments.agg(F.sqrt(F.avg(side * side)).alias("rms")).first()["rms"] or 0.0)


def line_distance_within(points: DataFrame, segments: DataFrame, key: str, segment_key: str, radius_m: float) -> DataFrame:
    """Distance to the nearest segment (ties by segment key) of every key that has one within the radius.

    No more segments become pairs than the nearest may be among, however many the radius holds.
    """
    near = nearest_line(points, segments, key, segment_key, []).filter(F.col("dist") <= radius_m)
    return near.groupBy(key).agg(F.min(F.struct("dist", segment_key)).alias("_b")).select(key, F.col("_b.dist").alias("dist"), F.col(f"_b.{segment_key}").alias(segment_key))


def cell_candidates(
    point_cells: DataFrame, feature_cells: DataFrame, cell: float, metric: Metric, extent: float = 360.0
) -> DataFrame:
    """(point cell, feature cell) pairs that can contain a nearest match."""
    levels = max(1, math.ceil(math.log2(extent / cell)) + 1)
    f = feature_cells.select(F.col("_cx").alias("_fx"), F.col("_cy").alias("_fy"))
    coarse = f.select(
        F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_l"), "_fx", "_fy"
    ).select("_l", F.expr("shiftright(_fx, _l)").alias("_kx"), F.expr("shiftright(_fy, _l)").alias("_ky")).distinct()
    around = F.sequence(F.lit(-1), F.lit(1))
    lifted = point_cells.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select(
        *CELL, "_l", F.expr("shiftright(_cx, _l)").alias("_px"), F.expr("shiftright(_cy, _l)").alias("_py")
    )
    # Neighbours are looked up once for all point cells in a cell of a level.
    neighbours = lifted.select("_l", "_px", "_py").distinct().withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    near = neighbours.select("_l", "_px", "_py", (F.col("_px") + F.col("_dx")).alias("_kx"), (F.col("_py") + F.col("_dy")).alias("_ky"))
    served = meet(near, coarse, ["_l", "_kx", "_ky"]).select("_l", "_px", "_py").distinct()
    found = meet(lifted, served, ["_l", "_px", "_py"]).groupBy(*CELL).agg(F.min("_l").alias("_l"))
    # A feature lies within 2·2^l cells on each axis of any point in the cell, so
    # the nearest lies within 2√2·2^l cells of latitude (more in longitude).
    size = F.pow(F.lit(2.0), F.col("_l"))
    reach = size * (2.0 * math.sqrt(2.0) * cell)
    mid_lat = F.col("_cy") * cell
    edge = F.least(F.abs(mid_lat) + reach + cell, F.lit(89.0))
    stretch = F.lit(1.0) if metric.name != "haversine" else F.lit(1.0) / F.cos(F.radians(edge))
    up = F.greatest(F.lit(2), F.ceil(F.log2(stretch * (2.0 * math.sqrt(2.0)))).cast("int"))
    search = found.withColumn("_m", F.least(F.col("_l") + up, F.lit(levels)))
    spread = search.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).select(
        *CELL,
        "_m",
        (F.expr("shiftright(_cx, _m)") + F.col("_dx")).alias("_kx"),
        (F.expr("shiftright(_cy, _m)") + F.col("_dy")).alias("_ky"),
    )
    by_level = f.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select(
        "_m",
        F.expr("shiftright(_fx, _m)").alias("_kx"),
        F.expr("shiftright(_fy, _m)").alias("_ky"),
        "_fx",
        "_fy",
    )
    pairs = meet(spread, by_level, ["_m", "_kx", "_ky"]).select(*CELL, "_fx", "_fy")
    lo, hi = _cell_bounds(cell, metric)
    pairs = pairs.withColumn("_lo", lo).withColumn("_hi", hi)
    best = pairs.groupBy(*CELL).agg(F.min("_hi").alias("_cap"))
    return meet(pairs, best, CELL).filter(F.col("_lo") <= F.col("_cap")).select(*CELL, "_fx", "_fy")


def _cell_bounds(cell: float, metric: Metric) -> tuple[Column, Column]:
    """Lower and upper bound of the distance between points of two cells."""
    gap_x, gap_y = F.abs(F.col("_cx") - F.col("_fx")), F.abs(F.col("_cy") - F.col("_fy"))
    near_x = F.greatest(gap_x - 1, F.lit(0)) * cell
    near_y = F.greatest(gap_y - 1, F.lit(0)) * cell
    far_x, far_y = (gap_x + 1) * cell, (gap_y + 1) * cell
    if metric.name == "haversine":
        def cosines(row: str) -> tuple[Column, Column]:
            south, north = F.col(row) * cell, (F.col(row) + 1) * cell
            widest = F.greatest(F.abs(south), F.abs(north))
            slack = F.least(F.abs(south), F.abs(north))
            straddles = (south < 0) & (north > 0)
            return F.cos(F.radians(F.least(widest, F.lit(90.0)))), F.when(straddles, 1.0).otherwise(
                F.cos(F.radians(F.least(slack, F.lit(90.0))))
            )

        small_p, large_p = cosines("_cy")
        small_f, large_f = cosines("_fy")

        def bound(dx: Column, dy: Column, c: Column) -> Column:
            s1, s2 = F.sin(F.radians(F.least(dy, F.lit(180.0))) / 2), F.sin(F.radians(F.least(dx, F.lit(180.0))) / 2)
            a = s1 * s1 + c * s2 * s2
            return F.lit(2.0 * 6_371_000.0) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))

        # A small allowance keeps rounding from pruning an exact tie.
        return bound(near_x, near_y, small_p * small_f) - 1e-3, bound(far_x, far_y, large_p * large_f) + 1e-3
    unit = 1.0 / metric.degrees_per_unit
    return (
        F.sqrt(near_x * near_x + near_y * near_y) * unit - 1e-9,
        F.sqrt(far_x * far_x + far_y * far_y) * unit + 1e-9,
    )
