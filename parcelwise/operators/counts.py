"""Sums over the features inside a circle or polygon, without listing them.

Features at one position become one spot. Spots are summed per grid cell and per square
of 2, 4, 8, ... cells. A shape is cut into the largest squares inside it, whose sums are
joined as they are, and boundary cells, whose spots are tested one by one. So a shape
costs about as many rows as its boundary has cells and spots, however many it holds.
The grid is as fine as the spots are dense, within bounds that keep a shape's cells few.
Rows of a cut are shuffled and sorted, tests of spots are not, so a cell holds a few spots.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import geo
from ..functions.cells import disk_cells, merged, polygon_cells, polygon_cells_within, segment_cells, squares
from ..functions.clip import point_test, ring_edges
from ..functions.geo import HAVERSINE, Metric
from ..session import spread
from .spatial import meet, top_k_per_key

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells along half a shape, at most and at least.
FINEST, COARSEST = 64, 4
#: Spots of a cell, on average.
SPOTS_A_CELL = 8.0
#: Shapes that a task cuts at a time, so that what it holds doesn't grow with the shapes' cells.
SHAPES_A_STEP = 256


def spot_sums(features: DataFrame, measures: dict[str, Column], by: list[str]) -> DataFrame:
    """Features at one position (and of one group) as one row; every measure is a sum or a count."""
    return features.groupBy("f_lng", "f_lat", *by).agg(*[c.alias(n) for n, c in measures.items()])


def grid_for(spots: DataFrame, reach: float) -> tuple[float, int]:
    """Cell width at which a cell holds a few spots, and the number of levels that a shape of this half width needs."""
    s = spots.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("f_lng", "f_lat") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    area = max((s["hi_f_lng"] or 0.0) - (s["lo_f_lng"] or 0.0), 1e-9) * max((s["hi_f_lat"] or 0.0) - (s["lo_f_lat"] or 0.0), 1e-9)
    cell = float(np.clip(np.sqrt(area * SPOTS_A_CELL / max(s["n"], 1)), reach / FINEST, reach / COARSEST))
    return cell, int(np.floor(np.log2(max(reach / cell, 1.0))))


_EDGE = pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SHAPES_A_STEP):
            yield batch.slice(start, SHAPES_A_STEP)


def _listed(schema: pa.Schema, key: pa.Array, counts: list[int], found: list, edges: pa.Array | None) -> pa.RecordBatch:
    row = np.repeat(np.arange(len(counts)), counts)
    level, column, place = (np.concatenate(parts) if parts else np.empty(0, np.int64) for parts in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    columns = [key.take(pa.array(row)), pa.array(level, pa.int32()), pa.array(column, pa.int64()), pa.array(place, pa.int64())]
    return pa.RecordBatch.from_arrays(columns + ([edges] if edges is not None else []), schema=schema)


def _cut_disks(key_type: pa.DataType, metric: str, cell: float, levels: int):
    schema = pa.schema([("_shape", key_type), ("_level", pa.int32()), ("_cx", pa.int64()), ("_cy", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("lng", "lat", "_dx", "_dy", "_radius")))
            found = [squares(*disk_cells(x, y, (dx, dy), radius, metric, cell), levels) for x, y, dx, dy, radius in rows]
            yield _listed(schema, batch.column("_shape"), [len(f[0]) for f in found], found, None)

    return run


def _cut_polygons(key_type: pa.DataType, cell: float, levels: int, radius: float | None = None, upright: bool = False):
    """Boundary cells carry the edges that a ray to the east from inside the cell can meet. With a radius, cells near
    the boundary count as boundary cells and carry the edges near them, too. With ``upright`` they carry the edges that reach into their longitudes instead."""
    schema = pa.schema([("_shape", key_type), ("_level", pa.int32()), ("_cx", pa.int64()), ("_cy", pa.int64()), ("_edges", pa.list_(_EDGE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            row, *corners = ring_edges(batch.column("rings"))
            known = np.isfinite(corners).all(axis=0)
            row, corners = row[known], [c[known] for c in corners]
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            found, sizes, taken = [], [], []
            for i in range(batch.num_rows):
                mine = slice(first[i], first[i + 1])
                if first[i] == first[i + 1]:
                    found.append((np.empty(0, np.int64),) * 3)
                    continue
                ax, ay, bx, by = (c[mine] for c in corners)
                # A shape too large for the grid starts on squares of a higher level.
                half = max(np.ptp(ax), np.ptp(ay)) / 2.0
                up = max(0, int(np.ceil(np.log2(half / (cell * FINEST))))) if half > 0 else 0
                wide = cell * (1 << up)
                if radius is None:
                    level, column, place = squares(*polygon_cells(ax, ay, bx, by, wide), levels)
                else:
                    n0, m0, state, (edge, near_x, near_y) = polygon_cells_within(ax, ay, bx, by, wide, radius)
                    level, column, place = squares(n0, m0, state, levels)
                south, west = place[:, None] * wide, column[:, None] * wide
                slack = 1e-9
                use = (np.maximum(ay, by) >= south - slack) & (np.minimum(ay, by) <= south + wide + slack) & (np.maximum(ax, bx) >= west - slack) & (level < 0)[:, None]
                if upright:
                    use = (np.maximum(ax, bx) >= west - slack) & (np.minimum(ax, bx) <= west + wide + slack) & (level < 0)[:, None]
                if radius is not None:
                    at, lies = np.full(state.shape, -1), np.flatnonzero(level < 0)
                    at[column[lies] - n0, place[lies] - m0] = lies
                    mine_at = at[near_x - n0, near_y - m0]
                    use[mine_at[mine_at >= 0], edge[mine_at >= 0]] = True
                found.append((np.where(level < 0, -1 - up, level + up), column, place))
                sizes.append(use.sum(axis=1))
                taken.append(first[i] + np.nonzero(use)[1])
            size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
            take = np.concatenate(taken) if taken else np.empty(0, np.int64)
            values = pa.StructArray.from_arrays([pa.array(c[take], pa.float64()) for c in corners], fields=list(_EDGE))
            edges = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), values)
            yield _listed(schema, batch.column("_shape"), [len(f[0]) for f in found], found, edges)

    return run


def _cut_segments(key_type: pa.DataType, cell: float, levels: int, radius: float):
    """What is within the radius of a segment, in squares; boundary cells carry the segment."""
    ends = ("ax", "ay", "bx", "by")
    schema = pa.schema([("_shape", key_type), ("_level", pa.int32()), ("_cx", pa.int64()), ("_cy", pa.int64()), *((c, pa.float64()) for c in ends)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            ax, ay, bx, by = (batch.column(c).to_numpy(zero_copy_only=False) for c in ends)
            half = np.maximum(np.abs(bx - ax), np.abs(by - ay)) / 2.0
            up = np.maximum(0, np.ceil(np.log2(np.maximum(half, cell) / (cell * FINEST)))).astype(int)
            shape, column, row, inside = segment_cells(ax, ay, bx, by, cell * (1 << up), radius)
            level, whole, x, y = merged(shape[inside], column[inside], row[inside], levels)
            near = shape[~inside]
            who = np.concatenate((near, whole))
            lone = pa.array(np.arange(len(who)) >= len(near))
            places = (np.concatenate((-1 - up[near], level + up[whole])), np.concatenate((column[~inside], x)), np.concatenate((row[~inside], y)))
            columns = [batch.column("_shape").take(pa.array(who)), *(pa.array(v, t) for v, t in zip(places, (pa.int32(), pa.int64(), pa.int64())))]
            columns += [pa.array(v[who], pa.float64(), mask=lone.to_numpy(zero_copy_only=False)) for v in (ax, ay, bx, by)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _summed(cut: DataFrame, spots: DataFrame, measures: list[str], by: list[str], key: str, cell: float, levels: int, up: int, inside: Column) -> DataFrame:
    """Join squares with their sums and boundary cells with their spots, and add up per shape.

    Level k >= 0 is a square with its sums, level -1 - k a boundary square of level k; ``up`` is the largest such k.
    """
    column, row = F.floor(F.col("f_lng") / cell).cast("long"), F.floor(F.col("f_lat") / cell).cast("long")
    placed = spots.withColumns({"_sx": column, "_sy": row})

    def squares_of(top: int) -> DataFrame:
        lifted = placed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(top))))
        return lifted.withColumns({"_cx": F.expr("shiftright(_sx, _k)"), "_cy": F.expr("shiftright(_sy, _k)")}).drop("_sx", "_sy")

    sums = squares_of(levels + up).groupBy(F.col("_k").alias("_level"), "_cx", "_cy", *by).agg(*[F.sum(m).alias(m) for m in measures])
    nowhere = F.lit(None).cast("double")
    single = squares_of(up).withColumn("_level", -1 - F.col("_k")).drop("_k")
    right = sums.withColumns({"f_lng": nowhere, "f_lat": nowhere}).unionByName(single)
    met = meet(cut, right, ["_level", "_cx", "_cy"]).filter((F.col("_level") >= 0) | inside)
    return met.groupBy(F.col("_shape").alias(key), *by).agg(*[F.sum(m).alias(m) for m in measures])


def sums_within_radius(points: DataFrame, features: DataFrame, key: str, radius: float, measures: dict[str, Column], metric: Metric = HAVERSINE, by: list[str] | None = None) -> DataFrame:
    """Sums of ``measures`` (sums or counts) over the features within the radius of each point, by group.

    Feature coordinates are ``f_lng, f_lat``; points without a feature give no row. Points at one
    position share one disk.
    """
    by = by or []
    spots = spot_sums(features, measures, by)
    cell, levels = grid_for(spots, metric.typical_reach(radius))
    dx, dy = metric.reach(F.lit(float(radius)), F.col("lat"))
    # Dealt out before the distinct: Spark drops a repartition by the same columns after it, and coalesces.
    disks = spread(points.select("lng", "lat"), "lng", "lat").distinct().withColumn("_shape", F.struct("lng", "lat"))
    sized = disks.select("_shape", "lng", "lat", dx.alias("_dx"), dy.alias("_dy"), F.lit(float(radius)).alias("_radius"))
    key_type = pa.struct([("lng", pa.float64()), ("lat", pa.float64())])
    cut = sized.mapInArrow(_cut_disks(key_type, metric.name, cell, levels), "_shape struct<lng:double,lat:double>, _level int, _cx long, _cy long")
    inside = metric.distance("_shape.lng", "_shape.lat", "f_lng", "f_lat") <= float(radius)
    found = _summed(cut, spots, list(measures), by, "_at", cell, levels, 0, inside)
    at = points.select(key, F.struct("lng", "lat").alias("_at"))
    return at.join(found, "_at").drop("_at")


def sums_in_polygons(polygons: DataFrame, features: DataFrame, key: str, measures: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Sums of ``measures`` over the features inside each polygon (rings and box), by group; even-odd, half-open edges.

    ``key`` is one column, a struct for several; polygons without a feature give no row.
    """
    by = by or []
    spots = spot_sums(features, measures, by)
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2.0
    size = polygons.agg(F.sqrt(F.avg(half * half)).alias("usual"), F.max(half).alias("largest")).first()
    cell, levels = grid_for(spots, float(size["usual"] or 1.0))
    up = max(0, math.ceil(math.log2(max(size["largest"] or 0.0, cell) / (cell * FINEST))))
    shapes = polygons.select(F.col(key).alias("_shape"), "rings")
    kind = shapes.schema["_shape"].dataType
    edge = "array<struct<ax:double,ay:double,bx:double,by:double>>"
    cut = spread(shapes, "_shape").mapInArrow(_cut_polygons(to_arrow_type(kind), cell, levels), f"_shape {kind.simpleString()}, _level int, _cx long, _cy long, _edges {edge}")
    return _summed(cut, spots, list(measures), by, key, cell, levels, up, geo.odd_crossings("_edges", "f_lng", "f_lat"))


def radius_count(points: DataFrame, features: DataFrame, key: str, radius: float, metric: Metric = HAVERSINE, name: str = "n") -> DataFrame:
    """Count of features within the radius of each point; 0 when none."""
    found = sums_within_radius(points, features, key, radius, {name: F.count(F.lit(1))}, metric)
    return points.join(found, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def held_by(
    points: DataFrame, polygons: DataFrame, key: str, aggs: dict[str, tuple[Column, Callable[[str], Column]]], usual: float, by: list[str] | None = None, adds: Column | None = None,
    radius: float | None = None,
) -> DataFrame:
    """Aggregates per point (and value of the polygon columns ``by``) over the polygons (rings and box) that hold it; points in none give no row.

    ``aggs`` gives for each name the aggregate over polygon columns and the one that puts partial
    results together, such as ``(F.count(F.lit(1)), F.sum)``. A polygon is cut into the largest
    squares inside it and boundary cells. Squares at one place are aggregated before they meet points, so a
    point takes one row a level from them, and is tested only against the polygons whose boundary is near.
    ``usual`` is the width of a usual polygon.

    Where the polygons that fill a cell may settle the aggregate (a least value, a flag), ``adds`` says whether a polygon
    can still change it, from its columns and the struct ``_whole`` of the aggregates of those (null without any): others
    are left out of the cell. Few remain however many overlap, so the cells are wide, and needn't follow the points. Not to be used with ``by``.

    With a ``radius`` in metres, polygons count whose boundary is that near, too; ``aggs`` may use ``dist``, the distance from the boundary, which is 0
    for those that hold the point, and ``contains_point``.
    """
    by = by or []
    first = [c.alias(n) for n, (c, _) in aggs.items()]
    merged = [merge(n).alias(n) for n, (_, merge) in aggs.items()]
    if adds is not None:
        at, cut, levels, up = _cut_holders(points, polygons, key, *wide_grid(usual, radius), radius)
        squares = _whole(cut, radius).groupBy(*PLACE).agg(*first)
        whole = _filled(at(up).select(*PLACE).distinct(), squares, levels + up, list(aggs), merged)
        edges = cut.filter("_level < 0").withColumn("_level", -1 - F.col("_level")).select(*PLACE, "_shape.*", "_edges")
        left = meet(edges, whole, PLACE).filter(adds).drop("_whole")
        tested = _tested(meet(at(up), left, PLACE), radius)
        filled = meet(at(0).select(key, *PLACE), whole.filter("_level = 0 AND _whole IS NOT NULL"), PLACE).select(key, "_whole.*")
        return filled.unionByName(tested.groupBy(key).agg(*first)).groupBy(key).agg(*merged)
    at, squares, tested = _holders(points, polygons, key, usual, radius)
    whole = meet(at, squares.groupBy(*PLACE, *by).agg(*first), PLACE).select(key, *by, *aggs)
    return whole.unionByName(tested.groupBy(key, *by).agg(*first)).groupBy(key, *by).agg(*merged)


def _filled(cells: DataFrame, squares: DataFrame, top: int, names: list[str], merged: list[Column]) -> DataFrame:
    """Each cell with ``_whole``, the aggregates of all squares that it lies in; null without any."""
    above = cells.withColumn("_l", F.explode(F.sequence(F.col("_level"), F.lit(top)))).withColumns({"_x": F.expr("shiftright(_cx, _l - _level)"), "_y": F.expr("shiftright(_cy, _l - _level)")})
    over = squares.withColumnsRenamed({"_level": "_l", "_cx": "_x", "_cy": "_y"}).withColumn("_in", F.lit(True))
    return meet(above, over, ["_l", "_x", "_y"], "left").groupBy(*PLACE).agg(*merged, F.count_if("_in").alias("_n")).select(*PLACE, F.when(F.col("_n") > 0, F.struct(*names)).alias("_whole"))


def first_holders(points: DataFrame, polygons: DataFrame, key: str, by: list[str], order: str, k: int, usual: float) -> DataFrame:
    """The k polygons of least ``order`` that hold each point, for each value of ``by``, with their ``rank``.

    Of the squares at one place only the k first meet points.
    """
    at, squares, tested = _holders(points, polygons, key, usual)
    few = top_k_per_key(squares.select(*PLACE, *by, order), [*PLACE, *by], [F.col(order)], k).drop("rank")
    every = meet(at, few, PLACE).select(key, *by, order).unionByName(tested.select(key, *by, order))
    return top_k_per_key(every, [key, *by], [F.col(order)], k)


def first_near(points: DataFrame, polygons: DataFrame, key: str, attrs: list[str], order: list[Column], k: int, usual: float, radius: float) -> DataFrame:
    """The k first polygons, by ``order``, of those that hold each point or whose boundary is within the radius, with ``dist``, ``contains_point`` and ``rank``.

    ``order`` tells polygons apart, may use ``dist`` and grows with it. In a cell that k polygons fill, boundaries are left out that come after them even at distance 0.
    """
    at, cut, levels, up = _cut_holders(points, polygons.select(*attrs, "rings", "x0", "y0", "x1", "y1"), key, *wide_grid(usual, radius), radius)
    found = [*attrs, "contains_point", "dist"]
    squares = top_k_per_key(_whole(cut, radius), PLACE, order, k).drop("rank")
    above = at(up).select(*PLACE).distinct().withColumn("_l", F.explode(F.sequence(F.col("_level"), F.lit(levels + up))))
    above = above.withColumns({"_x": F.expr("shiftright(_cx, _l - _level)"), "_y": F.expr("shiftright(_cy, _l - _level)")})
    over = squares.withColumnsRenamed({"_level": "_l", "_cx": "_x", "_cy": "_y"})
    whole = top_k_per_key(meet(above, over, ["_l", "_x", "_y"]).drop("_l", "_x", "_y"), PLACE, order, k).drop("rank").withColumn("_edges", F.lit(None).cast(cut.schema["_edges"].dataType))
    edges = cut.filter("_level < 0").withColumn("_level", -1 - F.col("_level")).select(*PLACE, "_shape.*", "_edges").withColumns({"contains_point": F.lit(False), "dist": F.lit(0.0)})
    before = F.count_if("contains_point").over(Window.partitionBy(*PLACE).orderBy(*order, "contains_point"))
    left = whole.select(*PLACE, *found, "_edges").unionByName(edges.select(*PLACE, *found, "_edges")).withColumn("_n", before).filter(~F.col("contains_point") & (F.col("_n") < k))
    tested = _tested(meet(at(up), left.drop("_n", "contains_point", "dist"), PLACE), radius)
    filled = meet(at(0).select(key, *PLACE), whole.filter("_level = 0"), PLACE)
    return top_k_per_key(filled.select(key, *found).unionByName(tested.select(key, *found)), [key], order, k)


PLACE = ["_level", "_cx", "_cy"]


def wide_grid(usual: float, radius: float | None = None) -> tuple[float, int]:
    """Cells and levels where few boundaries are left in a cell, so that it needn't follow the points."""
    return (usual / 2.0 + HAVERSINE.typical_reach(radius or 0.0)) / COARSEST, int(math.log2(COARSEST))


def _placed(points: DataFrame, key: str, cell: float, radius: float | None) -> Callable[[int], DataFrame]:
    """The points in their squares of all levels up to one."""
    slim = points.select(key, F.col("lng").alias("f_lng"), F.col("lat").alias("f_lat"))
    slim = slim if radius is None else slim.withColumn("_kx", geo.metres_per_lng_degree("f_lat"))
    placed = slim.withColumns({"_sx": F.floor(F.col("f_lng") / cell).cast("long"), "_sy": F.floor(F.col("f_lat") / cell).cast("long")})

    def at(top: int) -> DataFrame:
        lifted = placed.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top))))
        return lifted.withColumns({"_cx": F.expr("shiftright(_sx, _level)"), "_cy": F.expr("shiftright(_sy, _level)")}).drop("_sx", "_sy")

    return at


def cut_shapes(polygons: DataFrame, cell: float, levels: int, radius: float | None = None, upright: bool = False) -> tuple[DataFrame, int]:
    """Polygons (rings and box) cut into squares and boundary cells, with their other columns in ``_shape``, and the largest level of boundary squares."""
    attrs = [c for c in polygons.columns if c not in ("rings", "x0", "y0", "x1", "y1")]
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2.0
    largest = polygons.agg(F.max(half).alias("largest")).first()["largest"]
    up = max(0, math.ceil(math.log2(max(largest or 0.0, cell) / (cell * FINEST))))
    shapes = polygons.select(F.struct(F.lit(0).alias("_"), *attrs).alias("_shape"), "rings")
    kind = shapes.schema["_shape"].dataType
    edge = "array<struct<ax:double,ay:double,bx:double,by:double>>"
    # Dealt out by shape: copies of one would fall to one task by its columns.
    cut = spread(shapes).mapInArrow(_cut_polygons(to_arrow_type(kind), cell, levels, radius, upright), f"_shape {kind.simpleString()}, _level int, _cx long, _cy long, _edges {edge}")
    return cut, up


def _cut_holders(points: DataFrame, polygons: DataFrame, key: str, cell: float, levels: int, radius: float | None = None) -> tuple[Callable[[int], DataFrame], DataFrame, int, int]:
    """The points in their squares of all levels up to one, the cut polygons, the levels of their squares, and the largest level of boundary squares."""
    cut, up = cut_shapes(polygons, cell, levels, radius)
    return _placed(points, key, cell, radius), cut, levels, up


def _whole(cut: DataFrame, radius: float | None) -> DataFrame:
    """The squares inside each polygon."""
    whole = cut.filter("_level >= 0").select(*PLACE, "_shape.*")
    return whole if radius is None else whole.withColumns({"contains_point": F.lit(True), "dist": F.lit(0.0)})


def _tested(met: DataFrame, radius: float | None) -> DataFrame:
    """Points met with boundary cells: those inside the polygon, or no farther from its boundary than the radius."""
    if radius is None:
        return met.filter(geo.odd_crossings("_edges", "f_lng", "f_lat"))
    test = met.withColumn("_t", point_test("_edges", "f_lng", "f_lat", "_kx"))
    return test.filter(F.col("_t.dist") <= radius).withColumns({"contains_point": F.col("_t.contains_point"), "dist": F.col("_t.dist")}).drop("_t")


def _holders(points: DataFrame, polygons: DataFrame, key: str, usual: float, radius: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The squares that each point lies in, the squares inside each polygon, and the points tested to be in a polygon whose boundary is near."""
    slim = points.select(F.col("lng").alias("f_lng"), F.col("lat").alias("f_lat"))
    at, cut, levels, up = _cut_holders(points, polygons, key, *grid_for(slim, usual / 2.0 + HAVERSINE.typical_reach(radius or 0.0)), radius)
    near = _tested(meet(at(up).withColumn("_level", -1 - F.col("_level")), cut.filter("_level < 0"), PLACE), radius)
    return at(levels + up).select(key, *PLACE), _whole(cut, radius), near.select(key, "_shape.*", *([] if radius is None else ["contains_point", "dist"]))


def segments_near(points: DataFrame, segments: DataFrame, key: str, radius: float, by: list[str]) -> DataFrame:
    """The number ``n`` of segments (ax, ay, bx, by) within the radius of each point, for each value of ``by``; points without one give no row.

    What is within the radius of a segment is cut into squares, which are counted per place, and boundary cells, where points are tested.
    """
    ends = ("ax", "ay", "bx", "by")
    side = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / 2.0
    size = segments.agg(F.sqrt(F.avg(side * side)).alias("usual"), F.max(side).alias("largest")).first()
    slim = points.select(F.col("lng").alias("f_lng"), F.col("lat").alias("f_lat"))
    cell, levels = grid_for(slim, (size["usual"] or 0.0) + HAVERSINE.typical_reach(radius))
    up = max(0, math.ceil(math.log2(max(size["largest"] or 0.0, cell) / (cell * FINEST))))
    known = segments.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ends))
    shapes = known.select(F.struct(F.lit(0).alias("_"), *by).alias("_shape"), *ends)
    kind = shapes.schema["_shape"].dataType
    cut = spread(shapes).mapInArrow(_cut_segments(to_arrow_type(kind), cell, levels, radius), f"_shape {kind.simpleString()}, _level int, _cx long, _cy long, " + ", ".join(f"{c} double" for c in ends))
    at = _placed(points, key, cell, radius)
    count = F.count(F.lit(1)).alias("n")
    squares = cut.filter("_level >= 0").select(*PLACE, "_shape.*").groupBy(*PLACE, *by).agg(count)
    whole = meet(at(levels + up), squares, PLACE).select(key, *by, "n")
    met = meet(at(up).withColumn("_level", -1 - F.col("_level")), cut.filter("_level < 0"), PLACE)
    tested = met.filter(geo.segment_distance_m("f_lng", "f_lat", *ends, "_kx") <= radius).select(key, "_shape.*")
    return whole.unionByName(tested.groupBy(key, *by).agg(count)).groupBy(key, *by).agg(F.sum("n").alias("n"))
