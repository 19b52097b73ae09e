"""Polygon overlap, boundary distance, cover and box operators."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, geo
from ..functions.clip import edge_lists
from ..functions.sweep import union_pieces
from . import counts
from . import spatial as X

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOX = ("x0", "y0", "x1", "y1")
#: Features of one sweep, on average; a cell with more is cut into a lattice of windows.
FEATURES_A_SWEEP = 64


# ── overlap ─────────────────────────────────────────────────────────────────
def _as_side(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"b_{c}") for c in ("rings", *BOX)])


def same_shapes(layer: DataFrame, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Features of one shape (and of equal ``by``) as one row, so that copies are measured once."""
    return layer.groupBy(*by, "rings", *BOX).agg(*[c.alias(n) for n, c in aggs.items()])


def _meeting(pairs: DataFrame) -> DataFrame:
    """Candidate pairs that share at least a point, with ``_common``: area and centroid of the common part."""
    return pairs.withColumn("_common", clip.overlap_parts("rings", "b_rings")).filter("_common.meets")


def overlap_fractions(rings: DataFrame, areas: DataFrame, key: str, keep: list[str], cell: float) -> DataFrame:
    """Intersecting pairs with ``frac``, the share of each area the ring covers."""
    sized = areas.withColumn("_area", geo.polygon_area_deg2("rings"))
    pairs = X.boxes_meeting(rings.select(key, "rings", *BOX), _as_side(sized, [*keep, "_area"]), cell)
    share = F.coalesce(F.try_divide(F.col("_common.area"), F.col("_area")), F.lit(0.0))
    return _meeting(pairs).select(key, *keep, F.least(F.lit(1.0), share).alias("frac"))


def areal_rollup(rings: DataFrame, tracts: DataFrame, key: str, cell: float) -> DataFrame:
    """Population, households, age band and jobs by overlapped share; income is
    population-weighted over tracts that publish one.

    Tracts of one shape share their fraction, so their measures are added up first.
    """
    people = F.coalesce(F.col("population"), F.lit(0.0))
    known = F.col("median_income").isNotNull() & (people > 0)
    shares = ("population", "households", "age_18_34", "jobs")
    measures = {m: F.sum(F.coalesce(F.col(m), F.lit(0.0))) for m in shares}
    measures |= {"_n": F.count(F.lit(1)), "_earned": F.sum(F.when(known, F.col("median_income") * people)), "_earners": F.sum(F.when(known, people))}
    w = overlap_fractions(rings, same_shapes(tracts, [], measures), key, list(measures), cell)
    part = lambda m: F.sum(F.col(m) * F.col("frac"))
    return w.groupBy(key).agg(
        F.sum("_n").alias("tracts_intersected"),
        *[part(m).alias(m) for m in shares],
        F.try_divide(part("_earned"), part("_earners")).alias("median_income"),
    )


def overlap_moments(a: DataFrame, b: DataFrame, keep_a: list[str], keep_b: list[str], cell: float) -> DataFrame:
    """Intersecting pairs: share of ``a`` inside ``b``, and the centroid of the common part
    (``c_lng``, ``c_lat``; null where the polygons only touch)."""
    sized = a.select(*keep_a, "rings", *BOX, geo.polygon_area_deg2("rings").alias("_area"))
    met = _meeting(X.boxes_meeting(sized, _as_side(b, keep_b), cell))
    share = F.try_divide(F.col("_common.area"), F.col("_area"))
    return met.select(*keep_a, *keep_b, share.alias("overlap"), F.col("_common.lng").alias("c_lng"), F.col("_common.lat").alias("c_lat"))


def summed_overlap(parcels: DataFrame, layer: DataFrame, key: str, cell: float) -> DataFrame:
    """Σ overlap area (square degrees) per parcel; overlapping features count each."""
    shapes = same_shapes(layer, [], {"_n": F.count(F.lit(1))})
    pairs = X.boxes_meeting(parcels.select(key, "rings", *BOX), _as_side(shapes, ["_n"]), cell)
    area = clip.overlap_area("rings", "b_rings") * F.col("_n")
    return pairs.select(key, area.alias("_a")).groupBy(key).agg(F.sum("_a").alias("area_deg2"))


_RINGS = "array<array<struct<x:double,y:double>>>"


def _sweep(kind: str):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        one = rows.slice(0, 1)
        window = tuple(one.column(c)[0].as_py() for c in ("_w", "_s", "_e", "_n"))
        area, found = union_pieces(window, *edge_lists(rows.column("_edges").combine_chunks()))
        west, east, low_w, high_w, low_e, high_e = found.T
        x, y = np.stack((west, east, east, west, west), axis=1).ravel(), np.stack((low_w, low_e, high_e, high_w, low_w), axis=1).ravel()
        points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
        rings = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, 5), pa.int32()), points)
        pieces = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), rings)
        return pa.table({kind: one.column(kind), "_cx": one.column("_cx"), "_cy": one.column("_cy"), "_area": [area], "_pieces": pieces})

    return run


def _leaves(squares: DataFrame) -> DataFrame:
    """Squares of any level as cells."""
    side = F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, _level) - 1"))
    cells = squares.withColumn("_i", F.explode(side)).withColumn("_j", F.explode(side))
    return cells.withColumns({"_cx": F.expr("shiftleft(_cx, _level) + _i"), "_cy": F.expr("shiftleft(_cy, _level) + _j")}).drop("_level", "_i", "_j")


def _union_cells(shapes: DataFrame, kind: str, width: float, levels: int) -> DataFrame:
    """The union of the shapes of a kind in each cell: its area, and the polygons without overlap that make it up.

    A cell that a shape fills needs no other. Else the boundaries in it are swept, once for all parcels; a cell with many is
    divided into windows.
    """
    cut, _ = counts.cut_shapes(shapes, width, levels, upright=True)
    filled = _leaves(cut.filter("_level >= 0").select("_level", *X.CELL, F.col(f"_shape.{kind}").alias(kind))).distinct()
    edges = _leaves(cut.filter("_level < 0").select((-1 - F.col("_level")).alias("_level"), *X.CELL, F.col(f"_shape.{kind}").alias(kind), *[F.col(f"_shape._{c}").alias(c) for c in BOX], "_edges"))
    left = X.meet(edges, filled, [kind, *X.CELL], "left_anti")
    count = F.count(F.lit(1)).over(Window.partitionBy(kind, *X.CELL))
    west, south = F.col("_cx") * width, F.col("_cy") * width
    many = left.withColumn("_k", F.ceil(F.sqrt(count / FEATURES_A_SWEEP)).cast("int"))

    def windows(start: Column, stop: Column, low: Column) -> Column:
        place = lambda v: F.least(F.greatest(F.floor((v - low) / width * F.col("_k")).cast("int"), F.lit(0)), F.col("_k") - 1)
        return F.explode(F.sequence(place(start), place(stop)))

    many = many.withColumn("_px", windows(F.col("x0"), F.col("x1"), west)).withColumn("_py", windows(F.col("y0"), F.col("y1"), south))
    edge = lambda low, p: low + p * width / F.col("_k")
    many = many.select(
        kind, *X.CELL, "_px", "_py", "_edges", edge(west, F.col("_px")).alias("_w"), edge(south, F.col("_py")).alias("_s"),
        edge(west, F.col("_px") + 1).alias("_e"), edge(south, F.col("_py") + 1).alias("_n"),
    )
    schema = f"{kind} {shapes.schema[kind].dataType.simpleString()}, _cx long, _cy long, _area double, _pieces {_RINGS}"
    swept = many.groupBy(kind, *X.CELL, "_px", "_py").applyInArrow(_sweep(kind), schema).filter("_area > 0")
    box = geo.box_rings(west, south, west + width, south + width)
    return filled.select(kind, *X.CELL, F.lit(width * width).alias("_area"), box.alias("_pieces")).unionByName(swept)


def union_cover(parcels: DataFrame, layer: DataFrame, key: str, kind: str, cell: float) -> DataFrame:
    """Exact area (square degrees) of each parcel under the union of the features of a kind.

    ``parcels`` has rings and box, ``cell`` is the width of a usual feature. Features are united per grid cell, once for all parcels. A parcel is cut
    into squares inside it, which take the sums of their cells, and boundary cells, whose part of the union is measured
    as a pair. So no parcel meets a feature, however many lie over it. Parcels without cover give no row.
    """
    width, levels = counts.wide_grid(cell)
    shapes = layer.filter(F.col(kind).isNotNull()).select(kind, "rings", *BOX).distinct().withColumns({f"_{c}": F.col(c) for c in BOX})
    own = parcels.filter(F.col(key).isNotNull()).filter("x1 > x0 AND y1 > y0").select(key, "rings", *BOX).distinct()
    cells = _union_cells(shapes, kind, width, levels)
    cut, up = counts.cut_shapes(own, width, levels, upright=True)
    mine = F.col(f"_shape.{key}").alias(key)
    lifted = cells.select(kind, *X.CELL, "_area").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels + up))))
    sums = lifted.groupBy("_level", F.expr("shiftright(_cx, _level)").alias("_cx"), F.expr("shiftright(_cy, _level)").alias("_cy"), kind).agg(F.sum("_area").alias("_area"))
    whole = X.meet(cut.filter("_level >= 0").select(*counts.PLACE, mine), sums, counts.PLACE).select(key, kind, F.col("_area").alias("area_deg2"))
    edges = _leaves(cut.filter("_level < 0").select((-1 - F.col("_level")).alias("_level"), *X.CELL, mine, "_edges"))
    part = X.meet(edges, cells, X.CELL).select(key, kind, clip.overlap_area("_edges", "_pieces").alias("area_deg2"))
    return whole.unionByName(part).groupBy(key, kind).agg(F.sum("area_deg2").alias("area_deg2")).filter("area_deg2 > 0")


# ── boundaries ──────────────────────────────────────────────────────────────
def boundary_distances(
    points: DataFrame, polygons: DataFrame, key: str, poly_key: str, attrs: list[str], radius_m: float, cell: float
) -> DataFrame:
    """Polygons within the radius of each point: boundary distance, 0 inside."""
    slim = points.select(key, "lng", "lat")
    edges = polygons.select(poly_key, *attrs, F.explode(geo.ring_edges("rings")).alias("_e")).select(
        poly_key, *attrs, "_e.*"
    )
    near = X.lines_within(slim, edges, radius_m).select(
        key, poly_key, *attrs, "dist", F.lit(False).alias("contains_point")
    )
    held = X.points_in_polygons(slim, polygons.select(poly_key, *attrs, "rings", "x0", "y0", "x1", "y1"), cell).select(
        key, poly_key, *attrs, F.lit(0.0).alias("dist"), F.lit(True).alias("contains_point")
    )
    return near.unionByName(held).groupBy(key, poly_key).agg(
        F.min("dist").alias("dist"),
        F.bool_or("contains_point").alias("contains_point"),
        *[F.max(a).alias(a) for a in attrs],
    )


def single_keyed(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key has no other row but copies, once each, and the rows of the other keys (None without any)."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys")).first()
    if size["n"] == size["keys"]:
        return df, None
    rows = df.distinct()
    shared = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key")
    if shared.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(shared, same, "left_anti"), rows.join(shared, same, "left_semi")


def _near_boundaries(points: DataFrame, polygons: DataFrame, key: str, poly_key: str, attrs: list[str], radius_m: float, cell: float, single, listed) -> DataFrame:
    """``single(points, polygons)`` where neither key repeats, and ``listed(pairs)`` of the pairs of the others.

    Rows of one key are one point or polygon: pairs are needed to tell which of them meet.
    """
    at, layer = points.select(key, "lng", "lat"), polygons.select(poly_key, *attrs, "rings", *BOX)
    (lone, many), (own, copies) = single_keyed(at, key), single_keyed(layer, poly_key)
    pairs = [(p, z) for p, z in ((lone, copies), (many, layer)) if p is not None and z is not None]
    out = single(lone, own)
    for p, z in pairs:
        out = out.unionByName(listed(boundary_distances(p, z, key, poly_key, attrs, radius_m, cell)))
    return out


def boundary_counts(points: DataFrame, polygons: DataFrame, key: str, poly_key: str, by: str, radius_m: float, cell: float) -> DataFrame:
    """For each point and value of ``by``: how many polygons (``n``) hold it or have a boundary within the radius, and the distance ``nearest_m`` of the nearest, 0 inside.

    Pairs are aggregated, not listed; points without any give no row. ``cell`` is the width of a usual polygon.
    """
    aggs = {"n": (F.count(F.lit(1)), F.sum), "nearest_m": (F.min("dist"), F.min)}
    out = _near_boundaries(
        points, polygons, key, poly_key, [by], radius_m, cell, lambda p, z: counts.held_by(p, z.drop(poly_key), key, aggs, cell, [by], radius=radius_m),
        lambda pairs: pairs.groupBy(key, by).agg(*[c.alias(n) for n, (c, _) in aggs.items()]),
    )
    return out.groupBy(key, by).agg(*[merge(n).alias(n) for n, (_, merge) in aggs.items()])


def first_boundaries(
    points: DataFrame, polygons: DataFrame, key: str, poly_key: str, attrs: list[str], order: list[Column], radius_m: float, k: int, cell: float
) -> DataFrame:
    """The k first polygons, by ``order``, that hold each point or have a boundary within the radius, with ``dist`` (0 inside), ``contains_point`` and ``rank``.

    ``order`` ends with the polygon's key and grows with ``dist``, if it uses it. Of the polygons that fill a cell only k meet points.
    """
    columns = [key, poly_key, *attrs, "dist", "contains_point"]
    out = _near_boundaries(
        points, polygons, key, poly_key, attrs, radius_m, cell, lambda p, z: counts.first_near(p, z, key, [poly_key, *attrs], order, k, cell, radius_m).select(*columns),
        lambda pairs: pairs.select(*columns),
    )
    return X.top_k_per_key(out, [key], order, k)


def nearest_boundaries(
    points: DataFrame, polygons: DataFrame, key: str, poly_key: str, attrs: list[str], radius_m: float, k: int, cell: float
) -> DataFrame:
    return first_boundaries(points, polygons, key, poly_key, attrs, [F.col("dist"), F.col(poly_key)], radius_m, k, cell)


def holder_or_nearest(points: DataFrame, polygons: DataFrame, key: str, poly_key: str, attrs: list[str], radius_m: float, cell: float) -> DataFrame:
    """The polygon of least key that holds each point, or else the one whose boundary is nearest within the radius; points with neither give no row."""
    hit = lambda away, dist, held: F.struct(away.alias("away"), dist.alias("dist"), poly_key, *attrs, held.alias("contains_point"))
    best = F.min(hit(~F.col("contains_point"), F.col("dist"), F.col("contains_point")))
    adds = F.col("_whole").isNull() | (hit(F.lit(False), F.lit(0.0), F.lit(True)) < F.col("_whole._b"))
    out = _near_boundaries(
        points, polygons, key, poly_key, attrs, radius_m, cell, lambda p, z: counts.held_by(p, z, key, {"_b": (best, F.min)}, cell, adds=adds, radius=radius_m),
        lambda pairs: pairs.groupBy(key).agg(best.alias("_b")),
    )
    return out.groupBy(key).agg(F.min("_b").alias("_b")).select(key, *[f"_b.{c}" for c in (poly_key, *attrs, "dist", "contains_point")])


# ── boxes ──────────────────────────────────────────────────────
def bbox_filter(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Features whose box meets the envelope; plain comparisons push to the scan."""
    if not (west < east and south < north):
        raise ValueError("envelope needs west < east and south < north")
    return df.filter(
        (F.col("x0") <= east) & (F.col("x1") >= west) & (F.col("y0") <= north) & (F.col("y1") >= south)
    )


def first_box(points: DataFrame, boxes: DataFrame, key: str, order: str, name: str, cell: float) -> DataFrame:
    """The first box, by ``order``, that holds the point (edges included)."""
    left = X.own_cell(points.select(key, "lng", "lat"), cell)
    right = X.cover_cells(boxes, cell, *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    held = X.meet(left, right, X.CELL).filter(
        F.col("lng").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    )
    return held.groupBy(key).agg(F.min_by(name, order).alias(name))
