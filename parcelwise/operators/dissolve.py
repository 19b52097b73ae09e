"""Dissolving a coverage: members of a group become the rings of their union.

Members of a group may share boundaries but no area (copies of a member count once). An edge
that two members share is met in opposite directions; such edges cancel in one aggregate.
What is left is the boundary of the union, every edge with the inside on its left. Rings come
out by pointer doubling: every round an edge looks twice as far ahead, so a ring of n edges
takes about log2(n) rounds, each a join of equal size on written tables. No group, and no ring,
is gathered into one row. Rows without a group take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage
from . import spatial as X

ENDS = ("ax", "ay", "bx", "by")
#: How far off an edge, in parts of its length, a vertex may lie and still split it.
OFF_EDGE = 1e-12


def _edges(polygons: DataFrame, group: str) -> DataFrame:
    """Edges of distinct members with the inside on the left."""
    members = polygons.filter(F.col(group).isNotNull()).select(group, geo.oriented("rings").alias("rings")).distinct()
    return members.select(group, F.explode(geo.ring_edges("rings")).alias("_e")).select(group, "_e.*").filter("ax <> bx OR ay <> by")


def split_at_vertices(edges: DataFrame, group: str) -> DataFrame:
    """Cut edges where a vertex of the same group lies on them, so that shared stretches become equal edges."""
    vertices = edges.select(group, F.col("ax").alias("vx"), F.col("ay").alias("vy")).distinct()
    boxed = edges.withColumns({"x0": F.least("ax", "bx"), "y0": F.least("ay", "by"), "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by")})
    cell = X.suggest_cell(boxed)
    left, right = X.own_cell(vertices, cell, "vx", "vy"), X.cover_cells(boxed, cell, *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = dx * dx + dy * dy
    t = ((F.col("vx") - F.col("ax")) * dx + (F.col("vy") - F.col("ay")) * dy) / size
    off = F.abs(dx * (F.col("vy") - F.col("ay")) - dy * (F.col("vx") - F.col("ax"))) / size
    on = X.meet(left, right, [group, *X.CELL]).withColumn("_t", t).filter((F.col("_t") > 0) & (F.col("_t") < 1) & (off <= OFF_EDGE))
    on = on.filter(~((F.col("vx") == F.col("ax")) & (F.col("vy") == F.col("ay")))).filter(~((F.col("vx") == F.col("bx")) & (F.col("vy") == F.col("by"))))
    cuts = on.groupBy(group, *ENDS).agg(F.array_sort(F.collect_list(F.struct(F.col("_t"), F.col("vx").alias("x"), F.col("vy").alias("y")))).alias("_cuts"))
    stops = F.concat(
        F.array(geo.point("ax", "ay")), F.coalesce(F.transform("_cuts", lambda c: geo.point(c["x"], c["y"])), F.array().cast("array<struct<x:double,y:double>>")), F.array(geo.point("bx", "by"))
    )
    parts = edges.join(cuts, [group, *ENDS], "left").withColumn("_s", stops)
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.size("_s") - 1), lambda i: F.struct(F.col("_s")[i - 1].alias("a"), F.col("_s")[i].alias("b"))))
    return parts.select(group, pairs.alias("_p")).select(group, F.col("_p.a.x").alias("ax"), F.col("_p.a.y").alias("ay"), F.col("_p.b.x").alias("bx"), F.col("_p.b.y").alias("by"))


def boundary_edges(polygons: DataFrame, group: str) -> DataFrame:
    """Edges of the union of each group: those whose opposite no other member has."""
    parts = split_at_vertices(_edges(polygons, group), group)
    forward = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    ends = {"px": pick("ax", "bx"), "py": pick("ay", "by"), "qx": pick("bx", "ax"), "qy": pick("by", "ay")}
    net = parts.select(group, *[c.alias(n) for n, c in ends.items()], F.when(forward, 1).otherwise(-1).alias("way")).groupBy(group, *ends).agg(F.sum("way").alias("net"))
    left = net.filter("net <> 0")
    turn = lambda a, b: F.when(F.col("net") > 0, F.col(a)).otherwise(F.col(b))
    return left.select(group, turn("px", "qx").alias("ax"), turn("py", "qy").alias("ay"), turn("qx", "px").alias("bx"), turn("qy", "py").alias("by"))


def _successors(edges: DataFrame, group: str) -> DataFrame:
    """Each edge with the edge that follows it: where several begin at its end, the one that turns left most."""
    after = edges.select(group, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"), F.col("edge").alias("next"))
    met = edges.join(after, [group, "bx", "by"])
    ux, uy, vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("bx"), F.col("cy") - F.col("by")
    left = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    return met.groupBy("edge").agg(F.max_by("next", F.struct(left, "next")).alias("next"))


def dissolve(polygons: DataFrame, group: str) -> DataFrame:
    """Rings of the union of each group in long form: group, ring, place, ax, ay, bx, by.

    The ring is named by its first edge; ``place`` counts from 0 along it. Shells run
    counter-clockwise, holes clockwise; rings that touch in a point stay apart.
    """
    found = boundary_edges(polygons, group)
    edges = cut_lineage(found.withColumn("edge", F.sha2(F.concat_ws("|", F.col(group).cast("string"), *ENDS), 256)))
    links = cut_lineage(_successors(edges, group))
    # Smallest edge of every ring: each round looks twice as far.
    state = links.withColumn("ring", F.least("edge", "next"))
    state = _doubled(state, lambda own, far: F.least(own, far), "ring")
    rings = state.select("edge", "ring")
    # Steps to the ring's last edge, whose successor is the first one: counted by doubling from there.
    ends = links.join(rings, "edge").select("edge", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), "ring")
    ranked = ends.withColumn("steps", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long"))
    ranked = _doubled(ranked, lambda own, far: own + F.coalesce(far, F.lit(0)), "steps", ends=True)
    length = ranked.groupBy("ring").agg(F.max("steps").alias("last"))
    placed = ranked.join(length, "ring").select("edge", "ring", (F.col("last") - F.col("steps")).alias("place"))
    return edges.join(placed, "edge").select(group, "ring", "place", *ENDS)


def _doubled(state: DataFrame, merge, value: str, ends: bool = False) -> DataFrame:
    """Repeat (next, value) <- (next of next, merge(value, value of next)) until nothing changes."""
    known = None
    while True:
        far = state.select(F.col("edge").alias("next"), F.col("next").alias("_next"), F.col(value).alias("_far"))
        keep = [c for c in state.columns if c not in ("next", value)]
        joined = state.join(far, "next", "left")
        state = cut_lineage(joined.select(*keep, F.col("_next").alias("next"), merge(F.col(value), F.col("_far")).alias(value)))
        if ends:
            if state.filter("next IS NOT NULL").isEmpty():
                return state
        else:
            digest = state.agg(F.sum(F.pmod(F.xxhash64("edge", value), F.lit(1 << 31))), F.countDistinct(value)).first()
            if digest == known:
                return state
            known = digest


def dissolve_summary(polygons: DataFrame, group: str) -> DataFrame:
    """Members, rings, extent, perimeter (degrees) and area (square degrees) of each group's union."""
    members = polygons.select(group, "rings").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    rings = dissolve(polygons, group)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    shape = rings.groupBy(group).agg(
        F.countDistinct("ring").alias("rings"),
        *[f(c).alias(n) for n, f, c in (("x0", F.min, "ax"), ("y0", F.min, "ay"), ("x1", F.max, "ax"), ("y1", F.max, "ay"))],
        F.sum(F.sqrt(dx * dx + dy * dy)).alias("perimeter_deg"),
        F.sum((F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2.0).alias("area_deg2"),
    )
    return members.join(shape, group)
