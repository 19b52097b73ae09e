"""Spatial join queries and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geo
from parcelwise.functions import scoring as S
from parcelwise.operators import counts, overlap
from parcelwise.operators import dissolve as D
from parcelwise.operators import spatial as X
from parcelwise.plans import solar as L

from .layers import (
    CROSSES,
    NEAR_ZONE,
    PARCELS,
    ZONE_EDGES,
    ZONE_SHAPES,
    as_features,
    box_polygons,
    hav,
    inside,
    layer,
    parcels,
    strip_areas,
    table,
    with_ctes,
    zone_polygons,
)

ZONE_BOX = ("rings", "x0", "y0", "x1", "y1")
TILE_CELL = 2.9


def zones(spark, sf_dir, *cols):
    z = zone_polygons(spark, sf_dir)
    return z.select(*cols, *ZONE_BOX)


def zone_cell(spark, sf_dir) -> float:
    return X.suggest_cell(zones(spark, sf_dir))


def pip_pairs(spark, sf_dir):
    """Structures inside zones; the largest zone per structure."""
    pts = layer(spark, sf_dir, "structures").select("fd_id", "lng", "lat")
    largest = F.max(F.struct("gis_acres", (-F.col("zone_id")).alias("last")))
    aggs = {"n_zones": (F.count(F.lit(1)), F.sum), "b": (largest, F.max)}
    best = counts.held_by(pts, zones(spark, sf_dir, "zone_id", "gis_acres"), "fd_id", aggs, zone_cell(spark, sf_dir))
    return best.select("fd_id", "n_zones", (-F.col("b.last")).alias("zone_id"), F.col("b.gis_acres").alias("gis_acres"))


def pip_region(spark, sf_dir):
    """The containing tile of every site, with its region."""
    tiles = box_polygons(layer(spark, sf_dir, "tiles")).join(
        table(spark, sf_dir, "region"), F.col("region_id") == F.col("r_regionkey")
    )
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    out = X.first_polygon(sites, tiles, TILE_CELL, "loc_id", "tile_id", ["tile_id", "tile_name", "r_name"])
    return out.select("loc_id", "tile_id", "tile_name", "r_name")


def pip_exists(spark, sf_dir):
    """Three layer flags per site in one join."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    flags = {
        "in_sfha": S.is_sfha("flood_zone"),
        "in_wetland": F.col("kind") == "wetland",
        "in_protected": F.col("kind") == "protected",
    }
    out = X.polygon_flags(
        sites, zones(spark, sf_dir, "flood_zone", "kind"), zone_cell(spark, sf_dir), "loc_id", flags
    )
    return out.select("loc_id", *flags)


def parcel_touches_zone(spark, sf_dir):
    """Square parcels that intersect each kind of zone."""
    sites = layer(spark, sf_dir, "sites").filter(F.col("acreage") > 0)
    half = F.sqrt("acreage") / 50.0
    boxes = sites.select(
        "loc_id", (F.col("lng") - half).alias("x0"), (F.col("lat") - half).alias("y0"),
        (F.col("lng") + half).alias("x1"), (F.col("lat") + half).alias("y1"),
    )
    z = zone_polygons(spark, sf_dir)
    right = z.select("zone_id", "kind", *[F.col(c).alias(f"b_{c}") for c in ZONE_BOX])
    pairs = X.polygons_touching(box_polygons(boxes), right, zone_cell(spark, sf_dir))
    return pairs.groupBy("loc_id").agg(
        F.count(F.lit(1)).alias("n_zones"),
        F.count_if(F.col("kind") == "wetland").alias("n_wetland"),
        F.count_if(F.col("kind") == "protected").alias("n_protected"),
    )


def radius_count(spark, sf_dir):
    """Structures within 60 km of each site (great-circle)."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    feats = as_features(layer(spark, sf_dir, "structures").select("lng", "lat"))
    return counts.radius_count(sites, feats, "loc_id", 60_000.0).select("loc_id", "n")


def radius_count_mercator(spark, sf_dir):
    """J5 in projected metres, as buffers drawn on the web map count."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    feats = as_features(layer(spark, sf_dir, "pois").select("lng", "lat"))
    return counts.radius_count(sites, feats, "loc_id", 80_000.0, geo.MERCATOR).select("loc_id", "n")


def _radius(name):
    return F.when(F.col(name) == "ECONOMY", 90_000.0).when(F.col(name) == "SMALL", 60_000.0).otherwise(30_000.0)


def probe_nearest(spark, sf_dir):
    """Existence and nearest distance with a radius per layer."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    pois = as_features(layer(spark, sf_dir, "pois")).withColumn("radius_m", _radius("layer"))
    # Every site answers for every layer that exists; the layers are a short list of names.
    layers = sorted(r[0] for r in pois.select("layer").distinct().collect())
    asked = sites.withColumn("layer", F.explode(F.array(*map(F.lit, layers))))
    parts = []
    for radius in (90_000.0, 60_000.0, 30_000.0):
        mine = pois.filter(F.col("radius_m") == radius).select("layer", "poi_id", "f_lng", "f_lat")
        n = counts.sums_within_radius(sites, mine, "loc_id", radius, {"n": F.count(F.lit(1))}, by=["layer"])
        first = X.close_pairs(asked.filter(_radius("layer") == radius), mine.select("layer", "f_lng", "f_lat").distinct(), radius, 1, by=["layer"])
        first = first.groupBy("loc_id", "layer").agg(F.round(F.min("dist"), 2).alias("nearest_m"))
        # A key that repeats adds up its rows.
        parts.append(n.groupBy("loc_id", "layer").agg(F.sum("n").alias("n")).join(first, ["loc_id", "layer"], "left"))
    found = reduce(DataFrame.unionByName, parts)
    return asked.join(found, ["loc_id", "layer"], "left").select("loc_id", "layer", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "nearest_m")


def line_distance(spark, sf_dir):
    """Distance to the nearest line segment within 50 km."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    lines = layer(spark, sf_dir, "lines").select("line_id", "ax", "ay", "bx", "by")
    near = X.line_distance_within(sites, lines, "loc_id", "line_id", 50_000.0)
    return sites.join(near, "loc_id", "left").select("loc_id", "line_id", F.round("dist", 2).alias("dist_m"))


def nearest_structure(spark, sf_dir):
    """Structure nearest in degrees, kept when within 500 m."""
    props = layer(spark, sf_dir, "properties").select("property_id", "lng", "lat")
    feats = as_features(layer(spark, sf_dir, "structures").select("fd_id", "occtype", "lng", "lat"))
    out = X.nearest_within(props, feats, "property_id", 500.0, "fd_id", ["occtype"], geo.HAVERSINE, geo.DEGREE)
    return out.select("property_id", "fd_id", "occtype", F.round("dist", 2).alias("dist_m"))


def nearest_unbounded(spark, sf_dir):
    """Nearest substation however far away."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    subs = as_features(layer(spark, sf_dir, "substations").select("sub_id", "voltage", "lng", "lat"))
    out = X.nearest(sites, subs, "loc_id", "sub_id", ["voltage"])
    return out.select("loc_id", "sub_id", "voltage", F.round("dist", 2).alias("dist_m"))


def nearest_degree(spark, sf_dir):
    """J10 ordered by degrees over every structure."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    feats = as_features(layer(spark, sf_dir, "structures").select("fd_id", "lng", "lat"))
    out = X.nearest(sites, feats, "loc_id", "fd_id", [], metric=geo.DEGREE)
    return out.select("loc_id", F.round("dist", 6).alias("dist_deg"))


def nearest_of_layers(spark, sf_dir):
    """Nearest of lines and substations together, however far."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    lines = layer(spark, sf_dir, "lines").select("ax", "ay", "bx", "by")
    subs = layer(spark, sf_dir, "substations").select(
        F.col("lng").alias("ax"), F.col("lat").alias("ay"), F.col("lng").alias("bx"), F.col("lat").alias("by")
    )
    near = X.nearest_line(sites, lines.unionByName(subs).withColumn("_s", F.lit(0)), "loc_id", "_s", [])
    return near.select("loc_id", F.round("dist", 2).alias("grid_m"))


def knearest_poi(spark, sf_dir):
    """Three nearest points of interest within 80 km."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    feats = as_features(layer(spark, sf_dir, "pois").select("poi_id", "poi_name", "lng", "lat"))
    out = X.k_nearest_within(sites, feats, "loc_id", 80_000.0, "poi_id", 3)
    return out.select("loc_id", "rank", "poi_id", "poi_name", F.round("dist", 2).alias("dist_m"))


def nearest_perimeters(spark, sf_dir):
    """Up to ten polygons within 5 miles by boundary distance, 0 inside."""
    props = layer(spark, sf_dir, "properties").select("property_id", "lng", "lat")
    near = overlap.nearest_boundaries(
        props, zones(spark, sf_dir, "zone_id", "year_num"), "property_id", "zone_id", ["year_num"], 8_047.0,
        10, zone_cell(spark, sf_dir),
    )
    return near.select("property_id", "rank", "zone_id", "contains_point", F.round("dist", 2).alias("dist_m"))


def latest_fires(spark, sf_dir):
    """The ten latest perimeters within 5 miles of each property."""
    props = layer(spark, sf_dir, "properties").select("property_id", "lng", "lat")
    order = [F.desc("year_num"), F.col("zone_id")]
    out = overlap.first_boundaries(props, zones(spark, sf_dir, "zone_id", "year_num"), "property_id", "zone_id", ["year_num"], order, 8_047.0, 10, zone_cell(spark, sf_dir))
    return out.select("property_id", "rank", "zone_id", F.round("year_num", 0).alias("fire_year"), F.round("dist", 2).alias("dist_m"))


def perimeter_preferring_containment(spark, sf_dir):
    """One perimeter per property, containing ones first, then the closest."""
    props = layer(spark, sf_dir, "properties").select("property_id", "lng", "lat")
    best = overlap.holder_or_nearest(
        props, zones(spark, sf_dir, "zone_id", "year_num"), "property_id", "zone_id", ["year_num"], 8_047.0,
        zone_cell(spark, sf_dir),
    )
    return best.select("property_id", "zone_id", "contains_point", F.round("year_num", 0).alias("fire_year"))


def radius_capacity(spark, sf_dir):
    """Queue projects within 50 km: counts, megawatts, status mix, usual ISO."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    queue = as_features(layer(spark, sf_dir, "queue").select("lng", "lat", "status", "fuel_type", "iso", "capacity_mw"))
    out = L.queue_context(sites, queue, "loc_id")
    return out.withColumn("solar_mw", F.round("solar_mw", 6))


def largest_projects(spark, sf_dir):
    """The five largest active projects within 50 km of each site, and the megawatts in operation there."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    queue = as_features(layer(spark, sf_dir, "queue").select("queue_id", "lng", "lat", "status", "capacity_mw"))
    out = L.largest_projects(sites, queue, as_features(layer(spark, sf_dir, "plants")), "loc_id")
    return out.select("loc_id", "rank", "queue_id", F.round("capacity_mw", 3).alias("capacity_mw"), F.round("dist", 1).alias("dist_m"), F.round("operating_mw", 3).alias("operating_mw"), "n_operating")


def areal_rollup(spark, sf_dir):
    """Tract measures weighted by the overlapped share of each tract."""
    tracts = box_polygons(layer(spark, sf_dir, "tracts"))
    stores = layer(spark, sf_dir, "stores")
    rings = box_polygons(
        stores.select(
            "loc_id", (F.col("lng") - 0.04).alias("x0"), (F.col("lat") - 0.03).alias("y0"),
            (F.col("lng") + 0.04).alias("x1"), (F.col("lat") + 0.03).alias("y1"),
        )
    )
    out = overlap.areal_rollup(rings, tracts, "loc_id", 0.054)
    return out.select(
        "loc_id", "tracts_intersected", *[F.round(c, 7).alias(c) for c in ("population", "households", "age_18_34", "jobs")],
        F.round("median_income", 2).alias("median_income"),
    )


KINDS = ("habitat", "protected", "wetland")


def union_cover(spark, sf_dir):
    """Acres of each parcel under the union of each zone kind, none included."""
    own = parcels(spark, sf_dir)
    covered = overlap.union_cover(own, zones(spark, sf_dir, "kind"), "loc_id", "kind", zone_cell(spark, sf_dir))
    every = own.select("loc_id", "lat", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    acres = F.coalesce(geo.deg2_to_acres("area_deg2", "lat"), F.lit(0.0))
    return every.join(covered, ["loc_id", "kind"], "left").select("loc_id", "kind", F.round(acres, 2).alias("covered_acres"))


def bbox_layer(spark, sf_dir):
    """zones whose box meets an envelope, as features."""
    z = zone_polygons(spark, sf_dir)
    hit = overlap.bbox_filter(z, -110.0, 30.0, -90.0, 42.0)
    return hit.select("zone_id", "flood_zone", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"))


def dissolve(spark, sf_dir):
    """Tiles of a region merged: members, rings, extent, perimeter and area of the union."""
    out = D.dissolve_summary(box_polygons(layer(spark, sf_dir, "tiles")), "region_id")
    return out.select("region_id", "members", "rings", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "perimeter_deg", "area_deg2")])


def dissolved_rings(spark, sf_dir):
    """Every ring of the merged regions with its corners in order."""
    out = D.dissolve(box_polygons(layer(spark, sf_dir, "tiles")), "region_id")
    first = out.groupBy("region_id", "ring").agg(F.count(F.lit(1)).alias("corners"), F.min_by(F.struct("ax", "ay"), "place").alias("a"), F.max_by(F.struct("bx", "by"), "place").alias("z"))
    closed = (F.col("a.ax") == F.col("z.bx")) & (F.col("a.ay") == F.col("z.by"))
    return first.groupBy("region_id", "corners").agg(F.count(F.lit(1)).alias("rings"), F.bool_and(closed).alias("closed"))


ENRICH_LIMIT = 20


def enrich_layers(spark, sf_dir):
    """Per layer of points the nearest within 60 km, per layer of polygons those that hold the site; limit / layers of each, and how many there are."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    union = as_features(layer(spark, sf_dir, "pois")).select("layer", F.col("poi_id").alias("feature_id"), "f_lng", "f_lat").unionByName(
        as_features(layer(spark, sf_dir, "substations")).select(
            F.lit("SUBSTATION").alias("layer"), F.col("sub_id").alias("feature_id"), "f_lng", "f_lat"
        )
    )
    each = max(1, ENRICH_LIMIT // 10)  # six layers of pois, the substations, three of zones
    found = counts.sums_within_radius(sites, union, "loc_id", 60_000.0, {"n_in_radius": F.count(F.lit(1))}, by=["layer"])
    layers = sorted(r[0] for r in union.select("layer").distinct().filter("layer IS NOT NULL").collect())
    asked = sites.withColumn("layer", F.explode(F.array(*map(F.lit, layers))))
    near = X.k_nearest_within(asked, union, "loc_id", 60_000.0, "feature_id", each, by=["layer"])
    kinds = zones(spark, sf_dir, F.col("zone_id").alias("feature_id"), F.upper("kind").alias("layer"))
    cell = zone_cell(spark, sf_dir)
    total = counts.held_by(sites, kinds, "loc_id", {"n_in_radius": (F.count(F.lit(1)), F.sum)}, cell, by=["layer"])
    inside = counts.first_holders(sites, kinds, "loc_id", ["layer"], "feature_id", each, cell).withColumn("dist", F.lit(0.0))
    columns = ["loc_id", "layer", "rank", "feature_id", F.round("dist", 2).alias("dist_m"), "n_in_radius"]
    return near.join(found, ["loc_id", "layer"]).select(*columns).unionByName(inside.join(total, ["loc_id", "layer"]).select(*columns))


def state_by_box(spark, sf_dir):
    """first box, in declared order, that holds the site."""
    boxes = layer(spark, sf_dir, "tiles").withColumn("ord", 24 - F.col("tile_id")).select(
        "tile_name", "ord", (F.col("x0") - 1.0).alias("x0"), (F.col("y0") - 1.0).alias("y0"),
        (F.col("x1") + 1.0).alias("x1"), (F.col("y1") + 1.0).alias("y1"),
    )
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    return overlap.first_box(sites, boxes, "loc_id", "ord", "tile_name", TILE_CELL).select("loc_id", "tile_name")


QUERIES = {f.__name__: f for f in (
    pip_pairs, pip_region, pip_exists, parcel_touches_zone, radius_count, radius_count_mercator, probe_nearest,
    line_distance, nearest_structure, nearest_unbounded, nearest_degree, nearest_of_layers, knearest_poi,
    nearest_perimeters, latest_fires, perimeter_preferring_containment, radius_capacity, largest_projects, areal_rollup, union_cover, bbox_layer,
    dissolve, dissolved_rings, enrich_layers, state_by_box,
)}

M_PER_DEG = repr(geo.SPHERE_M_PER_DEG)


def segment_sql(p: str, e: str) -> str:
    kx = f"(cos(radians({p}.lat)) * {M_PER_DEG})"
    px, py = f"(({e}.ax - {p}.lng) * {kx})", f"(({e}.ay - {p}.lat) * {M_PER_DEG})"
    dx, dy = f"(({e}.bx - {e}.ax) * {kx})", f"(({e}.by - {e}.ay) * {M_PER_DEG})"
    t = f"greatest(0e0, least(1e0, coalesce(-({px} * {dx} + {py} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0e0), 0e0)))"
    return f"sqrt(pow({px} + {t} * {dx}, 2) + pow({py} + {t} * {dy}, 2))"


BOUNDARY = f"""holds AS (
  SELECT p.property_id, e.zone_id, TRUE AS contains_point FROM properties p JOIN zone_edges e ON {CROSSES}
  GROUP BY ALL HAVING count(*) % 2 = 1),
edge_near AS (
  SELECT p.property_id, e.zone_id, min({segment_sql('p', 'e')}) AS d, any_value(e.year_num) AS year_num
  FROM properties p JOIN zone_edges e ON abs(p.lng - e.x) < 3.2 AND abs(p.lat - e.y) < 3.2
  GROUP BY ALL),
boundary AS (
  SELECT n.property_id, n.zone_id, n.year_num, coalesce(h.contains_point, FALSE) AS contains_point,
    CASE WHEN h.contains_point THEN 0e0 ELSE n.d END AS dist
  FROM edge_near n LEFT JOIN holds h USING (property_id, zone_id) WHERE n.d <= 8047 OR h.contains_point)"""

#: Edges of all tiles that no neighbour of the region has the other way round, and the smallest edge that each can reach.
DISSOLVED = ("tiles", """tile_edges AS (SELECT region_id, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by FROM tiles UNION ALL SELECT region_id, x1, y0, x1, y1 FROM tiles
  UNION ALL SELECT region_id, x1, y1, x0, y1 FROM tiles UNION ALL SELECT region_id, x0, y1, x0, y0 FROM tiles),
outer_edges AS (SELECT row_number() OVER (ORDER BY region_id, e.ax, e.ay, e.bx, e.by) AS id, e.* FROM tile_edges e WHERE NOT EXISTS (
  SELECT 1 FROM tile_edges o WHERE o.region_id = e.region_id AND o.ax = e.bx AND o.ay = e.by AND o.bx = e.ax AND o.by = e.ay)),
followed AS (SELECT e.id, arg_max(n.id, (atan2((e.bx - e.ax) * (n.by - n.ay) - (e.by - e.ay) * (n.bx - n.ax), (e.bx - e.ax) * (n.bx - n.ax) + (e.by - e.ay) * (n.by - n.ay)), n.id)) AS next
  FROM outer_edges e JOIN outer_edges n ON n.region_id = e.region_id AND n.ax = e.bx AND n.ay = e.by GROUP BY e.id),
named AS (WITH RECURSIVE r(id, met) AS (SELECT id, id FROM followed UNION SELECT r.id, f.next FROM r JOIN followed f ON f.id = r.met) SELECT id, min(met) AS ring FROM r GROUP BY id)""")

ORACLES = {
    "pip_pairs": with_ctes("structures", "zones", ZONE_EDGES, inside("structures", "fd_id"), body="""
SELECT fd_id, count(*) AS n_zones, arg_max(zone_id, (gis_acres, -zone_id)) AS zone_id, max(gis_acres) AS gis_acres
FROM zone_hits JOIN zones USING (zone_id) GROUP BY fd_id"""),
    "pip_region": with_ctes("sites", "tiles", body="""
SELECT loc_id, tile_id, tile_name, r_name FROM sites s LEFT JOIN (SELECT * FROM tiles JOIN region ON region_id = r_regionkey) t
ON s.lng >= t.x0 AND s.lng < t.x1 AND s.lat >= t.y0 AND s.lat < t.y1"""),
    "pip_exists": with_ctes("sites", "zones", ZONE_EDGES, inside("sites", "loc_id"), body="""
SELECT loc_id, coalesce(bool_or(flood_zone LIKE 'A%' OR flood_zone LIKE 'V%'), FALSE) AS in_sfha,
  coalesce(bool_or(kind = 'wetland'), FALSE) AS in_wetland, coalesce(bool_or(kind = 'protected'), FALSE) AS in_protected
FROM sites LEFT JOIN zone_hits USING (loc_id) LEFT JOIN zones USING (zone_id) GROUP BY loc_id"""),
    "parcel_touches_zone": with_ctes("sites", "zones", ZONE_EDGES, """boxes AS (
  SELECT loc_id, lng - sqrt(acreage) / 50e0 AS x0, lat - sqrt(acreage) / 50e0 AS y0,
    lng + sqrt(acreage) / 50e0 AS x1, lat + sqrt(acreage) / 50e0 AS y1 FROM sites WHERE acreage > 0),
box_edges AS (
  SELECT loc_id, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by FROM boxes UNION ALL SELECT loc_id, x1, y0, x1, y1 FROM boxes
  UNION ALL SELECT loc_id, x1, y1, x0, y1 FROM boxes UNION ALL SELECT loc_id, x0, y1, x0, y0 FROM boxes),
corners AS (SELECT loc_id, ax AS lng, ay AS lat FROM box_edges)""", f"""touching AS (
  SELECT b.loc_id, e.zone_id FROM boxes b JOIN zone_edges e ON e.ax BETWEEN b.x0 AND b.x1 AND e.ay BETWEEN b.y0 AND b.y1
  UNION SELECT loc_id, zone_id FROM (
    SELECT p.loc_id, p.lng, p.lat, e.zone_id FROM corners p JOIN zone_edges e ON {CROSSES} GROUP BY ALL HAVING count(*) % 2 = 1)
  UNION SELECT loc_id, zone_id FROM (
    SELECT b.loc_id, e.zone_id,
      (b.bx - b.ax) * (e.ay - b.ay) - (b.by - b.ay) * (e.ax - b.ax) AS d1,
      (b.bx - b.ax) * (e.by - b.ay) - (b.by - b.ay) * (e.bx - b.ax) AS d2,
      (e.bx - e.ax) * (b.ay - e.ay) - (e.by - e.ay) * (b.ax - e.ax) AS d3,
      (e.bx - e.ax) * (b.by - e.ay) - (e.by - e.ay) * (b.bx - e.ax) AS d4
    FROM box_edges b JOIN zone_edges e ON least(b.ax, b.bx) <= greatest(e.ax, e.bx) AND least(e.ax, e.bx) <= greatest(b.ax, b.bx))
  WHERE d1 * d2 <= 0 AND d3 * d4 <= 0)""", body="""
SELECT loc_id, count(*) AS n_zones, count(*) FILTER (WHERE kind = 'wetland') AS n_wetland,
  count(*) FILTER (WHERE kind = 'protected') AS n_protected
FROM touching JOIN zones USING (zone_id) GROUP BY loc_id"""),
    "radius_count": with_ctes("sites", "structures", body=f"""
SELECT s.loc_id, count(t.fd_id) AS n FROM sites s LEFT JOIN structures t
  ON abs(t.lat - s.lat) < 0.6 AND {hav('s.lng', 's.lat', 't.lng', 't.lat')} <= 60000 GROUP BY s.loc_id"""),
    "radius_count_mercator": with_ctes("sites", "pois", body="""
, m AS (SELECT loc_id, radians(lng) * 6378137e0 AS mx, ln(tan(pi() / 4 + radians(lat) / 2e0)) * 6378137e0 AS my FROM sites),
f AS (SELECT poi_id, radians(lng) * 6378137e0 AS mx, ln(tan(pi() / 4 + radians(lat) / 2e0)) * 6378137e0 AS my FROM pois)
SELECT m.loc_id, count(f.poi_id) AS n FROM m LEFT JOIN f ON abs(m.mx - f.mx) <= 80000
  AND sqrt(pow(m.mx - f.mx, 2) + pow(m.my - f.my, 2)) <= 80000 GROUP BY m.loc_id"""),
    "probe_nearest": with_ctes("sites", "pois", body=f"""
, found AS (SELECT loc_id, layer, count(*) AS n, round(min(d), 2) AS nearest_m FROM (
  SELECT s.loc_id, p.layer, {hav('s.lng', 's.lat', 'p.lng', 'p.lat')} AS d,
    CASE layer WHEN 'ECONOMY' THEN 90000 WHEN 'SMALL' THEN 60000 ELSE 30000 END AS radius
  FROM sites s JOIN pois p ON abs(s.lat - p.lat) < 0.9) WHERE d <= radius GROUP BY loc_id, layer)
SELECT loc_id, layer, coalesce(n, 0) AS n, nearest_m FROM sites CROSS JOIN (SELECT DISTINCT layer FROM pois) LEFT JOIN found USING (loc_id, layer)"""),
    "line_distance": with_ctes("sites", "lines", body=f"""
SELECT loc_id, b.line_id, b.dist_m FROM sites LEFT JOIN (SELECT loc_id, arg_min(line_id, (d, line_id)) AS line_id, round(min(d), 2) AS dist_m FROM (
  SELECT p.loc_id, e.line_id, {segment_sql('p', 'e')} AS d FROM sites p JOIN lines e
    ON p.lat BETWEEN least(e.ay, e.by) - 0.5 AND greatest(e.ay, e.by) + 0.5) WHERE d <= 50000 GROUP BY loc_id) b USING (loc_id)"""),
    "nearest_structure": with_ctes("properties", "structures", body=f"""
, near AS (SELECT p.property_id, t.fd_id, t.occtype, {hav('p.lng', 'p.lat', 't.lng', 't.lat')} AS d,
    sqrt(pow(p.lng - t.lng, 2) + pow(p.lat - t.lat, 2)) AS deg
  FROM properties p JOIN structures t ON abs(p.lat - t.lat) < 0.02 AND abs(p.lng - t.lng) < 0.02)
SELECT p.property_id, b.fd_id, b.occtype, round(b.d, 2) AS dist_m FROM properties p LEFT JOIN (
  SELECT * FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY deg, fd_id) = 1) WHERE d <= 500) b USING (property_id)"""),
    "nearest_unbounded": with_ctes("sites", "substations", body=f"""
, d AS (SELECT s.loc_id, b.sub_id, b.voltage, {hav('s.lng', 's.lat', 'b.lng', 'b.lat')} AS d FROM sites s CROSS JOIN substations b)
SELECT loc_id, sub_id, voltage, round(d, 2) AS dist_m FROM d
QUALIFY row_number() OVER (PARTITION BY loc_id ORDER BY d, sub_id) = 1"""),
    "nearest_degree": with_ctes("sites", "structures", body="""
SELECT loc_id, round(min(sqrt(pow(s.lng - t.lng, 2) + pow(s.lat - t.lat, 2))), 6) AS dist_deg
FROM sites s CROSS JOIN structures t GROUP BY loc_id"""),
    "nearest_of_layers": with_ctes("sites", "lines", "substations", body=f"""
, parts AS (SELECT ax, ay, bx, lines.by FROM lines UNION ALL SELECT lng, lat, lng, lat FROM substations),
near AS (SELECT p.loc_id, min({segment_sql('p', 'e')}) AS d FROM sites p CROSS JOIN parts e GROUP BY p.loc_id)
SELECT loc_id, round(d, 2) AS grid_m FROM near"""),
    "knearest_poi": with_ctes("sites", "pois", body=f"""
SELECT loc_id, rank, poi_id, poi_name, round(d, 2) AS dist_m FROM (
  SELECT *, row_number() OVER (PARTITION BY loc_id ORDER BY d, poi_id) AS rank FROM (
    SELECT s.loc_id, p.poi_id, p.poi_name, {hav('s.lng', 's.lat', 'p.lng', 'p.lat')} AS d
    FROM sites s JOIN pois p ON abs(s.lat - p.lat) < 0.8) WHERE d <= 80000) WHERE rank <= 3"""),
    "nearest_perimeters": with_ctes("properties", "zones", ZONE_EDGES, BOUNDARY, body="""
SELECT property_id, rank, zone_id, contains_point, round(dist, 2) AS dist_m FROM (
  SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY dist, zone_id) AS rank FROM boundary) WHERE rank <= 10"""),
    "latest_fires": with_ctes("properties", "zones", ZONE_EDGES, BOUNDARY, body="""
SELECT property_id, row_number() OVER (PARTITION BY property_id ORDER BY year_num DESC, zone_id) AS rank, zone_id, round(year_num, 0) AS fire_year, round(dist, 2) AS dist_m FROM boundary QUALIFY rank <= 10"""),
    "perimeter_preferring_containment": with_ctes("properties", "zones", ZONE_EDGES, BOUNDARY, body="""
SELECT property_id, zone_id, contains_point, round(year_num, 0) AS fire_year FROM boundary
QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY contains_point DESC, dist, zone_id) = 1"""),
    "radius_capacity": with_ctes("sites", "queue", body=f"""
, pairs AS (SELECT s.loc_id, q.status, q.iso, q.capacity_mw, coalesce(lower(q.fuel_type) LIKE 'solar%', FALSE) AS solar
  FROM sites s JOIN queue q ON abs(s.lat - q.lat) < 0.5 AND {hav('s.lng', 's.lat', 'q.lng', 'q.lat')} <= 50000),
isos AS (SELECT loc_id, iso, count(*) AS c FROM pairs GROUP BY ALL)
SELECT loc_id, count(status) AS n_projects, count(*) FILTER (WHERE status = 'Active') AS n_active,
  count(*) FILTER (WHERE status = 'Active' AND solar) AS n_active_solar,
  round(coalesce(sum(capacity_mw) FILTER (WHERE status = 'Active' AND solar), 0e0), 6) AS solar_mw,
  count(*) FILTER (WHERE status = 'Withdrawn') AS n_withdrawn, any_value(usual_iso) AS usual_iso
FROM sites LEFT JOIN pairs USING (loc_id) LEFT JOIN (SELECT loc_id, arg_min(iso, (-c, iso)) AS usual_iso FROM isos GROUP BY loc_id) USING (loc_id) GROUP BY loc_id"""),
    "largest_projects": with_ctes("sites", "queue", "plants", body=f"""
, p AS (SELECT s.loc_id, q.queue_id, q.capacity_mw, {hav('s.lng', 's.lat', 'q.lng', 'q.lat')} AS d FROM sites s JOIN queue q ON q.status = 'Active' AND abs(s.lat - q.lat) < 0.5),
top AS (SELECT *, row_number() OVER (PARTITION BY loc_id ORDER BY capacity_mw DESC, queue_id) AS rank FROM p WHERE d <= 50000 QUALIFY rank <= 5),
o AS (SELECT s.loc_id, sum(p.capacity_mw) AS mw, count(*) AS n FROM sites s JOIN plants p ON p.operating_status = 'OP' AND abs(s.lat - p.lat) < 0.5 AND {hav('s.lng', 's.lat', 'p.lng', 'p.lat')} <= 50000 GROUP BY s.loc_id)
SELECT loc_id, rank, queue_id, round(capacity_mw, 3) AS capacity_mw, round(d, 1) AS dist_m, round(coalesce(mw, 0e0), 3) AS operating_mw, coalesce(n, 0) AS n_operating FROM top LEFT JOIN o USING (loc_id)"""),
    "areal_rollup": with_ctes("tracts", "stores", body="""
, o AS (SELECT s.loc_id, t.*, least(1e0, (least(t.x1, s.lng + 0.04) - greatest(t.x0, s.lng - 0.04)) *
    (least(t.y1, s.lat + 0.03) - greatest(t.y0, s.lat - 0.03)) / ((t.x1 - t.x0) * (t.y1 - t.y0))) AS frac
  FROM stores s JOIN tracts t ON t.x0 <= s.lng + 0.04 AND t.x1 >= s.lng - 0.04 AND t.y0 <= s.lat + 0.03 AND t.y1 >= s.lat - 0.03)
SELECT loc_id, count(*) AS tracts_intersected, round(sum(coalesce(population, 0e0) * frac), 7) AS population,
  round(sum(households * frac), 7) AS households, round(sum(age_18_34 * frac), 7) AS age_18_34, round(sum(jobs * frac), 7) AS jobs,
  round(sum(median_income * population * frac) / sum(CASE WHEN median_income IS NOT NULL THEN population * frac END), 2) AS median_income
FROM o GROUP BY loc_id"""),
    "union_cover": with_ctes("sites", "zones", ZONE_EDGES, PARCELS, ZONE_SHAPES, strip_areas("cover", "parcels", "loc_id", f"(SELECT *, kind AS part FROM zone_boxes) ON {NEAR_ZONE}", "zone_shapes"), body="""
SELECT p.loc_id, k.kind, round(coalesce(area, 0e0) * pow(111320e0, 2) * cos(radians(lat)) / 4046.8564224e0, 2) AS covered_acres
FROM parcels p CROSS JOIN (VALUES ('habitat'), ('protected'), ('wetland')) AS k(kind) LEFT JOIN cover c ON c.loc_id = p.loc_id AND c.part = k.kind"""),
    "bbox_layer": with_ctes("zones", ZONE_EDGES, body="""
, boxes AS (SELECT zone_id, any_value(flood_zone) AS flood_zone, min(ax) AS x0, min(ay) AS y0, max(ax) AS x1, max(ay) AS y1
  FROM zone_edges GROUP BY zone_id)
SELECT zone_id, flood_zone, round(x0, 6) AS x0, round(y0, 6) AS y0 FROM boxes
WHERE x0 <= -90 AND x1 >= -110 AND y0 <= 42 AND y1 >= 30"""),
    "dissolve": with_ctes(*DISSOLVED, body="""
SELECT region_id, any_value(members) AS members, count(DISTINCT ring) AS rings, round(min(ax), 6) AS x0, round(min(ay), 6) AS y0, round(max(ax), 6) AS x1, round(max(ay), 6) AS y1,
  round(sum(abs(bx - ax) + abs(dy)), 6) AS perimeter_deg, any_value(area) AS area_deg2
FROM (SELECT o.*, o.by - o.ay AS dy, ring FROM outer_edges o JOIN named USING (id)) JOIN (
  SELECT region_id, count(*) AS members, round(sum((x1 - x0) * (y1 - y0)), 6) AS area FROM tiles GROUP BY region_id) USING (region_id) GROUP BY region_id"""),
    "dissolved_rings": with_ctes(*DISSOLVED, body="""
SELECT region_id, corners, count(*) AS rings, TRUE AS closed FROM (SELECT region_id, ring, count(*) AS corners FROM outer_edges JOIN named USING (id) GROUP BY region_id, ring) GROUP BY region_id, corners"""),
    "enrich_layers": with_ctes("sites", "pois", "substations", "zones", ZONE_EDGES, inside("sites", "loc_id"), body=f"""
, feats AS (SELECT layer, poi_id AS feature_id, lng, lat FROM pois UNION ALL SELECT 'SUBSTATION', sub_id, lng, lat FROM substations),
pairs AS (SELECT s.loc_id, f.layer, f.feature_id, {hav('s.lng', 's.lat', 'f.lng', 'f.lat')} AS d
  FROM sites s JOIN feats f ON abs(s.lat - f.lat) < 0.6),
every AS (SELECT * FROM pairs WHERE d <= 60000 UNION ALL SELECT loc_id, upper(kind), zone_id, 0e0 FROM zone_hits JOIN zones USING (zone_id))
SELECT loc_id, layer, rank, feature_id, round(d, 2) AS dist_m, n_in_radius FROM (
  SELECT *, row_number() OVER (PARTITION BY loc_id, layer ORDER BY d, feature_id) AS rank,
    count(*) OVER (PARTITION BY loc_id, layer) AS n_in_radius FROM every) WHERE rank <= {ENRICH_LIMIT // 10}"""),
    "state_by_box": with_ctes("sites", "tiles", body="""
SELECT loc_id, arg_max(tile_name, tile_id) AS tile_name FROM sites s JOIN tiles t
  ON s.lng BETWEEN t.x0 - 1e0 AND t.x1 + 1e0 AND s.lat BETWEEN t.y0 - 1e0 AND t.y1 + 1e0 GROUP BY loc_id"""),
}
