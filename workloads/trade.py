"""Trade-area and site-report queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import geo
from parcelwise.functions import scoring as S
from parcelwise.operators import counts, overlap
from parcelwise.operators import spatial as X
from parcelwise.plans import backtest as B
from parcelwise.plans import selection as E
from parcelwise.plans import trade as T
from parcelwise.sources import catalog

from .layers import (
    CATCHMENT_AREA, CATCHMENTS, NEAR_ZONE, ZONE_EDGES, ZONE_SHAPES, as_features, box_polygons, catchments, hav, inside, layer, strip_areas, with_ctes, zone_polygons,
)
from .solar import sites_with_sources
from .spatial import zone_cell, zones

TRACT_CELL = 0.054


def city_tracts(spark, sf_dir):
    return box_polygons(layer(spark, sf_dir, "tracts"))


def box_rings(spark, sf_dir):
    """Drive-time rings given as polygons: boxes of 5, 10 and 15 minutes."""
    stores = layer(spark, sf_dir, "stores").select("loc_id", "lng", "lat")
    rings = stores.withColumn("minutes", F.explode(F.array(F.lit(5), F.lit(10), F.lit(15))))
    half = F.col("minutes") * 0.004
    return box_polygons(
        rings.select(
            "loc_id", "minutes", (F.col("lng") - half).alias("x0"), (F.col("lat") - half).alias("y0"),
            (F.col("lng") + half).alias("x1"), (F.col("lat") + half).alias("y1"),
        )
    )


def profile_ring(spark, sf_dir):
    """Demographics per store and ring."""
    out = T.ring_profiles(box_rings(spark, sf_dir), city_tracts(spark, sf_dir), "loc_id", TRACT_CELL)
    return out.select("loc_id", "minutes", F.round("population", 6).alias("population"), F.round("jobs", 6).alias("jobs"), "tracts_intersected")


def category_groups(spark, sf_dir):
    """Points of interest per category group in each 10-minute ring."""
    rings = box_rings(spark, sf_dir).filter(F.col("minutes") == 10)
    pts = layer(spark, sf_dir, "city_pois").select("lng", "lat", F.split("category", ":")[0].alias("grp"))
    return counts.sums_in_polygons(rings, as_features(pts), "loc_id", {"n": F.count(F.lit(1))}, ["grp"])


def ring_competition(spark, sf_dir, business="urgent_care"):
    """Competitors and complements per ring."""
    return T.ring_competition(
        box_rings(spark, sf_dir), layer(spark, sf_dir, "city_pois"), "loc_id", business
    )


def competitive_gap(spark, sf_dir):
    """Density per 10 000 people and gap in the ring nearest 10 minutes."""
    ten = T.pick_ring(box_rings(spark, sf_dir), "loc_id", 10)
    people = T.ring_profiles(ten, city_tracts(spark, sf_dir), "loc_id", TRACT_CELL)
    comp = T.ring_competition(ten, layer(spark, sf_dir, "city_pois"), "loc_id", "coffee_shop")
    both = people.join(comp, ["loc_id", "minutes"], "left")
    density, gap = T.competitive_gap(F.coalesce(F.col("competitors"), F.lit(0)), F.round("population"), "coffee_shop")
    return both.select("loc_id", "minutes", F.round(density, 5).alias("density"), F.round(gap, 5).alias("gap"))


def nearest_competitor(spark, sf_dir):
    """Nearest same-category point for every store, no radius."""
    stores = layer(spark, sf_dir, "stores").select("loc_id", "lng", "lat")
    pts = as_features(layer(spark, sf_dir, "city_pois").filter(T.competes("category", "coffee_shop")).select("poi_id", "lng", "lat"))
    out = X.nearest(stores, pts, "loc_id", "poi_id", [])
    return out.select("loc_id", F.round("dist", 1).alias("nearest_m"))


def circle_counts(spark, sf_dir):
    """Points of interest inside the three circle rings of each store."""
    stores = layer(spark, sf_dir, "stores").select("loc_id", "lng", "lat")
    return T.ring_competition(T.circle_rings(stores, "loc_id"), layer(spark, sf_dir, "city_pois"), "loc_id", "coffee_shop")


def trade_area_score(spark, sf_dir):
    """Full score with circle rings, roads and flood flag."""
    stores = layer(spark, sf_dir, "stores").select("loc_id", "lng", "lat")
    # Roads: horizontal segments at each tract's southern edge.
    roads = layer(spark, sf_dir, "tracts").select(
        F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y0").alias("by")
    )
    flags = stores.select("loc_id", (F.col("loc_id") % 9 == 0).alias("in_sfha"))
    out = T.score_trade_area(stores, city_tracts(spark, sf_dir), layer(spark, sf_dir, "city_pois"), roads, flags, "loc_id", "coffee_shop", TRACT_CELL)
    return out.select("loc_id", F.round("composite", 3).alias("composite"), "rating")


def trade_composite(spark, sf_dir):
    """T5 on given ring measures: the seven-criteria composite and rating."""
    k = F.col("loc_id")
    rows = layer(spark, sf_dir, "stores").withColumns(
        {
            "population": (k * 997 % 150000).cast("double"), "median_income": F.when(k % 11 != 0, (k * 733 % 110000).cast("double")),
            "jobs": (k * 389 % 80000).cast("double"), "competitive_gap": (k % 101) / 100.0, "complements_5": (k % 70).cast("double"),
            "poi_count_5": (k * 3 % 260).cast("double"), "road_m": F.when(k % 13 != 0, (k * 41 % 7000).cast("double")), "in_sfha": k % 9 == 0,
        }
    )
    return T.composite(rows).select("loc_id", F.round("composite", 6).alias("composite"), "rating", F.round("c_accessibility", 3).alias("c_accessibility"))


def partial_score(spark, sf_dir):
    """Score from 5 km counts outside the loaded area."""
    stores = layer(spark, sf_dir, "stores").select("loc_id", "lng", "lat")
    pts = layer(spark, sf_dir, "city_pois").select(F.col("lng").alias("f_lng"), F.col("lat").alias("f_lat"), T.competes("category", "coffee_shop").alias("_c"))
    measures = {"competitors_5km": F.count_if("_c"), "complements_5km": F.count_if(~F.col("_c")), "pois_5km": F.count(F.lit(1))}
    near = counts.sums_within_radius(stores, pts, "loc_id", 5_000.0, measures)
    rows = stores.join(near, "loc_id", "left").withColumn("in_sfha", F.col("loc_id") % 9 == 0)
    out = T.partial_score(rows)
    return out.select("loc_id", "competitors_5km", "pois_5km", F.round("composite", 6).alias("composite"), F.round("weight_share", 2).alias("weight_share"), "rating")


def trade_route(spark, sf_dir):
    """Method per site."""
    base = E.select_data(sites_with_sources(spark, sf_dir), catalog.TRADE)
    rows = base.withColumns({"in_area": F.col("loc_id") % 3 != 0, "has_isochrone": F.col("loc_id") % 4 != 0})
    return T.route(rows).groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))


def competitor_points(spark, sf_dir):
    """Competitor points per 10-minute ring, up to 500."""
    ten = T.pick_ring(box_rings(spark, sf_dir), "loc_id", 10)
    return T.competitor_points(ten, layer(spark, sf_dir, "city_pois"), "loc_id", "coffee_shop", 0.04).select("loc_id", "rank", "poi_id", "n_total")


def huff(spark, sf_dir):
    """Cannibalisation of candidate catchments (polygons) against existing stores'."""
    stores = catchments(layer(spark, sf_dir, "stores").select("loc_id", "lng", "lat", "segment"))
    pairs = T.catchment_pairs(stores.filter("segment <> 'BUILDING'"), stores.filter("segment = 'BUILDING'"), "loc_id", 0.06)
    out = T.huff(pairs, "loc_id")
    return out.select("loc_id", "n_stores", F.round("max_estimate", 5).alias("max_estimate"), F.round("max_overlap", 6).alias("max_overlap"), "risk")


def overlap_shares(spark, sf_dir):
    """Share of a box around each site inside each zone."""
    z = zone_polygons(spark, sf_dir)
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    rings = box_polygons(
        sites.select("loc_id", (F.col("lng") - 0.5).alias("x0"), (F.col("lat") - 0.4).alias("y0"), (F.col("lng") + 0.5).alias("x1"), (F.col("lat") + 0.4).alias("y1"))
    )
    out = overlap.overlap_moments(rings, z, ["loc_id"], ["zone_id"], zone_cell(spark, sf_dir))
    return out.select("loc_id", "zone_id", F.round("overlap", 6).alias("overlap"))


def trade_discover(spark, sf_dir):
    """Lattice over the loaded area, kept near a point of interest, best 25."""
    tracts = layer(spark, sf_dir, "tracts")
    area = tracts.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    grid = T.regular_grid(area, 0.01).select((F.col("i") * 1000 + F.col("j")).alias("point_id"), "lng", "lat")
    out = T.discover(grid, layer(spark, sf_dir, "city_pois"), tracts, "coffee_shop", 3_000.0, 25, 0.03)
    return out.select("point_id", "lng", "lat", F.round("population", 0).alias("population"), "competitors", "score")


def site_report(spark, sf_dir):
    """Five factors per site from containment and projected-radius counts."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    pois = layer(spark, sf_dir, "pois")
    zone_flags = {
        "in_sfha": S.is_sfha("flood_zone"),
        "in_fire_hazard": F.col("kind") == "habitat",
        "in_tract": F.col("kind") == "protected",
    }
    flags = X.polygon_flags(sites, zones(spark, sf_dir, "flood_zone", "kind"), zone_cell(spark, sf_dir), "loc_id", zone_flags)
    feats = as_features(pois.select("lng", "lat", "category"))
    category = F.col("category")
    measures = {"transit_count": F.count_if(category.startswith("shop")), "facility_count": F.count_if(category == "amenity:clinic"), "poi_count": F.count(F.lit(1))}
    near = counts.sums_within_radius(sites, feats, "loc_id", 90_000.0, measures, geo.MERCATOR)
    rows = flags.join(near, "loc_id", "left").fillna(0, ["transit_count", "facility_count", "poi_count"])
    out = T.site_report(rows)
    return out.select("loc_id", "transit_factor", "environment_factor", "competition_factor", "composite")


#: Ranges that a site's factors are expected in; the last one is not measured.
EXPECTED = {"transit": (20.0, 100.0), "environment": (60.0, 100.0), "competition": (40.0, 80.0), "walkability": (0.0, 100.0)}


def factor_violations(spark, sf_dir):
    """Factors of the site report outside their expected range, or missing."""
    rows = site_report(spark, sf_dir)
    pairs = lambda items: F.create_map(*(x for k, v in items for x in (F.lit(k), v)))
    expected = pairs((k, F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for k, (lo, hi) in EXPECTED.items())
    actual = pairs((k, F.col(f"{k}_factor")) for k in EXPECTED if k != "walkability")
    out = B.factor_violations(rows.select("loc_id", expected.alias("expected"), actual.alias("actual")), "expected", "actual", "loc_id")
    return out.groupBy("factor", "violation").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 3).alias("least"), F.round(F.max("value"), 3).alias("most"))


def site_suitability(spark, sf_dir):
    """Weighted log densities over the layers."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    feats = as_features(layer(spark, sf_dir, "pois").select("layer", "lng", "lat"))
    hits = counts.sums_within_radius(sites, feats, "loc_id", 100_000.0, {"n": F.count(F.lit(1))}, geo.MERCATOR, ["layer"])
    layers = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"]
    out = T.site_suitability(hits, "loc_id", {"ECONOMY": 0.8, "PROMO": 0.2}, layers)
    return sites.join(out, "loc_id", "left").select("loc_id", F.round(F.coalesce("overall_score", F.lit(0.0)), 6).alias("overall_score"))


QUERIES = {f.__name__: f for f in (
    profile_ring, category_groups, ring_competition, competitive_gap, nearest_competitor, circle_counts, trade_area_score,
    trade_composite, competitor_points, partial_score, trade_route, huff, overlap_shares, trade_discover, site_report, factor_violations, site_suitability,
)}

BOXES = """rings AS (SELECT loc_id, minutes, lng - minutes * 0.004e0 AS x0, lat - minutes * 0.004e0 AS y0, lng + minutes * 0.004e0 AS x1, lat + minutes * 0.004e0 AS y1
  FROM stores CROSS JOIN (VALUES (5), (10), (15)) AS m(minutes))"""
SHARES = """shares AS (SELECT r.loc_id, r.minutes, t.*, least(1e0, (least(t.x1, r.x1) - greatest(t.x0, r.x0)) * (least(t.y1, r.y1) - greatest(t.y0, r.y0))
    / ((t.x1 - t.x0) * (t.y1 - t.y0))) AS frac FROM rings r JOIN tracts t ON t.x0 <= r.x1 AND t.x1 >= r.x0 AND t.y0 <= r.y1 AND t.y1 >= r.y0)"""
IN_RING = """ring_pois AS (SELECT r.loc_id, r.minutes, p.category FROM rings r JOIN city_pois p ON p.lng >= r.x0 AND p.lng < r.x1 AND p.lat >= r.y0 AND p.lat < r.y1)"""
STRONG = "CASE WHEN {0} >= 0.7 THEN 'Strong' WHEN {0} >= 0.4 THEN 'Moderate' ELSE 'Weak' END"
_CIRCLE = """vertices AS (SELECT loc_id, minutes, k, lng + r * sin((k % 48) * 2e0 * pi() / 48) / (greatest(cos(radians(lat)), 0.1e0) * 111320e0) AS x,
    lat + r * cos((k % 48) * 2e0 * pi() / 48) / 111320e0 AS y, lng, lat, r FROM stores CROSS JOIN (VALUES (5, 3000e0), (10, 7000e0), (15, 12000e0)) AS m(minutes, r)
  CROSS JOIN (SELECT unnest(range(49)) AS k)),
edges AS (SELECT a.loc_id, a.minutes, a.lng AS cx, a.lat AS cy, a.r, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM vertices a JOIN vertices b
  ON a.loc_id = b.loc_id AND a.minutes = b.minutes AND b.k = a.k + 1)"""

ORACLES = {
    "profile_ring": with_ctes("stores", "tracts", BOXES, SHARES, body="""
SELECT loc_id, minutes, round(sum(coalesce(population, 0e0) * frac), 6) AS population, round(sum(jobs * frac), 6) AS jobs, count(*) AS tracts_intersected
FROM shares GROUP BY loc_id, minutes"""),
    "category_groups": with_ctes("stores", "city_pois", BOXES, IN_RING, body="""
SELECT loc_id, string_split(category, ':')[1] AS grp, count(*) AS n FROM ring_pois WHERE minutes = 10 GROUP BY 1, 2"""),
    "ring_competition": with_ctes("stores", "city_pois", BOXES, IN_RING, body="""
SELECT loc_id, minutes, count(*) FILTER (WHERE category = 'amenity:clinic' OR category LIKE 'healthcare:%') AS competitors,
  count(*) FILTER (WHERE NOT (category = 'amenity:clinic' OR category LIKE 'healthcare:%')) AS complements, count(*) AS poi_count FROM ring_pois GROUP BY loc_id, minutes"""),
    "competitive_gap": with_ctes("stores", "tracts", "city_pois", BOXES, SHARES, IN_RING, body="""
, pop AS (SELECT loc_id, round(sum(coalesce(population, 0e0) * frac)) AS pop FROM shares WHERE minutes = 10 GROUP BY loc_id),
comp AS (SELECT loc_id, count(*) AS c FROM ring_pois WHERE minutes = 10 AND category = 'amenity:cafe' GROUP BY loc_id),
d AS (SELECT loc_id, CASE WHEN pop > 0 THEN coalesce(c, 0) / (pop / 10000e0) ELSE 0e0 END AS d FROM pop LEFT JOIN comp USING (loc_id))
SELECT loc_id, 10 AS minutes, round(d, 5) AS density, round(greatest(0e0, 1 - least(d / 3e0, 1e0)), 5) AS gap FROM d"""),
    "nearest_competitor": with_ctes("stores", "city_pois", body=f"""
SELECT s.loc_id, round(min({hav('s.lng', 's.lat', 'p.lng', 'p.lat')}), 1) AS nearest_m FROM stores s CROSS JOIN (SELECT * FROM city_pois WHERE category = 'amenity:cafe') p GROUP BY s.loc_id"""),
    "circle_counts": with_ctes("stores", "city_pois", _CIRCLE, body="""
, boxed AS (SELECT loc_id, minutes, lng, lat, r FROM vertices WHERE k = 0),
cand AS (SELECT b.loc_id, b.minutes, p.poi_id, p.category, p.lng, p.lat,
    sqrt(pow((p.lng - b.lng) * cos(radians(b.lat)), 2) + pow(p.lat - b.lat, 2)) * 111320e0 / b.r AS rel FROM boxed b JOIN city_pois p ON abs(p.lat - b.lat) < b.r / 111000e0 AND abs(p.lng - b.lng) < b.r / 90000e0),
sure AS (SELECT loc_id, minutes, poi_id, category FROM cand WHERE rel < 0.99),
edge_in AS (SELECT c.loc_id, c.minutes, c.poi_id, c.category FROM (SELECT * FROM cand WHERE rel BETWEEN 0.99 AND 1.01) c JOIN edges e USING (loc_id, minutes)
  WHERE ((e.ay > c.lat) <> (e.by > c.lat)) AND c.lng < (e.bx - e.ax) * ((c.lat - e.ay) / nullif(e.by - e.ay, 0)) + e.ax GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT loc_id, minutes, count(*) FILTER (WHERE category = 'amenity:cafe') AS competitors, count(*) FILTER (WHERE category <> 'amenity:cafe') AS complements, count(*) AS poi_count
FROM (SELECT * FROM sure UNION ALL SELECT * FROM edge_in) GROUP BY loc_id, minutes"""),
    "trade_composite": with_ctes("stores", body=f"""
, p AS (SELECT loc_id, round(least(1e0, (loc_id * 997 % 150000) / 100000e0), 3) AS a, round(least(1e0, CASE WHEN loc_id % 11 <> 0 THEN (loc_id * 733 % 110000) ELSE 0 END / 75000e0), 3) AS b,
  round((loc_id % 101) / 100e0, 3) AS c, round(least(1e0, (loc_id * 389 % 80000) / 50000e0), 3) AS d,
  round((least(1e0, (loc_id * 3 % 260) / 200e0) + CASE WHEN loc_id % 13 <> 0 THEN greatest(0e0, 1 - (loc_id * 41 % 7000) / 5000e0) ELSE 0.5e0 END) / 2e0, 3) AS e,
  round(least(1e0, (loc_id % 70) / 50e0), 3) AS f, CASE WHEN loc_id % 9 = 0 THEN 0.5e0 ELSE 1e0 END AS g FROM stores),
q AS (SELECT *, a * 0.25e0 + b * 0.15e0 + c * 0.2e0 + d * 0.15e0 + e * 0.1e0 + f * 0.1e0 + g * 0.05e0 AS s FROM p)
SELECT loc_id, round(s, 6) AS composite, {STRONG.format('round(s, 9)')} AS rating, e AS c_accessibility FROM q"""),
    "partial_score": with_ctes("stores", "city_pois", body=f"""
, n AS (SELECT s.loc_id, count(*) FILTER (WHERE p.category = 'amenity:cafe') AS k, count(*) AS n FROM stores s JOIN city_pois p ON abs(s.lat - p.lat) < 0.05
  AND {hav('s.lng', 's.lat', 'p.lng', 'p.lat')} <= 5000 GROUP BY s.loc_id),
c AS (SELECT loc_id, k, n, CASE WHEN loc_id % 9 = 0 THEN 0.5e0 ELSE 1e0 END AS fl, round(greatest(0e0, 1 - least(k / 15e0, 1e0)), 3) AS gap,
  round(least(1e0, (n - k) / 300e0), 3) AS cm, round(least(1e0, n / 600e0), 3) AS ac FROM stores LEFT JOIN n USING (loc_id)),
q AS (SELECT *, CASE WHEN k IS NULL THEN 0.05e0 ELSE 0.45e0 END AS w, CASE WHEN k IS NULL THEN fl ELSE (fl * 0.05e0 + gap * 0.2e0 + cm * 0.1e0 + ac * 0.1e0) / 0.45e0 END AS s FROM c)
SELECT loc_id, k AS competitors_5km, n AS pois_5km, round(s, 6) AS composite, round(w, 2) AS weight_share, {STRONG.format('round(s, 9)')} AS rating FROM q"""),
    "competitor_points": with_ctes("stores", "city_pois", BOXES, body="""
SELECT r.loc_id, row_number() OVER (PARTITION BY r.loc_id ORDER BY p.poi_id) AS rank, p.poi_id, count(*) OVER (PARTITION BY r.loc_id) AS n_total FROM rings r JOIN city_pois p
  ON r.minutes = 10 AND p.category = 'amenity:cafe' AND p.lng >= r.x0 AND p.lng < r.x1 AND p.lat >= r.y0 AND p.lat < r.y1"""),
    "trade_route": with_ctes("sites", body="""
SELECT CASE WHEN loc_id % 3 <> 0 AND loc_id % 4 <> 0 THEN 'full' WHEN loc_id % 3 <> 0 THEN 'full_euclidean_fallback' ELSE 'national_fallback' END AS coverage, count(*) AS n FROM sites GROUP BY 1"""),
    "huff": with_ctes("stores", CATCHMENTS, body=f"""
, p AS (SELECT a.loc_id, b.loc_id AS store_id, greatest(a.x0, b.x0) AS x0, least(a.x1, b.x1) AS x1 FROM extents a JOIN extents b
  ON a.segment <> 'BUILDING' AND b.segment = 'BUILDING' AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
e AS (SELECT p.*, who, sx, sy, tx, ty FROM p JOIN sides s ON s.loc_id = p.loc_id CROSS JOIN (SELECT 0 AS who)
  UNION ALL SELECT p.*, who, sx, sy, tx, ty FROM p JOIN sides s ON s.loc_id = p.store_id CROSS JOIN (SELECT 1 AS who)),
v AS (SELECT DISTINCT loc_id, store_id, x FROM (SELECT loc_id, store_id, x0, x1, unnest([x0, x1, sx, tx]) AS x FROM e
  UNION ALL SELECT a.loc_id, a.store_id, a.x0, a.x1, (a.sy - b.sy - m * a.sx + n * b.sx) / (n - m) FROM (SELECT *, (ty - sy) / (tx - sx) AS m FROM e WHERE who = 0) a
    JOIN (SELECT *, (ty - sy) / (tx - sx) AS n FROM e WHERE who = 1) b USING (loc_id, store_id) WHERE a.m <> b.n AND a.sx < b.tx AND b.sx < a.tx) WHERE x BETWEEN x0 AND x1),
t AS (SELECT * FROM (SELECT loc_id, store_id, x AS xa, lead(x) OVER (PARTITION BY loc_id, store_id ORDER BY x) AS xb FROM v) WHERE xb > xa),
y AS (SELECT t.*, who, sy + (ty - sy) / (tx - sx) * (xa - sx) AS ya, sy + (ty - sy) / (tx - sx) * (xb - sx) AS yb FROM t JOIN e USING (loc_id, store_id)
  WHERE sx < (xa + xb) / 2e0 AND tx > (xa + xb) / 2e0),
w AS (SELECT loc_id, store_id, xa, xb, who, arg_min((ya, yb), ya + yb) AS lo, arg_max((ya, yb), ya + yb) AS hi FROM y GROUP BY ALL),
b AS (SELECT loc_id, store_id, xa, xb, arg_max(lo, lo[1] + lo[2]) AS lo, arg_min(hi, hi[1] + hi[2]) AS hi FROM w GROUP BY loc_id, store_id, xa, xb HAVING count(*) = 2),
h AS (SELECT loc_id, store_id, xa, xb, lo[1] AS la, lo[2] AS lb, hi[1] AS ua, hi[2] AS ub, hi[1] - lo[1] AS ha, hi[2] - lo[2] AS hb FROM b WHERE hi[1] + hi[2] > lo[1] + lo[2]),
m AS (SELECT loc_id, store_id, sum((xb - xa) * (ha + hb) / 2e0) AS area, sum((xb - xa) / 6e0 * (xa * (2e0 * ha + hb) + xb * (ha + 2e0 * hb))) AS mx,
  sum((xb - xa) / 6e0 * (ua * ua + ua * ub + ub * ub - la * la - la * lb - lb * lb)) AS my FROM h GROUP BY loc_id, store_id),
d AS (SELECT m.loc_id, area / (pow(a.half, 2) * {CATCHMENT_AREA:e}) AS ov, {hav('a.lng', 'a.lat', '(mx / area)', '(my / area)')} AS tn, {hav('c.lng', 'c.lat', '(mx / area)', '(my / area)')} AS te
  FROM m JOIN halves a ON a.loc_id = m.loc_id JOIN halves c ON c.loc_id = m.store_id),
f AS (SELECT loc_id, ov, ov * (1 / pow(greatest(te, 1e0), 2)) / (1 / pow(greatest(tn, 1e0), 2) + 1 / pow(greatest(te, 1e0), 2)) AS est FROM d)
SELECT loc_id, count(*) AS n_stores, round(max(est), 5) AS max_estimate, round(max(ov), 6) AS max_overlap,
  CASE WHEN max(est) > 0.3 THEN 'High' WHEN max(est) > 0.1 THEN 'Medium' ELSE 'Low' END AS risk FROM f GROUP BY loc_id"""),
    "overlap_shares": with_ctes("sites", "zones", ZONE_EDGES, ZONE_SHAPES, "boxes AS (SELECT loc_id, lng - 0.5 AS x0, lat - 0.4 AS y0, lng + 0.5 AS x1, lat + 0.4 AS y1 FROM sites)",
        strip_areas("common", "boxes", "loc_id", f"(SELECT *, shape AS part FROM zone_boxes) ON {NEAR_ZONE}", "zone_shapes"), body="""
SELECT loc_id, part AS zone_id, round(area / 0.8e0, 6) AS overlap FROM common WHERE area > 0"""),
    "trade_discover": with_ctes("tracts", "city_pois", body="""
, area AS (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM tracts),
g AS (SELECT i * 1000 + j AS point_id, round(x0 + i * 0.01e0, 5) AS lng, round(y0 + j * 0.01e0, 5) AS lat FROM area
  CROSS JOIN (SELECT unnest(range(200)) AS i) CROSS JOIN (SELECT unnest(range(200)) AS j)
  WHERE i <= floor((x1 - x0) / 0.01e0 + 1e-9) AND j <= floor((y1 - y0) / 0.01e0 + 1e-9)),
near AS (SELECT g.point_id, count(*) FILTER (WHERE category = 'amenity:cafe') AS c, min(sqrt(pow(g.lng - p.lng, 2) + pow(g.lat - p.lat, 2))) AS d FROM g JOIN city_pois p
  ON abs(g.lng - p.lng) <= 0.015 AND abs(g.lat - p.lat) <= 0.015 AND sqrt(pow(g.lng - p.lng, 2) + pow(g.lat - p.lat, 2)) <= 0.015 GROUP BY g.point_id),
pop AS (SELECT g.point_id, sum(population) AS pop FROM g JOIN tracts t ON sqrt(pow(greatest(t.x0 - g.lng, 0e0, g.lng - t.x1), 2) + pow(greatest(t.y0 - g.lat, 0e0, g.lat - t.y1), 2)) <= 0.015 GROUP BY g.point_id),
s AS (SELECT g.*, c, pop, c / (pop / 10000e0) AS dens FROM g JOIN near USING (point_id) JOIN pop USING (point_id) WHERE d <= 0.005 AND pop >= 3000)
SELECT point_id, lng, lat, round(pop, 0) AS population, c AS competitors, round(least(1e0, pop / 50000e0) * 0.6e0 + greatest(0e0, 1 - least(dens / 3e0, 1e0)) * 0.4e0, 3) AS score
FROM s ORDER BY score DESC, point_id LIMIT 25"""),
    "site_report": with_ctes("sites", "pois", "zones", ZONE_EDGES, inside("sites", "loc_id"), body="""
, m AS (SELECT loc_id, radians(lng) * 6378137e0 AS mx, ln(tan(pi() / 4 + radians(lat) / 2e0)) * 6378137e0 AS my FROM sites),
f AS (SELECT category, radians(lng) * 6378137e0 AS mx, ln(tan(pi() / 4 + radians(lat) / 2e0)) * 6378137e0 AS my FROM pois),
n AS (SELECT m.loc_id, count(*) FILTER (WHERE category LIKE 'shop%') AS t, count(*) FILTER (WHERE category = 'amenity:clinic') AS e, count(category) AS p FROM m LEFT JOIN f
  ON abs(m.mx - f.mx) <= 90000 AND sqrt(pow(m.mx - f.mx, 2) + pow(m.my - f.my, 2)) <= 90000 GROUP BY m.loc_id),
z AS (SELECT loc_id, bool_or(flood_zone LIKE 'A%' OR flood_zone LIKE 'V%') AS sfha, bool_or(kind = 'habitat') AS fire, bool_or(kind = 'protected') AS tract
  FROM zone_hits JOIN zones USING (zone_id) GROUP BY loc_id),
x AS (SELECT n.loc_id, CASE WHEN sfha THEN 0e0 ELSE 100e0 END AS fl, CASE WHEN tract THEN 75e0 ELSE 40e0 END AS de, least(100e0, round(t / 5e0 * 100)) AS tr,
  greatest(0e0, 100 - e * 20e0 - CASE WHEN fire THEN 40 ELSE 0 END) AS en,
  CASE WHEN p = 0 THEN 40e0 WHEN p <= 30 THEN round(40 + p / 30e0 * 40) ELSE greatest(20e0, 80 - round((p - 30) / 3e0)) END AS co FROM n LEFT JOIN z USING (loc_id))
SELECT loc_id, tr AS transit_factor, en AS environment_factor, co AS competition_factor, round_even((fl + de + tr + en + co) / 5e0, 0) AS composite FROM x"""),
    "site_suitability": with_ctes("sites", "pois", body="""
, m AS (SELECT loc_id, radians(lng) * 6378137e0 AS mx, ln(tan(pi() / 4 + radians(lat) / 2e0)) * 6378137e0 AS my FROM sites),
f AS (SELECT layer, radians(lng) * 6378137e0 AS mx, ln(tan(pi() / 4 + radians(lat) / 2e0)) * 6378137e0 AS my FROM pois),
n AS (SELECT m.loc_id, layer, count(*) AS n FROM m JOIN f ON abs(m.mx - f.mx) <= 100000 AND sqrt(pow(m.mx - f.mx, 2) + pow(m.my - f.my, 2)) <= 100000 GROUP BY ALL),
s AS (SELECT loc_id, sum(least(log10(n + 1e0) / 3e0, 1e0) * CASE layer WHEN 'ECONOMY' THEN 0.8e0 WHEN 'PROMO' THEN 0.2e0 ELSE 0.5e0 END) / 3e0 AS s FROM n GROUP BY loc_id)
SELECT loc_id, round(coalesce(s, 0e0), 6) AS overall_score FROM sites LEFT JOIN s USING (loc_id)"""),
}
ORACLES["factor_violations"] = f"WITH r AS ({ORACLES['site_report']})" + " UNION ALL ".join(
    f" SELECT '{k}' AS factor, 'outside' AS violation, count(*) AS n, round(min({k}_factor), 3) AS least, round(max({k}_factor), 3) AS most FROM r WHERE {k}_factor NOT BETWEEN {lo} AND {hi} HAVING count(*) > 0"
    if k != "walkability" else " SELECT 'walkability', 'missing', count(*), NULL, NULL FROM r" for k, (lo, hi) in EXPECTED.items())
