"""Table, raster, parsing and audit queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import constants as K
from parcelwise.functions import scoring as S
from parcelwise.operators import aggregates as A
from parcelwise.operators import raster as G
from parcelwise.operators import relational as R
from parcelwise.plans import audit as U
from parcelwise.plans import hazard as H
from parcelwise.plans import solar as L
from parcelwise.session import scratch_folder
from parcelwise.sources import catalog, readers, sinks
from parcelwise.streaming import audit_stream

from .hazard import FLOOD_IN, NEAREST_CURVE, TIER, curves_sql, flood_inputs
from .layers import PARCELS, RASTER_AFFINE, TERRAIN, ZONE_EDGES, cte, inside, layer, parcels, table, with_ctes


# ── keyed tables ────────────────────────────────────────────────────────────
def dominant_component(spark, sf_dir):
    """The line with the largest quantity per order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_partkey", "l_linenumber", "l_suppkey")
    keyed = li.withColumn("tie", F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber"))
    return readers.dominant_component(keyed, "l_orderkey", "l_quantity", "tie").select("l_orderkey", "l_quantity", "l_partkey", "l_linenumber")


def _versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    old = o.filter(F.col("o_orderstatus") != "P").withColumn("version", F.lit(1))
    new = o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).withColumns(
        {
            "o_totalprice": F.when(urgent, F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice")),
            "version": F.when(urgent, 2).otherwise(1),
        }
    )
    return old, new


def upsert_latest(spark, sf_dir):
    """K2, K3: newest row per key, incoming winning equal versions."""
    old, new = _versions(spark, sf_dir)
    return R.upsert_latest(old, new, ["o_orderkey"], "version").select("o_orderkey", "o_totalprice", "version")


def backfill(spark, sf_dir):
    """K4: columns overwritten from a staged table by key."""
    old, new = _versions(spark, sf_dir)
    return R.backfill_columns(old, new, ["o_orderkey"], ["o_totalprice"]).select("o_orderkey", "o_totalprice")


def table_diff(spark, sf_dir):
    """Full-outer comparison of two versions."""
    old, new = _versions(spark, sf_dir)
    d = R.table_diff(new, old, ["o_orderkey"], ["o_totalprice"])
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("delta_o_totalprice")), 2).alias("moved"))


def resume_antijoin(spark, sf_dir):
    """Structures not yet computed."""
    s = layer(spark, sf_dir, "structures").select("fd_id", "tract")
    done = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("fd_id"))
    return R.not_done(s, done, ["fd_id"])


def append_new(spark, sf_dir):
    """First row per new execution, known ones skipped."""
    e = table(spark, sf_dir, "events")
    feed = e.select((F.col("event_id") % 4000).alias("execution_id"), "event_id")
    known = e.filter(F.col("event_type") == "error").select((F.col("event_id") % 4000).alias("execution_id"))
    return R.not_done(R.keep_first(feed, ["execution_id"], ["event_id"]), known, ["execution_id"])


def dedup_first(spark, sf_dir):
    """First row per (name, brand, type)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return R.keep_first(p, ["p_name", "p_brand", "p_type"], ["p_partkey"])


def lookup_found(spark, sf_dir):
    """Key lookup that flags missing rows and keeps them."""
    s = layer(spark, sf_dir, "sites").select("loc_id", "nation_id")
    side = table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 2).select(F.col("n_nationkey").alias("nation_id"), "n_name", F.lit(True).alias("hit"))
    return s.join(side, "nation_id", "left").select("loc_id", "n_name", F.coalesce("hit", F.lit(False)).alias("found_in_dataset"))


def centroid_fallback(spark, sf_dir):
    """Code centroid, else name centroid, else dropped and counted."""
    by_code = table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 2000).select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("a"))
    by_name = table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 4).select(F.col("n_nationkey").alias("name_key"), F.col("n_regionkey").cast("double").alias("b"))
    q = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), (F.col("l_partkey") % 25).alias("name_key"))
    j = q.join(by_code, "code", "left").join(by_name, "name_key", "left").withColumn("at", F.coalesce("a", "b"))
    return j.agg(F.count("at").alias("located"), F.count_if(F.col("at").isNull()).alias("dropped"), F.round(F.sum("at"), 2).alias("total"))


def distinct_list(spark, sf_dir):
    """Sorted distinct names per group as text, and their count."""
    z = layer(spark, sf_dir, "zones")
    return z.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_set("flood_zone")), ", ").alias("zones"), F.count_distinct("flood_zone").alias("n"))


def mode_by_group(spark, sf_dir):
    """Most common category per brand, smallest on ties."""
    return A.mode_by(layer(spark, sf_dir, "pois"), ["brand"], "category", "usual")


def layer_inventory(spark, sf_dir):
    """Feature counts and extents of all point layers."""
    out = None
    for name, key in (("structures", "fd_id"), ("sites", "loc_id"), ("pois", "poi_id"), ("substations", "sub_id"), ("queue", "queue_id"), ("plants", "plant_id")):
        part = layer(spark, sf_dir, name).select(F.lit(name).alias("layer"), "lng", "lat")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("lng"), 4).alias("minx"), F.round(F.min("lat"), 4).alias("miny"),
        F.round(F.max("lng"), 4).alias("maxx"), F.round(F.max("lat"), 4).alias("maxy"),
    )


def json_properties(spark, sf_dir):
    """JSON attributes parsed and re-projected without the geometry."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.select("event_id", "k", F.to_json(F.struct("event_type", "user_id")).alias("properties"))


def json_distinct(spark, sf_dir):
    """Distinct values of a property inside JSON attributes, with their rows."""
    e = table(spark, sf_dir, "events").select(F.from_json("props", "k long")["k"].alias("k"))
    return e.filter(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def geojson_points(spark, sf_dir):
    """K5: one GeoJSON feature per row."""
    s = layer(spark, sf_dir, "sites").select("loc_id", "segment", "lng", "lat")
    return sinks.point_features(s, ["loc_id", "segment"]).select(F.get_json_object("value", "$.properties.loc_id").cast("long").alias("loc_id"),
        F.get_json_object("value", "$.geometry.type").alias("kind"), F.get_json_object("value", "$.properties.segment").alias("segment"))


# ── parsing and labels ──────────────────────────────────────────────────────
def scalar_parsing(spark, sf_dir):
    """X7, X8, X24, X25, S33 on text built from the keys."""
    k = F.col("p_partkey")
    t = k.cast("string")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    volts = F.when(k % 4 == 0, F.concat(t, F.lit("000"))).when(k % 4 == 1, F.concat(t, F.lit(" kV"))).when(k % 4 == 2, F.concat(F.lit("69000;"), t)).otherwise("none")
    soil = F.when(k % 3 == 0, F.concat((k % 10).cast("string"), F.lit("e"))).when(k % 3 == 1, "NR")
    pair = F.when(k % 5 != 0, F.concat(((k % 200) - 100).cast("string"), F.lit(".5, "), ((k % 300) - 150).cast("string"), F.lit(".25"))).otherwise("Main Street")
    lat, lng = S.coordinate_pair(pair)
    return p.select(
        "p_partkey", S.voltage_kv(volts).alias("kv"), S.soil_class(soil).alias("soil"), F.round(S.dms_degrees(k * 157), 8).alias("dms"),
        S.fips5(F.when(k % 2 == 0, t).otherwise(F.concat(t, F.lit(".0")))).alias("fips"), lat.alias("lat"), lng.alias("lng"),
    )


def land_cover_labels(spark, sf_dir):
    """Land-cover class, group, score; zoning category; drainage."""
    s = layer(spark, sf_dir, "sites")
    return s.select(
        "loc_id", S.nlcd_label("nlcd_code").alias("label"), S.nlcd_group("nlcd_code").alias("grp"), S.nlcd_score("nlcd_code").alias("score"),
        S.land_use_category("zone_code").alias("land_use"), S.drainage_score("drainage_class", "hydric_rating").alias("drainage"),
    )


# ── rasters ─────────────────────────────────────────────────────────────────
def _clean(spark, sf_dir, value):
    r = layer(spark, sf_dir, "raster")
    return r.select("row", "col", F.when(F.col(value) > -9999, F.col(value)).cast("double").alias(value))


def raster_slope(spark, sf_dir):
    """Slope and aspect from central differences."""
    out = G.slope_aspect(_clean(spark, sf_dir, "dem"), "dem", 30.0, 30.0)
    return out.select("row", "col", F.round("slope_deg", 6).alias("slope_deg"), F.round("aspect_deg", 5).alias("aspect_deg"))


def raster_focal(spark, sf_dir):
    """Means over 30, 100 and 300 m disks, one shuffle."""
    out = G.focal_means(_clean(spark, sf_dir, "canopy"), "canopy", {"c30": 1.0, "c100": 100 / 30, "c300": 10.0})
    return out.select("row", "col", *[F.round(c, 7).alias(c) for c in ("c30", "c100", "c300")])


def raster_distance(spark, sf_dir):
    """Metres from each cell to the nearest burnable cell."""
    r = layer(spark, sf_dir, "raster").select("row", "col", "fbfm40")
    out = G.distance_to(r, ~F.col("fbfm40").isin(*K.NON_BURNABLE_FUELS), 30.0)
    return out.select("row", "col", F.round("distance_m", 5).alias("distance_m"))




def raster_sample(spark, sf_dir):
    """Raster values at properties; outside and nodata give null."""
    pts = layer(spark, sf_dir, "properties").select("property_id", "lng", "lat")
    out = G.sample(pts, layer(spark, sf_dir, "raster"), ["dem", "canopy"], -9999.0, **RASTER_AFFINE)
    return out.select("property_id", "row", "col", "dem", F.col("canopy").cast("double").alias("canopy"))


def slope_at_properties(spark, sf_dir):
    """Slope and aspect of the raster, read at every property."""
    terrain = G.slope_aspect(_clean(spark, sf_dir, "dem"), "dem", 30.0, 30.0)
    pts = layer(spark, sf_dir, "properties").select("property_id", "lng", "lat")
    out = G.sample(pts, terrain, ["slope_deg", "aspect_deg"], -9999.0, **RASTER_AFFINE)
    return out.select("property_id", F.round("slope_deg", 6).alias("slope_deg"), F.round("aspect_deg", 5).alias("aspect_deg"))


def raster_summary(spark, sf_dir):
    """Six rasters sampled at the properties: known values, extremes, quartiles and tails of each."""
    raster = layer(spark, sf_dir, "raster")
    canopy = F.col("canopy").cast("double")
    terrain = G.slope_aspect(_clean(spark, sf_dir, "dem"), "dem", 30.0, 30.0)
    disks = G.focal_means(_clean(spark, sf_dir, "canopy"), "canopy", {"canopy_30m": 1.0, "canopy_300m": 10.0})
    names = ["dem", "canopy", "slope_deg", "aspect_deg", "canopy_30m", "canopy_300m"]
    cells = raster.select("row", "col", "dem", canopy.alias("canopy")).join(terrain.select("row", "col", "slope_deg", "aspect_deg"), ["row", "col"], "left").join(disks, ["row", "col"], "left")
    pts = layer(spark, sf_dir, "properties").select("property_id", "lng", "lat")
    long = G.sample(pts, cells, names, -9999.0, **RASTER_AFFINE).unpivot(["property_id"], names, "raster", "value").filter("value IS NOT NULL")
    probs = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    marks = A.quantile_columns(long, "value", probs, ["raster"])
    ends = long.groupBy("raster").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return ends.join(marks, "raster").select("raster", "n", *[F.round(c, 4).alias(c) for c in ("least", *probs, "most")])


def raster_nearest(spark, sf_dir):
    """Value of the cell that holds each centre, by the nearest form."""
    pts = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    return G.resample_nearest(pts, layer(spark, sf_dir, "raster").select("row", "col", "dem"), "dem", -9999.0, **RASTER_AFFINE).select("loc_id", "dem")


def raster_resample(spark, sf_dir):
    """Bilinear value at arbitrary centres with missing cells dropped."""
    pts = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    out = G.resample_bilinear(pts, ["loc_id"], layer(spark, sf_dir, "raster").select("row", "col", "dem"), "dem", -9999.0, **RASTER_AFFINE)
    return out.select("loc_id", F.round("dem", 6).alias("dem"))


def terrain_lattice(spark, sf_dir):
    """Slope, dominant aspect, irradiance factor and spread of each parcel from the raster."""
    own = parcels(spark, sf_dir).select("loc_id", "lng", "lat", "acres")
    pts = L.parcel_elevations(own, "loc_id", layer(spark, sf_dir, "raster"), "dem", -9999.0, 5, **RASTER_AFFINE)
    out = L.terrain_stage(pts, "loc_id")
    return out.select("loc_id", "interior_cells", F.round("mean_slope_pct", 6).alias("mean_slope_pct"), F.round("dominant_aspect_deg", 4).alias("dominant_aspect_deg"),
                      F.round("elev_std_m", 6).alias("elev_std_m"), "terrain_rating", F.round("irradiance_factor", 3).alias("irradiance_factor"))


# ── audit ───────────────────────────────────────────────────────────────────
def audit_events(spark, sf_dir):
    """Ordered trail of every flood run."""
    scored = H.flood_risk(flood_inputs(spark, sf_dir), catalog.damage_curves(spark))
    return U.flood_trail(scored, "fd_id")


def module_history(spark, sf_dir):
    """Runs of one module, newest first."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("module"), F.col("ts").alias("started_at"), "event_id")
    return U.module_history(e, "purchase").select("event_id", "module")


def methodology_hash(spark, sf_dir):
    """Hash of canonical JSON with sorted keys, run keys dropped."""
    n = table(spark, sf_dir, "orders")
    fields = {"zeta": F.col("o_orderstatus"), "alpha": F.col("o_orderkey"), "mid": F.col("o_orderpriority"), "run_id": F.col("o_custkey")}
    return n.select("o_orderkey", U.methodology_hash(fields).alias("hash"))


def audit_stream_once(spark, sf_dir):
    """U2 as a stream: an execution that is already stored is not stored again."""
    raw = audit_stream.read_events(spark, sf_dir, "event_id long, ts timestamp_ntz, event_type string", "events.parquet")
    feed = raw.withColumn("execution_id", F.floor(F.col("event_id") / 4)).select("execution_id", "ts")
    out = scratch_folder(spark, "audit")
    query = audit_stream.append_audit(feed, out, scratch_folder(spark, "audit-state"))
    query.awaitTermination()
    return spark.read.parquet(out).select("execution_id")


QUERIES = {f.__name__: f for f in (
    dominant_component, upsert_latest, backfill, table_diff, resume_antijoin, append_new, dedup_first, lookup_found, centroid_fallback,
    distinct_list, mode_by_group, layer_inventory, json_properties, json_distinct, geojson_points, scalar_parsing, land_cover_labels, raster_slope,
    raster_focal, raster_distance, raster_sample, slope_at_properties, raster_summary, raster_nearest, raster_resample, terrain_lattice, audit_events, module_history, methodology_hash,
    audit_stream_once,
)}

VERSIONS = """old AS (SELECT o_orderkey, o_totalprice, 1 AS version FROM orders WHERE o_orderstatus <> 'P'),
new AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS version FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"""
RASTER = cte("raster")
_POINT_LAYERS = ("structures", "sites", "pois", "substations", "queue", "plants")


def _kernel(radius: float) -> str:
    return ", ".join(f"({dy}, {dx})" for dy, dx in G.disk_offsets(radius))


def _focal(name: str, radius: float) -> str:
    return f"""{name} AS (SELECT c."row", c."col", avg(n.v) AS m FROM v c CROSS JOIN (VALUES {_kernel(radius)}) AS k(dy, dx)
  JOIN v n ON n."row" = c."row" + k.dy AND n."col" = c."col" + k.dx WHERE c.v IS NOT NULL GROUP BY ALL)"""


_SLOPES = """
, v AS (SELECT "row", "col", CASE WHEN dem > -9999 THEN dem END AS z FROM raster), x AS (SELECT min("row") AS r0, max("row") AS r1, min("col") AS c0, max("col") AS c1 FROM v),
d AS (SELECT c."row", c."col", c.z,
  CASE WHEN c."col" = c0 THEN (e.z - c.z) / 30e0 WHEN c."col" = c1 THEN (c.z - w.z) / 30e0 ELSE (e.z - w.z) / 60e0 END AS dx,
  CASE WHEN c."row" = r0 THEN (s.z - c.z) / 30e0 WHEN c."row" = r1 THEN (c.z - n.z) / 30e0 ELSE (s.z - n.z) / 60e0 END AS ds
  FROM v c CROSS JOIN x LEFT JOIN v e ON e."row" = c."row" AND e."col" = c."col" + 1 LEFT JOIN v w ON w."row" = c."row" AND w."col" = c."col" - 1
  LEFT JOIN v s ON s."col" = c."col" AND s."row" = c."row" + 1 LEFT JOIN v n ON n."col" = c."col" AND n."row" = c."row" - 1)"""
_AT_PROPERTIES = 'SELECT property_id, CAST(floor((49e0 - lat) / 0.192e0) AS BIGINT) AS "row", CAST(floor((lng + 125e0) / (58e0 / 120)) AS BIGINT) AS "col" FROM properties'

ORACLES = {
    "dominant_component": """SELECT l_orderkey, l_quantity, l_partkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) = 1""",
    "upsert_latest": f"""WITH {VERSIONS} SELECT o_orderkey, o_totalprice, version FROM (SELECT *, 0 AS src FROM old UNION ALL SELECT *, 1 FROM new)
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC, src DESC) = 1""",
    "backfill": f"""WITH {VERSIONS} SELECT o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM old o LEFT JOIN new n USING (o_orderkey)""",
    "table_diff": f"""WITH {VERSIONS} SELECT CASE WHEN o.version IS NULL THEN 'new' WHEN n.version IS NULL THEN 'removed' WHEN n.o_totalprice <> o.o_totalprice THEN 'changed' ELSE 'same' END AS status,
  count(*) AS n, round(sum(abs(n.o_totalprice - o.o_totalprice)), 2) AS moved FROM new n FULL JOIN old o USING (o_orderkey) GROUP BY 1""",
    "resume_antijoin": with_ctes("structures", body="SELECT fd_id, tract FROM structures WHERE fd_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "append_new": """SELECT event_id % 4000 AS execution_id, min(event_id) AS event_id FROM events
WHERE event_id % 4000 NOT IN (SELECT event_id % 4000 FROM events WHERE event_type = 'error') GROUP BY 1""",
    "dedup_first": "SELECT p_name, p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY ALL",
    "lookup_found": with_ctes("sites", body="""
SELECT loc_id, n_name, n_name IS NOT NULL AS found_in_dataset FROM sites LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON nation_id = n_nationkey"""),
    "centroid_fallback": """WITH j AS (SELECT coalesce(s_acctbal, n_regionkey::DOUBLE) AS pt FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 2000) s ON l_suppkey = s_suppkey
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) n ON l_partkey % 25 = n_nationkey)
SELECT count(pt) AS located, count(*) - count(pt) AS dropped, round(sum(pt), 2) AS total FROM j""",
    "distinct_list": with_ctes("zones", body="""
SELECT kind, array_to_string(list_sort(list(DISTINCT flood_zone)), ', ') AS zones, count(DISTINCT flood_zone) AS n FROM zones GROUP BY kind"""),
    "mode_by_group": with_ctes("pois", body="""
, c AS (SELECT brand, category, count(*) AS n FROM pois GROUP BY ALL) SELECT brand, arg_min(category, (-n, category)) AS usual FROM c GROUP BY brand"""),
    "layer_inventory": with_ctes(*_POINT_LAYERS, body="SELECT layer, count(*) AS n, round(min(lng), 4) AS minx, round(min(lat), 4) AS miny, round(max(lng), 4) AS maxx, round(max(lat), 4) AS maxy FROM ("
        + " UNION ALL ".join(f"SELECT '{n}' AS layer, lng, lat FROM {n}" for n in _POINT_LAYERS) + ") GROUP BY layer"),
    "json_properties": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('{"event_type":"', event_type, '","user_id":', user_id, '}') AS properties FROM events""",
    "json_distinct": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1",
    "geojson_points": with_ctes("sites", body="SELECT loc_id, 'Point' AS kind, segment FROM sites"),
    "scalar_parsing": """WITH p AS (SELECT p_partkey AS k FROM part), t AS (SELECT k, CASE k % 4 WHEN 0 THEN k * 1000e0 WHEN 1 THEN k * 1e0 WHEN 2 THEN greatest(69000e0, k * 1e0) END AS v,
    CASE WHEN k % 3 = 0 THEN k % 10 END AS s, k * 157 AS d, (k % 200) - 100 AS la, (k % 300) - 150 AS lo FROM p),
c AS (SELECT *, CASE WHEN k % 5 <> 0 THEN CASE WHEN la < 0 THEN la - 0.5e0 ELSE la + 0.5e0 END END AS lat, CASE WHEN lo < 0 THEN lo - 0.25e0 ELSE lo + 0.25e0 END AS lng FROM t)
SELECT k AS p_partkey, CASE WHEN v > 1000 THEN round_even(v / 1000e0, 0) ELSE round_even(v, 0) END AS kv, CASE WHEN s BETWEEN 1 AND 8 THEN s END AS soil,
  CASE WHEN d <> 0 THEN round(d // 10000 + (d // 100) % 100 / 60e0 + d % 100 / 3600e0, 8) END AS dms, lpad(k::STRING, 5, '0') AS fips,
  CASE WHEN lat BETWEEN -90 AND 90 THEN lat END AS lat, CASE WHEN lat BETWEEN -90 AND 90 THEN lng END AS lng FROM c""",
    "land_cover_labels": with_ctes("sites", body="""
, lc AS (SELECT * FROM (VALUES (11, 'Open Water', 'water', 0e0), (21, 'Developed, Open Space', 'developed', 0.3e0), (23, 'Developed, Medium Intensity', 'developed', 0e0),
  (31, 'Barren Land (Rock/Sand/Clay)', 'barren', 0.9e0), (42, 'Evergreen Forest', 'forest', 0.3e0), (52, 'Shrub/Scrub', 'shrubland', 0.6e0), (71, 'Grassland/Herbaceous', 'grassland', 0.7e0),
  (81, 'Pasture/Hay', 'cropland', 0.8e0), (82, 'Cultivated Crops', 'cropland', 0.9e0)) AS v(nlcd_code, label, grp, score))
SELECT loc_id, label, grp, score, CASE zone_code WHEN 'A-1' THEN 'agricultural' WHEN 'R-1' THEN 'residential' WHEN 'C-2' THEN 'commercial' WHEN 'M-1' THEN 'industrial' ELSE 'rural' END AS land_use,
  CASE WHEN hydric_rating = 'Yes' THEN 0.2e0 WHEN drainage_class = 'Well drained' THEN 1e0 WHEN drainage_class = 'Moderately well drained' THEN 0.8e0
    WHEN drainage_class = 'Somewhat poorly drained' THEN 0.5e0 WHEN drainage_class = 'Poorly drained' THEN 0.3e0 ELSE 0.6e0 END AS drainage FROM sites JOIN lc USING (nlcd_code)"""),
    "raster_slope": with_ctes("raster", body=_SLOPES + """
SELECT "row", "col", round(degrees(atan(sqrt(dx * dx + ds * ds))) + 0e0 * z, 6) AS slope_deg,
  CASE WHEN sqrt(dx * dx + ds * ds) >= 1e-4 AND z IS NOT NULL THEN round((degrees(atan2(-dx, ds)) + 360e0) % 360e0, 5) END AS aspect_deg FROM d"""),
    "slope_at_properties": with_ctes("properties", "raster", body=_SLOPES + f""", t AS (SELECT "row", "col", degrees(atan(sqrt(dx * dx + ds * ds))) + 0e0 * z AS slope,
  CASE WHEN sqrt(dx * dx + ds * ds) >= 1e-4 AND z IS NOT NULL THEN (degrees(atan2(-dx, ds)) + 360e0) % 360e0 END AS aspect FROM d)
SELECT property_id, round(slope, 6) AS slope_deg, round(aspect, 5) AS aspect_deg FROM ({_AT_PROPERTIES}) p LEFT JOIN t USING ("row", "col")"""),
    "raster_summary": with_ctes("properties", "raster", 'v0 AS (SELECT "row", "col", CASE WHEN canopy > -9999 THEN canopy::DOUBLE END AS v FROM raster)', body=_SLOPES + f""",
near AS (SELECT c."row", c."col", avg(o.v) FILTER (WHERE pow(o."row" - c."row", 2) + pow(o."col" - c."col", 2) <= 1) AS f30, avg(o.v) AS f300 FROM v0 c JOIN v0 o
  ON o."row" BETWEEN c."row" - 10 AND c."row" + 10 AND pow(o."row" - c."row", 2) + pow(o."col" - c."col", 2) <= 100 GROUP BY ALL),
t AS (SELECT d."row", d."col", z AS dem, v0.v AS canopy, degrees(atan(sqrt(dx * dx + ds * ds))) + 0e0 * z AS slope_deg,
  CASE WHEN sqrt(dx * dx + ds * ds) >= 1e-4 AND z IS NOT NULL THEN (degrees(atan2(-dx, ds)) + 360e0) % 360e0 END AS aspect_deg, CASE WHEN v0.v IS NOT NULL THEN f30 END AS canopy_30m, CASE WHEN v0.v IS NOT NULL THEN f300 END AS canopy_300m
  FROM d JOIN v0 USING ("row", "col") JOIN near USING ("row", "col")),
long AS (UNPIVOT (SELECT dem, canopy, slope_deg, aspect_deg, canopy_30m, canopy_300m FROM ({_AT_PROPERTIES}) p JOIN t USING ("row", "col")) ON dem, canopy, slope_deg, aspect_deg, canopy_30m, canopy_300m INTO NAME raster VALUE value)
SELECT raster, count(*) AS n, round(min(value), 4) AS least, round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS median,
  round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS most FROM long GROUP BY raster"""),
    "raster_nearest": with_ctes("sites", "raster", body="""
SELECT loc_id, CASE WHEN dem <> -9999 THEN dem END AS dem FROM (SELECT loc_id, CAST(floor((49e0 - lat) / 0.192e0) AS BIGINT) AS "row", CAST(floor((lng + 125e0) / (58e0 / 120)) AS BIGINT) AS "col" FROM sites) LEFT JOIN raster USING ("row", "col")"""),
    "raster_focal": with_ctes("raster", 'v AS (SELECT "row", "col", CASE WHEN canopy > -9999 THEN canopy::DOUBLE END AS v FROM raster)', _focal("a", 1.0), _focal("b", 100 / 30), _focal("c", 10.0), body="""
SELECT v."row", v."col", round(a.m, 7) AS c30, round(b.m, 7) AS c100, round(c.m, 7) AS c300 FROM v LEFT JOIN a USING ("row", "col") LEFT JOIN b USING ("row", "col") LEFT JOIN c USING ("row", "col")"""),
    "raster_distance": with_ctes("raster", body="""
, t AS (SELECT "row" AS tr, "col" AS tc FROM raster WHERE fbfm40 NOT IN (0, 91, 92, 93, 98, 99, -9999, 255))
SELECT r."row", r."col", round(min(sqrt(pow(r."row" - tr, 2) + pow(r."col" - tc, 2))) * 30e0, 5) AS distance_m FROM raster r JOIN t ON abs(r."row" - tr) <= 6 AND abs(r."col" - tc) <= 6 GROUP BY ALL"""),
    "raster_sample": with_ctes("properties", "raster", body="""
, p AS (SELECT property_id, CAST(floor((49e0 - lat) / 0.192e0) AS BIGINT) AS "row", CAST(floor((lng + 125e0) / (58e0 / 120)) AS BIGINT) AS "col" FROM properties)
SELECT property_id, "row", "col", CASE WHEN dem <> -9999 THEN dem END AS dem, CASE WHEN canopy <> -9999 THEN canopy::DOUBLE END AS canopy FROM p LEFT JOIN raster USING ("row", "col")"""),
    "raster_resample": with_ctes("sites", "raster", body="""
, f AS (SELECT loc_id, (lng + 125e0) / (58e0 / 120) - 0.5e0 AS fx, (49e0 - lat) / 0.192e0 - 0.5e0 AS fy FROM sites),
k AS (SELECT loc_id, CAST(floor(fy) AS BIGINT) + dr AS "row", CAST(floor(fx) AS BIGINT) + dc AS "col",
  CASE WHEN dr = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END * CASE WHEN dc = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END AS w
  FROM f CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dr, dc))
SELECT loc_id, round(sum(w * dem) / sum(CASE WHEN dem IS NOT NULL THEN w END), 6) AS dem FROM k LEFT JOIN (SELECT * FROM raster WHERE dem <> -9999) USING ("row", "col") GROUP BY loc_id"""),
    "terrain_lattice": with_ctes("sites", "raster", PARCELS, TERRAIN, body="""
, g AS (SELECT loc_id, sqrt(dx * dx + dy * dy) AS g, radians((degrees(atan2(-dx, -dy)) + 360e0) % 360e0) AS a FROM inner_points),
m AS (SELECT loc_id, count(*) AS n, avg(g) AS g, sum(g * sin(a)) AS x, sum(g * cos(a)) AS y FROM g GROUP BY loc_id), s AS (SELECT loc_id, stddev_pop(z) AS sd FROM elevations GROUP BY loc_id),
t AS (SELECT *, CASE WHEN sqrt(x * x + y * y) > 1e-9 THEN (degrees(atan2(x, y)) + 360e0) % 360e0 END AS aspect FROM m JOIN s USING (loc_id))
SELECT loc_id, n AS interior_cells, round(g * 100e0, 6) AS mean_slope_pct, round(aspect, 4) AS dominant_aspect_deg,
  round(sd, 6) AS elev_std_m, CASE WHEN sd < 2 THEN 'flat' WHEN sd < 5 THEN 'gently rolling' WHEN sd < 15 THEN 'variable' ELSE 'steep/irregular' END AS terrain_rating,
  CASE WHEN aspect IS NULL OR g * 100e0 < 1 THEN 1e0 ELSE round(greatest(0.7e0, least(1e0, cos(radians(least(abs(aspect - 180e0), 360e0 - abs(aspect - 180e0)))))), 3) END AS irradiance_factor FROM t"""),
    "audit_events": with_ctes("structures", "zones", ZONE_EDGES, inside("structures", "fd_id"), FLOOD_IN, curves_sql(), body=f"""
, hit AS (SELECT w.*, v.s, v.c {NEAREST_CURVE.format('wet')}),
l AS (SELECT *, (val_struct * coalesce(s, 0e0) / 100e0 + val_cont * coalesce(c, 0e0) / 100e0) * aep AS usd, sfha AND coalesce(static_bfe <= -9000, TRUE) AS warn FROM hit),
e AS (SELECT fd_id, 0 AS o, 'data_source' AS kind, 'flood_zones' AS name, 'polygon layer' AS value, NULL AS source FROM l
  UNION ALL SELECT fd_id, 1, 'step', 'flood_zone_lookup', coalesce(flood_zone, 'none'), 'flood_zones' FROM l
  UNION ALL SELECT fd_id, 2, 'advisory', 'bfe_unavailable', 'nominal depth used', 'flood_zones' FROM l WHERE warn
  UNION ALL SELECT fd_id, 3, 'step', 'damage_lookup', ddf_class, 'damage_curves' FROM l UNION ALL SELECT fd_id, 4, 'factor', 'risk_tier', {TIER.format('usd')}, NULL FROM l)
SELECT fd_id::STRING AS execution_id, row_number() OVER (PARTITION BY fd_id ORDER BY o) - 1 AS seq, kind, name, value, source FROM e"""),
    "module_history": "SELECT event_id, event_type AS module FROM events WHERE event_type = 'purchase' ORDER BY ts DESC",
    "methodology_hash": """SELECT o_orderkey, sha256(concat('{"alpha":', o_orderkey, ',"mid":"', o_orderpriority, '","zeta":"', o_orderstatus, '"}')) AS hash FROM orders""",
    "audit_stream_once": "SELECT DISTINCT CAST(floor(event_id / 4e0) AS BIGINT) AS execution_id FROM events",
}
