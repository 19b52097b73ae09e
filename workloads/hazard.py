"""Hazard and portfolio queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import constants as K
from parcelwise.functions import geo, narrative
from parcelwise.functions import scoring as S
from parcelwise.operators import overlap
from parcelwise.operators import spatial as X
from parcelwise.plans import hazard as H
from parcelwise.plans import model as M
from parcelwise.plans import portfolio as P
from parcelwise.plans import selection as E
from parcelwise.sources import catalog

from .layers import CROSSES, ZONE_EDGES, as_features, hav, inside, layer, with_ctes
from .loss import C
from .solar import available_sql, sites_with_sources
from .spatial import segment_sql, zone_cell, zones


def flood_inputs(spark, sf_dir):
    """Structures with the attributes of the lowest-numbered zone they lie in."""
    s = layer(spark, sf_dir, "structures")
    z = zones(spark, sf_dir, "zone_id", "flood_zone", "zone_subtype", "static_bfe")
    return X.first_polygon(s, z, zone_cell(spark, sf_dir), "fd_id", "zone_id", ["flood_zone", "zone_subtype", "static_bfe"])


def wildfire_records(spark, sf_dir):
    props = layer(spark, sf_dir, "properties").select("property_id", "lng", "lat")
    return H.wildfire_property_risk(props, layer(spark, sf_dir, "structures"), "property_id")


def wildfire_risk(spark, sf_dir):
    """H1, H2, M8: structure-model risk of every property."""
    out = wildfire_records(spark, sf_dir)
    return out.select(
        "property_id", "fd_id", F.round("dist", 1).alias("match_m"), F.round("damage_probability", 5).alias("damage_probability"),
        F.round("annual_risk_usd", 3).alias("annual_risk_usd"), "risk_tier", "exceeds_threshold",
    )


def model_probability(spark, sf_dir):
    """M8: the fitted model applied to every structure; null where a predictor is missing."""
    out = M.apply_model(layer(spark, sf_dir, "structures"), K.WILDFIRE_COEFFICIENTS, K.WILDFIRE_THRESHOLD)
    return out.select("fd_id", F.round("log_odds", 6).alias("log_odds"), F.round("p_destroyed", 6).alias("p_destroyed"), "exceeds")


def wildfire_narrative(spark, sf_dir):
    """Tier, money and the first two risk factors in a sentence."""
    out = wildfire_records(spark, sf_dir).filter(F.col("fd_id").isNotNull())
    return out.select("property_id", narrative.wildfire_summary().alias("summary"))


def wildfire_proxy(spark, sf_dir):
    """Fire history × damage factor × value."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    fires = zones(spark, sf_dir, "zone_id", "zone_name", "year_num")
    near = overlap.boundary_distances(sites, fires, "loc_id", "zone_id", ["zone_name", "year_num"], 5_000.0, zone_cell(spark, sf_dir))
    freq = H.fire_frequency(near, "loc_id", "zone_name", "year_num")
    k = F.col("loc_id")
    inputs = sites.join(freq, "loc_id", "left").withColumns(
        {
            "burnable": F.when(k % 3 == 0, True).when(k % 3 == 1, False),
            "canopy_pct": F.when(k % 5 != 0, (k % 101).cast("double")),
            "replacement_value": F.when(k % 7 == 0, 0.0).otherwise((k * 131 % 900000).cast("double")),
        }
    )
    out = H.wildfire_proxy(inputs)
    return out.select(
        "loc_id", F.coalesce("fire_count", F.lit(0)).alias("fire_count"), F.round("damage_probability", 6).alias("damage_probability"),
        F.round("annual_risk_usd", 3).alias("annual_risk_usd"), "risk_tier",
    )


def flood_risk(spark, sf_dir):
    """Zone, depth, damage curve and yearly loss."""
    out = H.flood_risk(flood_inputs(spark, sf_dir), catalog.damage_curves(spark))
    return out.select(
        "fd_id", "flood_zone", "ddf_class", F.round("depth_ft", 4).alias("depth_ft"), "structural_damage_pct", "contents_damage_pct",
        F.round("annual_risk_usd", 3).alias("annual_risk_usd"), "risk_tier",
    )


def ddf_lookup(spark, sf_dir):
    """Damage row nearest in depth for arbitrary depths and classes."""
    s = layer(spark, sf_dir, "structures").select(
        "fd_id", S.ddf_class("occtype", "num_story", "found_type").alias("ddf_class"), ((F.col("fd_id") * 77 % 3600) / 100.0 - 6.0).alias("depth_ft")
    )
    return H.damage_at_depth(s, catalog.damage_curves(spark)).select(
        "fd_id", "ddf_class", "structural_damage_pct", "contents_damage_pct"
    )


def quake_damage(spark, sf_dir):
    """Fragility and design-event loss of every structure."""
    out = H.quake_risk(layer(spark, sf_dir, "structures"))
    return out.select(
        "fd_id", "building_type", "code_level", "site_class", F.round("pga_g", 5).alias("pga_g"),
        F.round("p_moderate", 6).alias("p_moderate"), F.round("damage_ratio", 6).alias("damage_ratio"),
        F.round("annual_risk_usd", 3).alias("annual_risk_usd"), "risk_tier", "hazard_label",
    )


def hazard_worst(spark, sf_dir):
    """Both perils per site with sources, and the worse tier."""
    base = sites_with_sources(spark, sf_dir)
    k = F.col("loc_id")
    rows = E.select_data(base, catalog.HAZARD).withColumns(
        {
            "wildfire_usd": F.when(k % 6 != 0, (k * 17 % 900).cast("double")),
            "flood_usd": F.when(k % 5 != 0, (k * 29 % 1100).cast("double")),
        }
    )
    return H.hazard_score(rows).select("loc_id", "wildfire_tier", "flood_tier", "worst_tier", "wildfire_usd", "flood_usd")


def nearest_nsi(spark, sf_dir):
    """Nearest structure in a ±0.005° box by squared degrees, flat metres."""
    props = layer(spark, sf_dir, "properties").select("property_id", "lng", "lat")
    feats = as_features(layer(spark, sf_dir, "structures").select("fd_id", "occtype", "bldgtype", "lng", "lat"))
    pairs = X.within_radius(props, feats, 0.0071, geo.DEGREE).filter(
        (F.abs(F.col("lng") - F.col("f_lng")) <= 0.005) & (F.abs(F.col("lat") - F.col("f_lat")) <= 0.005)
    )
    best = pairs.groupBy("property_id").agg(F.min(F.struct("dist", "fd_id", "occtype", "bldgtype")).alias("b"))
    return props.select("property_id").join(best, "property_id", "left").select(
        "property_id", "b.fd_id", F.round(F.col("b.dist") * K.METRES_PER_DEGREE, 2).alias("dist_m"),
        F.when(F.col("b").isNotNull(), S.building_label("b.occtype", "b.bldgtype")).alias("building"),
    )


def portfolio_records(spark, sf_dir):
    rec = wildfire_records(spark, sf_dir)
    props = layer(spark, sf_dir, "properties").select("property_id", "lng", "lat")
    held = X.polygon_flags(props, zones(spark, sf_dir), zone_cell(spark, sf_dir), "property_id", {"in_perimeter": F.lit(True)})
    return P.portfolio_status(rec.join(held.select("property_id", "in_perimeter"), "property_id", "left"))


def portfolio_summary(spark, sf_dir):
    """P1, A5, A6."""
    return P.portfolio_summary(portfolio_records(spark, sf_dir))


def portfolio_histogram(spark, sf_dir):
    """A4: buckets that do not overlap, empty ones included."""
    return P.portfolio_histogram(wildfire_records(spark, sf_dir)).select("bucket", "n")


def portfolio_top10(spark, sf_dir):
    """P1, W8."""
    out = wildfire_records(spark, sf_dir).filter(F.col("annual_risk_usd").isNotNull())
    top = out.orderBy(F.desc("annual_risk_usd"), "property_id").limit(10)
    return top.select("property_id", F.round("annual_risk_usd", 3).alias("annual_risk_usd"))


def risk_drivers(spark, sf_dir):
    """The two features that set each property apart from the portfolio."""
    rec = P.portfolio_status(wildfire_records(spark, sf_dir))
    out = P.risk_drivers(rec).filter(F.col("status") == "scored")
    return out.select("property_id", F.array_join("drivers", "; ").alias("drivers"))


QUERIES = {f.__name__: f for f in (
    wildfire_risk, model_probability, wildfire_narrative, wildfire_proxy, flood_risk, ddf_lookup, quake_damage, hazard_worst, nearest_nsi,
    portfolio_summary, portfolio_histogram, portfolio_top10, risk_drivers,
)}

# ── SQL twins ───────────────────────────────────────────────────────────────
TIER = "CASE WHEN {0} > 500 THEN 'HIGH' WHEN {0} >= 50 THEN 'MODERATE' WHEN {0} IS NOT NULL THEN 'LOW' END"
RECORDS = f"""near AS (SELECT p.property_id, t.*, {hav('p.lng', 'p.lat', 't.lng', 't.lat')} AS d,
    sqrt(pow(p.lng - t.lng, 2) + pow(p.lat - t.lat, 2)) AS deg
  FROM properties p JOIN structures t ON abs(p.lat - t.lat) < 0.02 AND abs(p.lng - t.lng) < 0.02),
picked AS (SELECT * FROM (SELECT * EXCLUDE (lng, lat, segment) FROM near QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY deg, fd_id) = 1) WHERE d <= 500),
model AS (SELECT p.property_id, p.lng, p.lat, k.fd_id, k.d, k.val_struct, coalesce(burn_probability, 0) AS bp, coalesce(distance_to_fuel_m, 0) AS df,
    coalesce(canopy_cover_100m, 0) AS cc, coalesce(slope_degrees, 0) AS sl,
    1e0 / (1e0 + exp(-({C['const']!r} + {C['burn_probability']!r} * burn_probability + {C['distance_to_fuel_m']!r} * distance_to_fuel_m
      + {C['canopy_cover_100m']!r} * coalesce(canopy_cover_100m, 0) + {C['slope_degrees']!r} * slope_degrees
      + {C['is_res1']!r} * CASE WHEN occtype LIKE 'RES1%' THEN 1e0 ELSE 0e0 END))) AS p_destroyed
  FROM properties p LEFT JOIN picked k USING (property_id)),
records AS (SELECT *, bp * p_destroyed * val_struct AS risk FROM model)"""
BASE = ("properties", "structures", RECORDS)

FLOOD_IN = """zoned AS (SELECT s.*, z.flood_zone, z.zone_subtype, z.static_bfe FROM structures s LEFT JOIN (
    SELECT fd_id, min(zone_id) AS zone_id FROM zone_hits GROUP BY fd_id) h USING (fd_id) LEFT JOIN zones z USING (zone_id)),
depths AS (SELECT *, coalesce(flood_zone LIKE 'A%' OR flood_zone LIKE 'V%', FALSE) AS sfha, coalesce(found_ht, 1e0) AS ffh FROM zoned),
wet AS (SELECT *, CASE WHEN sfha THEN coalesce(CASE WHEN static_bfe > -9000 THEN static_bfe END - ground_elv_ft - ffh, 3e0 - ffh) END AS depth_ft,
  CASE WHEN sfha THEN 0.01e0 WHEN flood_zone = 'X' AND zone_subtype LIKE '0.2%' THEN 0.002e0 ELSE 0.001e0 END AS aep,
  CASE WHEN occtype LIKE 'RES1%' THEN concat('RES1-', CASE WHEN num_story >= 2 THEN '2' ELSE '1' END, 'S', CASE WHEN found_type = 'B' THEN 'W' ELSE 'N' END, 'B')
    WHEN occtype LIKE 'RES2%' THEN 'RES2' ELSE 'COM1' END AS ddf_class FROM depths)"""


def curves_sql() -> str:
    rows = ", ".join(
        f"('{n}', {d}, {s}, {c})"
        for n, (_, ss, cc) in K.DEPTH_DAMAGE.items() for d, s, c in zip(K.DDF_DEPTHS_FT, ss, cc)
    )
    return f"curves AS (SELECT occ, d::DOUBLE AS d, s::DOUBLE AS s, c::DOUBLE AS c FROM (VALUES {rows}) AS v(occ, d, s, c))"


NEAREST_CURVE = "FROM {0} w LEFT JOIN curves v ON v.occ = w.ddf_class AND w.depth_ft IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fd_id ORDER BY abs(v.d - w.depth_ft), v.d) = 1"


def phi_sql(x: str) -> str:
    z = f"(abs({x}) / sqrt(2e0))"
    t = f"(1e0 / (1e0 + 0.3275911e0 * {z}))"
    poly = f"(((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t})"
    return f"(5e-1 * (1e0 + sign({x}) * (1e0 - {poly} * exp(-{z} * {z}))))"


_FRAGILITY = ", ".join(
    f"('{b}', '{lv}', {', '.join(f'{m:e}' for m in ms)})" for b, levels in K.FRAGILITY_MEDIANS.items() for lv, ms in levels.items()
)
_VS30 = " ".join(f"WHEN slope_m_per_m <= {top:e} THEN {v:e}" for top, v in K.SLOPE_VS30 if top) + " ELSE 9e2"
_LN = {s: f"((ln(pga) - ln({s})) / 0.64e0)" for s in K.DAMAGE_STATES}

ORACLES = {
    "wildfire_risk": with_ctes(*BASE, body=f"""
SELECT property_id, fd_id, round(d, 1) AS match_m, round(p_destroyed, 5) AS damage_probability, round(risk, 3) AS annual_risk_usd,
  {TIER.format('risk')} AS risk_tier, p_destroyed >= {K.WILDFIRE_THRESHOLD!r} AS exceeds_threshold FROM records"""),
    "wildfire_narrative": with_ctes(*BASE, body=f"""
, f AS (SELECT property_id, risk, list_filter([CASE WHEN df = 0 THEN 'fuel right at the structure' END,
    CASE WHEN df > 0 AND df < 30 THEN 'fuel within thirty metres' END, CASE WHEN bp > 0.002 THEN 'a burn probability above 0.2 %' END,
    CASE WHEN sl > 15 THEN 'a slope above 15 degrees' END, CASE WHEN cc > 20 THEN 'tree cover above a fifth' END,
    CASE WHEN sl > 5 AND sl <= 15 THEN 'a slope of 5 to 15 degrees' END], lambda x: x IS NOT NULL) AS fs FROM records WHERE fd_id IS NOT NULL)
SELECT property_id, concat('Wildfire: ', {TIER.format('risk')}, ', $', format('{{:,}}', round(risk, 0)::BIGINT), ' expected a year.',
  CASE WHEN len(fs) >= 2 THEN concat(' Driven by ', fs[1], ' and ', fs[2], '.') WHEN len(fs) = 1 THEN concat(' Driven by ', fs[1], '.') ELSE '' END) AS summary FROM f"""),
    "wildfire_proxy": with_ctes("sites", "zones", ZONE_EDGES, f"""held AS (SELECT p.loc_id, e.zone_id FROM sites p JOIN zone_edges e ON {CROSSES} GROUP BY ALL HAVING count(*) % 2 = 1),
close AS (SELECT p.loc_id, e.zone_id FROM sites p JOIN zone_edges e ON abs(p.lng - e.x) < 3.2 AND abs(p.lat - e.y) < 3.2
  GROUP BY ALL HAVING min({segment_sql('p', 'e')}) <= 5000),
fires AS (SELECT loc_id, count(DISTINCT (upper(zone_name), year_num)) AS n FROM (SELECT * FROM held UNION SELECT * FROM close) JOIN zones USING (zone_id) GROUP BY loc_id),
r AS (SELECT loc_id, coalesce(n, 0) AS n, least(1e0, greatest(0e0, 0.3e0 + 0.4e0 * CASE loc_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.25e0 ELSE 0.5e0 END
    + 0.3e0 * CASE WHEN loc_id % 5 <> 0 THEN (loc_id % 101) / 100e0 ELSE 0e0 END)) AS dmg,
  CASE WHEN loc_id % 7 = 0 THEN NULL ELSE nullif((loc_id * 131) % 900000, 0) END AS val FROM sites LEFT JOIN fires USING (loc_id)),
u AS (SELECT *, n / 45e0 * dmg * val AS usd FROM r)""", body=f"""
SELECT loc_id, n AS fire_count, round(dmg, 6) AS damage_probability, round(usd, 3) AS annual_risk_usd, {TIER.format('usd')} AS risk_tier FROM u"""),
    "flood_risk": with_ctes("structures", "zones", ZONE_EDGES, inside("structures", "fd_id"), FLOOD_IN, curves_sql(), body=f"""
, hit AS (SELECT w.*, v.s, v.c {NEAREST_CURVE.format('wet')}),
l AS (SELECT *, (val_struct * coalesce(s, 0e0) / 100e0 + val_cont * coalesce(c, 0e0) / 100e0) * aep AS usd FROM hit)
SELECT fd_id, flood_zone, ddf_class, round(depth_ft, 4) AS depth_ft, s AS structural_damage_pct, c AS contents_damage_pct,
  round(usd, 3) AS annual_risk_usd, {TIER.format('usd')} AS risk_tier FROM l"""),
    "ddf_lookup": with_ctes("structures", curves_sql(), body=f"""
, w0 AS (SELECT fd_id, (fd_id * 77 % 3600) / 100e0 - 6e0 AS depth_ft, CASE WHEN occtype LIKE 'RES1%' THEN concat('RES1-', CASE WHEN num_story >= 2 THEN '2' ELSE '1' END, 'S', CASE WHEN found_type = 'B' THEN 'W' ELSE 'N' END, 'B')
    WHEN occtype LIKE 'RES2%' THEN 'RES2' ELSE 'COM1' END AS ddf_class FROM structures)
SELECT fd_id, ddf_class, v.s AS structural_damage_pct, v.c AS contents_damage_pct {NEAREST_CURVE.format('w0')}"""),
    "quake_damage": with_ctes("structures", body=f"""
, site AS (SELECT *, CASE {_VS30} END AS vs30 FROM structures),
b AS (SELECT *, CASE WHEN vs30 >= 1500 THEN 'A' WHEN vs30 >= 760 THEN 'B' WHEN vs30 >= 360 THEN 'C' WHEN vs30 >= 180 THEN 'D' ELSE 'E' END AS site_class,
  bedrock_pga_g * CASE WHEN vs30 >= 1500 THEN 0.8e0 WHEN vs30 >= 760 THEN 1e0 WHEN vs30 >= 360 THEN 1.2e0 WHEN vs30 >= 180 THEN 1.6e0 ELSE 2.5e0 END AS pga,
  CASE WHEN occtype LIKE 'RES2%' THEN 'MH' WHEN bldgtype = 'M' AND occtype LIKE 'RES%' THEN 'URML' WHEN bldgtype = 'M' THEN 'RM1L' WHEN bldgtype = 'S' THEN 'S1L'
    WHEN bldgtype = 'C' THEN 'C1L' WHEN occtype LIKE 'RES%' THEN 'W1' ELSE 'W2' END AS building_type,
  CASE WHEN med_yr_blt IS NULL THEN 'low' WHEN med_yr_blt >= 1997 THEN 'high' WHEN med_yr_blt >= 1974 THEN 'moderate' WHEN med_yr_blt >= 1941 THEN 'low' ELSE 'pre_code' END AS code_level FROM site),
p AS (SELECT b.*, CASE WHEN pga > 0 THEN {phi_sql(_LN['slight'])} ELSE 0e0 END AS p1, CASE WHEN pga > 0 THEN {phi_sql(_LN['moderate'])} ELSE 0e0 END AS p2,
  CASE WHEN pga > 0 THEN {phi_sql(_LN['extensive'])} ELSE 0e0 END AS p3, CASE WHEN pga > 0 THEN {phi_sql(_LN['complete'])} ELSE 0e0 END AS p4
  FROM (SELECT * REPLACE (CASE WHEN pga > 0 THEN pga END AS pga) FROM b) b JOIN (VALUES {_FRAGILITY}) AS f(building_type, code_level, slight, moderate, extensive, complete) USING (building_type, code_level)),
r AS (SELECT *, greatest(0e0, p1 - p2) * 0.02e0 + greatest(0e0, p2 - p3) * 0.1e0 + greatest(0e0, p3 - p4) * 0.5e0 + p4 AS ratio FROM p),
u AS (SELECT *, (val_struct + val_cont * 0.5e0) * ratio / 2475e0 AS usd FROM r)
SELECT fd_id, building_type, code_level, site_class, round(coalesce(pga, 0e0), 5) AS pga_g, round(p2, 6) AS p_moderate, round(ratio, 6) AS damage_ratio,
  round(usd, 3) AS annual_risk_usd, {TIER.format('usd')} AS risk_tier,
  CASE WHEN bedrock_pga_g >= 0.4 THEN 'high' WHEN bedrock_pga_g >= 0.15 THEN 'moderate' ELSE 'low' END AS hazard_label FROM u"""),
    "model_probability": with_ctes("structures", body=f"""
, z AS (SELECT fd_id, {C['const']!r} + {C['burn_probability']!r} * burn_probability + {C['distance_to_fuel_m']!r} * distance_to_fuel_m + {C['canopy_cover_100m']!r} * canopy_cover_100m
  + {C['slope_degrees']!r} * slope_degrees + {C['is_res1']!r} * CASE WHEN occtype LIKE 'RES1%' THEN 1e0 ELSE 0e0 END AS z FROM structures)
SELECT fd_id, round(z, 6) AS log_odds, round(1e0 / (1e0 + exp(-z)), 6) AS p_destroyed, 1e0 / (1e0 + exp(-z)) >= {K.WILDFIRE_THRESHOLD!r} AS exceeds FROM z"""),
    "hazard_worst": with_ctes("sites", body=f"""
, t AS (SELECT loc_id, CASE WHEN loc_id % 6 <> 0 THEN ((loc_id * 17) % 900)::DOUBLE END AS w, CASE WHEN loc_id % 5 <> 0 THEN ((loc_id * 29) % 1100)::DOUBLE END AS f,
  {available_sql('fema_nfhl')} AS fk FROM sites),
tiers AS (SELECT *, {TIER.format('w')} AS wt, CASE WHEN fk THEN {TIER.format('f')} ELSE 'CANNOT ASSESS' END AS ft FROM t)
SELECT loc_id, wt AS wildfire_tier, ft AS flood_tier, CASE WHEN 'HIGH' IN (wt, ft) THEN 'HIGH' WHEN 'MODERATE' IN (wt, ft) THEN 'MODERATE'
  WHEN 'LOW' IN (wt, ft) THEN 'LOW' ELSE 'CANNOT ASSESS' END AS worst_tier, w AS wildfire_usd, CASE WHEN fk THEN f END AS flood_usd FROM tiers"""),
    "nearest_nsi": with_ctes("properties", "structures", body="""
, n AS (SELECT p.property_id, t.fd_id, t.occtype, t.bldgtype, sqrt(pow(p.lng - t.lng, 2) + pow(p.lat - t.lat, 2)) AS d FROM properties p JOIN structures t
  ON abs(p.lat - t.lat) <= 0.005 AND abs(p.lng - t.lng) <= 0.005)
SELECT property_id, fd_id, dist_m, building FROM properties LEFT JOIN (SELECT property_id, fd_id, round(d * 111320, 2) AS dist_m, concat(CASE substr(occtype, 1, 3) WHEN 'RES' THEN 'residential' WHEN 'COM' THEN 'commercial' ELSE 'industrial' END, ' ',
  CASE bldgtype WHEN 'W' THEN 'wood frame' WHEN 'M' THEN 'masonry' WHEN 'C' THEN 'concrete' ELSE 'steel' END) AS building
FROM n QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY d, fd_id) = 1) USING (property_id)"""),
    "portfolio_summary": with_ctes("properties", "structures", "zones", ZONE_EDGES, inside("properties", "property_id"), RECORDS, body=f"""
, all_rows AS (SELECT *, {TIER.format('risk')} AS tier, property_id IN (SELECT property_id FROM zone_hits) AS held FROM records),
ordered AS (SELECT risk, row_number() OVER (ORDER BY risk) - 1 AS i, count(*) OVER () AS n FROM all_rows WHERE risk IS NOT NULL)
SELECT count(*) AS property_count, count(risk) AS scored_count, 0 AS error_count, count(*) FILTER (WHERE fd_id IS NULL) AS no_coverage_count,
  round(sum(risk), 2) AS total_annual_risk, round(avg(risk), 2) AS mean_risk, round(min(risk), 2) AS min_risk, round(max(risk), 2) AS max_risk,
  count(*) FILTER (WHERE tier = 'HIGH') AS high_risk_count, count(*) FILTER (WHERE tier = 'MODERATE') AS moderate_risk_count,
  count(*) FILTER (WHERE tier = 'LOW') AS low_risk_count, count(*) FILTER (WHERE held AND risk IS NOT NULL) AS in_perimeter_count,
  count(*) FILTER (WHERE held AND tier IN ('HIGH', 'MODERATE')) AS in_perimeter_high_or_moderate, round(median(risk), 2) AS median_risk,
  (SELECT round(risk, 2) FROM ordered WHERE i = floor(n * 0.95)) AS p95_risk,
  round(count(*) FILTER (WHERE held AND tier IN ('HIGH', 'MODERATE')) / count(*) FILTER (WHERE held AND risk IS NOT NULL), 4) AS in_perimeter_share FROM all_rows"""),
    "portfolio_histogram": with_ctes(*BASE, body="""
SELECT b.bucket, count(risk) AS n FROM (VALUES ('$0'), ('$0-10'), ('$10-100'), ('$100-500'), ('$500-1000'), ('$1000+')) AS b(bucket) LEFT JOIN records r
ON b.bucket = CASE WHEN risk = 0 THEN '$0' WHEN risk <= 10 THEN '$0-10' WHEN risk <= 100 THEN '$10-100' WHEN risk <= 500 THEN '$100-500'
  WHEN risk <= 1000 THEN '$500-1000' WHEN risk > 1000 THEN '$1000+' END GROUP BY b.bucket"""),
    "portfolio_top10": with_ctes(*BASE, body="""
SELECT property_id, round(risk, 3) AS annual_risk_usd FROM records WHERE risk IS NOT NULL ORDER BY risk DESC, property_id LIMIT 10"""),
    "risk_drivers": with_ctes(*BASE, body="""
, m AS (SELECT coalesce(nullif(median(bp), 0), 1e-9) AS m1, coalesce(nullif(median(df), 0), 1e0) AS m2, coalesce(nullif(median(cc), 0), 1e-9) AS m3,
    coalesce(nullif(median(sl), 0), 1e-9) AS m4 FROM records WHERE fd_id IS NOT NULL),
c AS (SELECT property_id, list_sort([{'s': -(bp - m1) / abs(m1), 'i': 0, 't': 'burn probability'},
  {'s': -CASE WHEN df = 0 THEN abs(m2) ELSE (m2 - df) / abs(df) END, 'i': 1, 't': 'distance to fuel'},
  {'s': -(cc - m3) / abs(m3), 'i': 2, 't': 'canopy cover'}, {'s': -(sl - m4) / abs(m4), 'i': 3, 't': 'slope'}]) AS r
  FROM records CROSS JOIN m WHERE fd_id IS NOT NULL)
SELECT property_id, concat(r[1].t, '; ', r[2].t) AS drivers FROM c"""),
}
