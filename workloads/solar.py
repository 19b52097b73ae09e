"""Data selection and solar siting queries with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import constants as K
from parcelwise.functions import scoring as S
from parcelwise.operators import counts, overlap
from parcelwise.operators import raster as G
from parcelwise.operators import spatial as X
from parcelwise.plans import selection as E
from parcelwise.plans import solar as L
from parcelwise.sources import catalog

from .layers import (
    NEAR_ZONE, RASTER_AFFINE, TERRAIN, ZONE_EDGES, ZONE_SHAPES, as_features, box_polygons, hav, inside, layer, parcels, strip_areas, table, with_ctes,
)
from .layers import PARCELS as PARCEL_BOXES
from .spatial import TILE_CELL, segment_sql, zone_cell, zones

#: Sources probed in the layers: points, lines, polygons, and values known at the site.
PROBED_BY = {
    "points": ["osm_substations", "eia_form860", "osm_pois"],
    "lines": ["hifld_transmission"],
    "polygons": ["nwi_wetlands", "usgs_padus", "usfws_critical_habitat", "google_inundation_history"],
    "known": ["epa_ejscreen", "census_lehd", "usfs_fsim", "landfire_fuels_canopy"],
}
PROBED = [s for names in PROBED_BY.values() for s in names]


def site_probes(spark, sf_dir):
    """(loc_id, source_id, n, nearest_m) of every probed source."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat", "ej_percentile")
    of = lambda name, df: df.withColumn("source_id", F.lit(name))
    at = lambda name: as_features(layer(spark, sf_dir, name).select("lng", "lat"))
    points = of("osm_substations", at("substations")).unionByName(of("eia_form860", at("plants"))).unionByName(of("osm_pois", at("pois")))
    lines = of("hifld_transmission", layer(spark, sf_dir, "lines").select("ax", "ay", "bx", "by"))
    z = zones(spark, sf_dir, "zone_id", "kind", "flood_zone")
    kinds = F.create_map(*map(F.lit, ("wetland", "nwi_wetlands", "protected", "usgs_padus", "habitat", "usfws_critical_habitat")))
    box = ("rings", "x0", "y0", "x1", "y1")
    flooded = of("google_inundation_history", z.filter(S.is_sfha("flood_zone"))).select(F.concat(F.lit("f"), "zone_id").alias("feature_id"), "source_id", *box)
    polygons = z.select(F.concat(F.lit("k"), "zone_id").alias("feature_id"), kinds[F.col("kind")].alias("source_id"), *box).unionByName(flooded)
    tracts = box_polygons(layer(spark, sf_dir, "tracts").select("tract_id", "x0", "y0", "x1", "y1"))
    cells = G.sample(sites.select("loc_id", "lng", "lat"), layer(spark, sf_dir, "raster"), ["dem", "canopy"], -9999.0, **RASTER_AFFINE)
    known = [
        of("epa_ejscreen", sites.filter("ej_percentile IS NOT NULL").select("loc_id")),
        of("census_lehd", X.points_in_polygons(sites.select("loc_id", "lng", "lat"), tracts, 0.054).select("loc_id")),
        of("usfs_fsim", cells.filter("dem IS NOT NULL").select("loc_id")),
        of("landfire_fuels_canopy", cells.filter("canopy IS NOT NULL").select("loc_id")),
    ]
    return E.probe_layers(sites, "loc_id", points, lines, polygons, reduce(DataFrame.unionByName, known), PROBED_BY, zone_cell(spark, sf_dir))


def sites_with_sources(spark, sf_dir):
    """Availability columns: table sources by probes of their layers, services by the catalog and by outages."""
    wide = E.availability_columns(layer(spark, sf_dir, "sites"), site_probes(spark, sf_dir), "loc_id", PROBED)
    # Services marked verified are there, but for outages of some now and then.
    outages = {"nrel_pvwatts_v8": 7, "nrel_nsrdb_ghi": 5, "fema_nfhl": 9, "usgs_nhdplus": 4}
    return wide.withColumns({E.has(s): F.pmod(F.col("loc_id"), F.lit(n)) != 0 for s, n in outages.items()})


def availability_record(spark, sf_dir):
    """Every probed source of every site: how many features are near and how far the nearest is."""
    return site_probes(spark, sf_dir).select("loc_id", "source_id", "n", F.round("nearest_m", 2).alias("nearest_m"))


def source_document(spark, sf_dir):
    """The sources that a workflow's criteria name, in catalog order, with the sites that have them."""
    base = sites_with_sources(spark, sf_dir)
    names = sorted({n.source_id for c in catalog.CRITERIA for n in c.tree})
    has = F.explode(F.array(*[F.struct(F.lit(s).alias("source_id"), F.coalesce(F.col(E.has(s)), F.lit(False)).alias("has")) if E.has(s) in base.columns else F.struct(F.lit(s).alias("source_id"), F.lit(False).alias("has")) for s in names])).alias("x")
    counted = base.select(has).groupBy(F.col("x.source_id").alias("source_id")).agg(F.count_if("x.has").alias("n_sites"))
    uses = [(c.workflow, n.source_id) for c in catalog.CRITERIA for n in c.tree]
    listed = spark.createDataFrame(sorted(set(uses)), "workflow string, source_id string")
    return listed.join(counted, "source_id").select("workflow", "source_id", "n_sites")


def source_probe(spark, sf_dir):
    """One probe pass over all table layers with a radius per source."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat")
    parts = [
        as_features(layer(spark, sf_dir, "substations")).select(F.lit("osm_substations").alias("source_id"), "f_lng", "f_lat"),
        as_features(layer(spark, sf_dir, "plants")).select(F.lit("eia_form860").alias("source_id"), "f_lng", "f_lat"),
        as_features(layer(spark, sf_dir, "pois")).select(F.lit("osm_pois").alias("source_id"), "f_lng", "f_lat"),
    ]
    feats = parts[0].unionByName(parts[1]).unionByName(parts[2])
    radii = {s: K.PROBE_RADIUS_M[s] for s in ("osm_substations", "eia_form860", "osm_pois")}
    out = E.probe_sources(sites, feats, "loc_id", radii)
    return out.select("loc_id", "source_id", "n", F.round("nearest_m", 2).alias("nearest_m"))


def source_coverage(spark, sf_dir):
    """Availability and quality of every source by coverage and reliability."""
    sites = layer(spark, sf_dir, "sites").withColumn("state", home_state())
    out = E.coverage_availability(sites, "loc_id", "state")
    return out.groupBy("source_id", "quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("available").alias("n_available"))


def home_state():
    n = F.col("nation_id")
    return F.when(n < 6, "CA").when(n < 12, "TX").when(n < 18, "OH")


def _selection(workflow):
    def run(spark, sf_dir):
        rows = E.selection_rows(sites_with_sources(spark, sf_dir), workflow, "loc_id")
        return rows.select("loc_id", "criterion_id", "relationship", "confidence", "selected_source", "quality", "tier")

    return run


def composite_confidence(spark, sf_dir):
    """E6, E7, E8 for the solar workflow."""
    selected = E.select_data(sites_with_sources(spark, sf_dir), catalog.SOLAR)
    out = E.confidence_report(selected, catalog.SOLAR, "loc_id")
    return out.select("loc_id", "composite", "tier", "completeness", "gaps", "weakest", "n_strong", "critical_gaps")


def hazard_confidence(spark, sf_dir):
    """E4, E6 and H7's per-peril confidence subsets."""
    selected = E.select_data(sites_with_sources(spark, sf_dir), catalog.HAZARD)
    fire = {c.criterion_id for c in catalog.criteria_for(catalog.HAZARD) if c.criterion_id.startswith("wf_")}
    flood = {c.criterion_id for c in catalog.criteria_for(catalog.HAZARD) if c.criterion_id.startswith("fl_")}
    return selected.select(
        "loc_id",
        F.round(E.composite_confidence(catalog.HAZARD), 4).alias("composite"),
        F.round(E.composite_confidence(catalog.HAZARD, fire), 4).alias("wildfire"),
        F.round(E.composite_confidence(catalog.HAZARD, flood), 4).alias("flood"),
        F.array_join(E.critical_gaps(catalog.HAZARD), ",").alias("critical_gaps"),
    )


def critical_gaps(spark, sf_dir):
    """Sites that cannot be assessed, by workflow."""
    base = sites_with_sources(spark, sf_dir)
    parts = []
    for wf in (catalog.SOLAR, catalog.HAZARD, catalog.TRADE):
        sel = E.select_data(base, wf)
        parts.append(sel.select(F.lit(wf).alias("workflow"), F.explode(E.critical_gaps(wf)).alias("criterion_id")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("workflow", "criterion_id").agg(F.count(F.lit(1)).alias("n_sites"))


def weight_resolution(spark, sf_dir):
    """Calibrated profile of the site's region, else the default weights."""
    tiles = box_polygons(layer(spark, sf_dir, "tiles")).join(table(spark, sf_dir, "region"), F.col("region_id") == F.col("r_regionkey"))
    sites = X.first_polygon(layer(spark, sf_dir, "sites"), tiles, TILE_CELL, "loc_id", "tile_id", ["tile_id", "r_name"])
    profiles = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("region"),
        F.when(F.col("r_regionkey") % 2 == 0, "constrained_optimization").otherwise("literature_default").alias("method"),
        F.create_map(F.lit("solar_ghi"), 0.10 + F.col("r_regionkey") / 100.0, F.lit("solar_transmission"), F.lit(0.30)).alias("weights"),
    )
    out = L.resolve_weights(sites.withColumnRenamed("r_name", "region"), profiles)
    return out.select("loc_id", "region", "weight_method", *[F.round(f"w_{c}", 4).alias(f"w_{c}") for c in ("solar_ghi", "solar_transmission", "solar_slope")])


def measured_sites(spark, sf_dir):
    """Sites with every measurement the composite needs, from the layer joins."""
    sites = layer(spark, sf_dir, "sites")
    slim = sites.select("loc_id", "lng", "lat")
    lines = layer(spark, sf_dir, "lines").select("ax", "ay", "bx", "by", F.lit(0).alias("_s"))
    lines_m = X.line_distance_within(slim, lines, "loc_id", "_s", 50_000.0).select("loc_id", F.col("dist").alias("nearest_hifld_transmission"))
    stations = as_features(layer(spark, sf_dir, "substations")).select("f_lng", "f_lat", F.lit(0).alias("_s"))
    subs = X.nearest_within(slim, stations, "loc_id", 50_000.0, "_s", []).filter(F.col("dist").isNotNull())
    subs_m = subs.groupBy("loc_id").agg(F.min("dist").alias("nearest_osm_substations"))
    held = {
        "in_gap12": (F.bool_or((F.col("kind") == "protected") & F.col("gap_status").isin(1, 2)), F.bool_or),
        "in_protected_zone": (F.bool_or(F.col("kind") == "protected"), F.bool_or),
        "in_wetland": (F.bool_or(F.col("kind") == "wetland"), F.bool_or),
        "in_habitat": (F.bool_or(F.col("kind") == "habitat"), F.bool_or),
        "_first": (F.min(F.when(F.col("zone_id").isNotNull(), F.struct("zone_id", "flood_zone"))), F.min),
    }
    flags = counts.held_by(slim, zones(spark, sf_dir, "zone_id", "kind", "gap_status", "flood_zone"), "loc_id", held, zone_cell(spark, sf_dir))
    flags = flags.withColumn("_zone", F.col("_first.flood_zone")).drop("_first")
    out = sites.join(lines_m, "loc_id", "left").join(subs_m, "loc_id", "left").join(flags, "loc_id", "left")
    fixed = {E.has(s): c for s, c in E.catalog_availability().items() if c is not None}
    probed = {
        E.has("hifld_transmission"): F.col("nearest_hifld_transmission").isNotNull(),
        E.has("osm_substations"): F.col("nearest_osm_substations").isNotNull(),
        E.has("nwi_wetlands"): F.coalesce(F.col("in_wetland"), F.lit(False)),
        E.has("epa_ejscreen"): F.col("ej_percentile").isNotNull(),
    }
    return out.withColumn("flood_zone", F.coalesce("_zone", F.lit("X"))).withColumns({**fixed, **probed})


def solar_scored(spark, sf_dir):
    selected = E.select_data(measured_sites(spark, sf_dir), catalog.SOLAR)
    return L.score_solar(L.resolve_weights(selected))


def solar_composite(spark, sf_dir):
    """Composite score, rating and exclusions of every site."""
    out = solar_scored(spark, sf_dir)
    return out.select(
        "loc_id", F.round("composite", 8).alias("composite"), "rating", F.array_join("exclusions", ",").alias("exclusions"),
        "flood_deduction", F.round("s_solar_transmission", 4).alias("s_transmission"), "s_solar_land_cover", "s_solar_soil",
    )


def exclusion_diagnosis(spark, sf_dir):
    """How often each screen fires, and how many sites only it removes."""
    out = solar_scored(spark, sf_dir).select("loc_id", "exclusions", "s_solar_transmission")
    each = out.select("loc_id", F.size("exclusions").alias("n_excl"), F.explode("exclusions").alias("criterion_id"))
    return each.groupBy("criterion_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_excl") == 1).alias("n_sole"))


def exclusion_classes(spark, sf_dir):
    """True and false positives of the loose screens, per screen."""
    sites = measured_sites(spark, sf_dir)
    return L.exclusion_verdicts(sites, "loc_id").groupBy("criterion_id", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("loc_id").alias("first_site"))


def solar_parcels(spark, sf_dir):
    """Parcel table with distances and flags for the seven-criterion method."""
    sites = layer(spark, sf_dir, "sites")
    grid = F.pmod(F.col("loc_id") * 977, F.lit(60000)) * 1.0
    road = F.pmod(F.col("loc_id") * 331, F.lit(25000)) * 1.0
    return sites.withColumns(
        {
            "grid_distance_m": F.when(F.col("loc_id") % 21 != 0, grid),
            "road_distance_m": F.when(F.col("loc_id") % 23 != 0, road),
            "in_flood": F.col("loc_id") % 10 == 0,
            "in_wetland": F.when(F.col("loc_id") % 4 != 0, F.col("loc_id") % 14 == 1),
            "in_protected": F.col("loc_id") % 18 == 5,
            "acreage": F.col("acreage") / 5.0,
        }
    )


def solar_v1_score(spark, sf_dir):
    """Seven weighted criteria and five hard constraints."""
    out = L.score_parcels(solar_parcels(spark, sf_dir))
    return out.select("loc_id", F.round("suitability_score", 4).alias("suitability_score"), "suitability_rating", "capacity_mw", "passed_all")


def solar_v1_provisional(spark, sf_dir):
    """Pass without terrain, with overridden weights renormalised."""
    out = L.score_parcels(solar_parcels(spark, sf_dir), {"high_threshold": 0.6}, {"ghi": 0.3, "grid": 0.3}, terrain_known=False)
    return out.select("loc_id", F.round("suitability_score", 4).alias("suitability_score"), "suitability_rating", "passed_all")


def enriched_parcels(spark, sf_dir):
    p = L.score_parcels(solar_parcels(spark, sf_dir))
    return p.withColumn("slope_degrees", S.slope_degrees(F.col("slope_pct") / 100.0))


ENVELOPE = (-118.0, 28.0, -80.0, 46.0)
DISCOVER = {"min_acreage": 10.0, "max_slope_deg": 8.530765609948133}


def discover(spark, sf_dir):
    """The 25 best parcels in an envelope."""
    out = L.discover(enriched_parcels(spark, sf_dir), ENVELOPE, DISCOVER, 25, "loc_id")
    return out.select("loc_id", F.round("suitability_score", 4).alias("suitability_score"), "suitability_rating")


def discover_summary(spark, sf_dir):
    """A8, L17."""
    out = L.discover_summary(enriched_parcels(spark, sf_dir), ENVELOPE, DISCOVER)
    return out.select("total_in_geo", "passing", F.round("capacity_mw", 3).alias("capacity_mw"), "n_high", "n_moderate", "n_low")


def batch_rank(spark, sf_dir):
    """Ranked batch list per segment: not excluded by score, excluded last."""
    p = enriched_parcels(spark, sf_dir).select("loc_id", "segment", "suitability_score", (~F.col("passed_all")).alias("excluded"))
    from pyspark.sql import Window as W

    # Ranks start from per-(segment, excluded, score band) offsets, so no segment is one task.
    banded = p.withColumn("band", F.floor(F.coalesce(F.col("suitability_score"), F.lit(-1.0)) * 100))
    sizes = banded.groupBy("segment", "excluded", "band").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("segment").orderBy("excluded", F.desc("band")).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside_band = W.partitionBy("segment", "excluded", "band").orderBy(F.desc_nulls_last("suitability_score"), "loc_id")
    return banded.join(offsets, ["segment", "excluded", "band"]).select(
        "segment", "loc_id", "excluded", (F.col("off") + F.row_number().over(inside_band)).alias("rank")
    )


def deep_resource(spark, sf_dir):
    """L19, X19."""
    out = L.resource_stage(layer(spark, sf_dir, "sites"), 0)
    return out.select("loc_id", "system_capacity_kw", "tilt_deg", "annual_kwh", "cf_class", "low_cf_advisory")


STEEP_PCT = 0.4  # parcels here are county-sized, so are the raster's cells
SETBACKS = {"perimeter_setback": 2.0, "road_setback": 3.0}


def _exclusions(spark, sf_dir):
    own = parcels(spark, sf_dir)
    z = zones(spark, sf_dir, "kind", "flood_zone")
    unions = z.filter("kind <> 'wetland'").withColumnRenamed("kind", "layer").drop("flood_zone")
    flood = z.filter(S.is_sfha("flood_zone")).select(F.lit("flood").alias("layer"), *unions.columns[1:])
    elevations = L.parcel_elevations(own, "loc_id", layer(spark, sf_dir, "raster"), "dem", -9999.0, 5, **RASTER_AFFINE)
    cells = L.terrain_cells(elevations, "loc_id")
    return own, L.exclusion_layers(own, "loc_id", {"wetland": z.filter("kind = 'wetland'")}, unions.unionByName(flood), cells, STEEP_PCT, SETBACKS, zone_cell(spark, sf_dir))


def excluded_acres(spark, sf_dir):
    """Acres of every parcel lost to each layer: wetlands summed, other layers as unions, steep cells, setbacks."""
    _, lost = _exclusions(spark, sf_dir)
    return lost.select("loc_id", "layer", F.round("overlap_acres", 1).alias("overlap_acres"))


def buildable_area(spark, sf_dir):
    """Acres of every parcel left after all exclusion layers."""
    own, lost = _exclusions(spark, sf_dir)
    out = L.buildable_stage(own.select("loc_id", "acres"), lost, "loc_id")
    return out.select("loc_id", F.round("total_exclusion_acres", 1).alias("total_exclusion_acres"), F.round("buildable_pct", 1).alias("buildable_pct"), F.round("adjusted_capacity_mw", 0).alias("adjusted_capacity_mw"))


def interconnection_cost(spark, sf_dir):
    """Nearest line and substation of every site, capacity near both, cost, congestion."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat", (F.col("acreage") / 7.5).alias("capacity_mw"))
    at = sites.select("loc_id", "lng", "lat")
    best = X.nearest_line(at, layer(spark, sf_dir, "lines"), "loc_id", "line_id", ["voltage"]).select(
        "loc_id", F.col("dist").alias("line_m"), F.col("voltage").alias("line_voltage")
    )
    stations = as_features(layer(spark, sf_dir, "substations")).select("sub_id", "f_lng", "f_lat")
    station = X.nearest(at, stations, "loc_id", "sub_id", []).select("loc_id", "sub_id", F.col("dist").alias("sub_m"))
    plants = as_features(layer(spark, sf_dir, "plants").filter(F.col("operating_status") == "OP"))
    near = counts.sums_within_radius(at, plants, "loc_id", K.CONGESTION_RADIUS_M, {"nearby_mw": F.sum("capacity_mw"), "n_plants": F.count(F.lit(1))})
    out = L.interconnection_stage(sites.join(best, "loc_id").join(station, "loc_id").join(near, "loc_id", "left"))
    return out.select(
        "loc_id", "distance_km", "usd_per_km", F.round(F.col("total_usd") / 1000.0, 0).alias("total_kusd"), "congestion", "distant_line", "high_cost",
        "sub_id", F.round("sub_m", 1).alias("sub_m"), F.coalesce("n_plants", F.lit(0)).cast("long").alias("n_plants"),
        F.round(F.coalesce("nearby_mw", F.lit(0.0)), 3).alias("existing_mw"),
    )


def gap_messages(spark, sf_dir):
    """Exhausted criteria per workflow with their names and messages."""
    base, out = sites_with_sources(spark, sf_dir), None
    for wf in (catalog.SOLAR, catalog.HAZARD, catalog.TRADE):
        rows = E.gap_rows(E.select_data(base, wf), wf, "loc_id").withColumn("workflow", F.lit(wf))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("workflow", "criterion_id", "message").agg(F.count(F.lit(1)).alias("n"))


def enrich_parcels(spark, sf_dir):
    """Measurements of every parcel from the layers."""
    parcels = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat", "acreage")
    z = zones(spark, sf_dir, "zone_id", "kind", "gap_status", "flood_zone")
    screens = z.withColumn("kind", F.when(S.is_sfha("flood_zone"), "flood").otherwise(F.col("kind")))
    soils = z.select(F.col("zone_id").alias("unit_id"), F.col("gap_status").alias("soil_class"), F.col("flood_zone").alias("zone_code"), "rings", "x0", "y0", "x1", "y1")
    lines = layer(spark, sf_dir, "lines").select("ax", "ay", "bx", "by", "voltage")
    grid = lines.filter(F.col("voltage").isNotNull()).drop("voltage")
    stations = as_features(layer(spark, sf_dir, "substations")).select(F.col("sub_id").alias("station_id"), "f_lng", "f_lat", F.col("f_lat").alias("ghi"))
    out = L.enrich_parcels(parcels, "loc_id", screens, grid, lines.drop("voltage"), soils, stations, zone_cell(spark, sf_dir))
    return out.select(
        "loc_id", "in_flood", "in_wetland", "in_protected", "unit_id", "soil_class", F.round("grid_distance_m", 2).alias("grid_distance_m"),
        F.round("road_distance_m", 2).alias("road_distance_m"), "station_id",
    )


QUERIES = {f.__name__: f for f in (
    gap_messages, enrich_parcels, source_probe, source_coverage, composite_confidence, hazard_confidence, critical_gaps, weight_resolution,
    solar_composite, exclusion_diagnosis, exclusion_classes, solar_v1_score, solar_v1_provisional, discover, discover_summary, batch_rank,
    availability_record, source_document, deep_resource, excluded_acres, buildable_area, interconnection_cost,
)}
QUERIES |= {
    "select_alternatives": _selection(catalog.SOLAR),
    "select_components": _selection(catalog.HAZARD),
    "select_trade_area": _selection(catalog.TRADE),
}

# ── SQL twins ───────────────────────────────────────────────────────────────
_FOUND = {s: f"has_{s}" for s in PROBED}
_RADII = {s: int(K.PROBE_RADIUS_M[s]) for s in PROBED}
PROBES = ("sites", "substations", "plants", "pois", "lines", "zones", "tracts", "raster", ZONE_EDGES, inside("sites", "loc_id"), f"""probe_points AS (
  SELECT 'osm_substations' AS source_id, {_RADII['osm_substations']} AS r, lng, lat FROM substations UNION ALL SELECT 'eia_form860', {_RADII['eia_form860']}, lng, lat FROM plants
  UNION ALL SELECT 'osm_pois', {_RADII['osm_pois']}, lng, lat FROM pois),
zone_gaps AS (SELECT loc_id, zone_id, min(d) AS d FROM (SELECT p.loc_id, e.zone_id, {segment_sql('p', 'e')} AS d FROM sites p JOIN zone_edges e
    ON p.lat BETWEEN least(e.ay, e.by) - 0.06 AND greatest(e.ay, e.by) + 0.06 UNION ALL SELECT loc_id, zone_id, 0e0 FROM zone_hits) WHERE d <= 5000 GROUP BY loc_id, zone_id),
site_cells AS (SELECT loc_id, dem, canopy FROM sites JOIN raster ON "row" = CAST(floor((49e0 - lat) / 0.192e0) AS BIGINT) AND "col" = CAST(floor((lng + 125e0) / (58e0 / 120)) AS BIGINT)),
probe_hits AS (
  SELECT s.loc_id, f.source_id, {hav('s.lng', 's.lat', 'f.lng', 'f.lat')} AS d, f.r FROM sites s JOIN probe_points f ON abs(s.lat - f.lat) < 0.5
  UNION ALL SELECT p.loc_id, 'hifld_transmission', {segment_sql('p', 'e')}, {_RADII['hifld_transmission']} FROM sites p JOIN lines e ON p.lat BETWEEN least(e.ay, e.by) - 0.5 AND greatest(e.ay, e.by) + 0.5
  UNION ALL SELECT loc_id, CASE kind WHEN 'wetland' THEN 'nwi_wetlands' WHEN 'protected' THEN 'usgs_padus' ELSE 'usfws_critical_habitat' END, d, 1000 FROM zone_gaps JOIN zones USING (zone_id)
  UNION ALL SELECT loc_id, 'google_inundation_history', d, 5000 FROM zone_gaps JOIN zones USING (zone_id) WHERE flood_zone LIKE 'A%' OR flood_zone LIKE 'V%'
  UNION ALL SELECT loc_id, 'epa_ejscreen', 0e0, 0 FROM sites WHERE ej_percentile IS NOT NULL
  UNION ALL SELECT loc_id, 'census_lehd', 0e0, 0 FROM sites s JOIN tracts t ON s.lng >= t.x0 AND s.lng < t.x1 AND s.lat >= t.y0 AND s.lat < t.y1
  UNION ALL SELECT loc_id, 'usfs_fsim', 0e0, 0 FROM site_cells WHERE dem <> -9999 UNION ALL SELECT loc_id, 'landfire_fuels_canopy', 0e0, 0 FROM site_cells WHERE canopy <> -9999),
probe_counts AS (SELECT loc_id, source_id, count(*) AS n, min(d) AS nearest_m FROM probe_hits WHERE d <= r GROUP BY loc_id, source_id),
probed AS (SELECT s.*, {', '.join(f"s.loc_id IN (SELECT loc_id FROM probe_counts WHERE source_id = '{s}') AS has_{s}" for s in PROBED)} FROM sites s)""")
_OUTAGE = {"nrel_pvwatts_v8": "(loc_id % 7 <> 0)", "nrel_nsrdb_ghi": "(loc_id % 5 <> 0)", "fema_nfhl": "(loc_id % 9 <> 0)",
           "usgs_nhdplus": "(loc_id % 4 <> 0)", "hazus_ddfs": "TRUE", "nwi_wetlands_rest": "FALSE"}


def available_sql(source: str) -> str:
    return _FOUND.get(source) or _OUTAGE.get(source) or "TRUE"


def confidence_sql(c, avail=available_sql) -> str:
    if c.tree_type == "alternative":
        cases = " ".join(f"WHEN {avail(n.source_id)} THEN {n.confidence:e}" for n in c.tree)
        return f"CASE {cases} ELSE 0e0 END"
    parts = [n for n in c.tree if n.relationship == "component"]
    have = ", ".join(f"CASE WHEN {avail(n.source_id)} THEN {n.confidence:e} END" for n in parts)
    lack = ", ".join(f"CASE WHEN NOT {avail(n.source_id)} THEN {n.missing or 0:e} END" for n in parts)
    return f"coalesce(least(least({have}), coalesce(least({lack}), 9e9)) + 0e0 * least({have}), 0e0)"


def source_sql(c, what="source_id", avail=available_sql) -> str:
    nodes = [n for n in c.tree if n.relationship == c.tree_type]
    return "CASE " + " ".join(f"WHEN {avail(n.source_id)} THEN '{getattr(n, what)}'" for n in nodes) + " ELSE NULL END"


TIER = "CASE WHEN {0} >= 0.85 THEN 'HIGH' WHEN {0} >= 0.65 THEN 'MODERATE' WHEN {0} >= 0.4 THEN 'LOW' ELSE '{1}' END"


def selection_sql(workflow: str) -> str:
    parts = [
        f"SELECT loc_id, '{c.criterion_id}' AS criterion_id, '{c.tree_type}' AS relationship, {confidence_sql(c)} AS confidence, "
        f"{source_sql(c)} AS selected_source, {source_sql(c, 'quality')} AS quality FROM probed"
        for c in catalog.criteria_for(workflow)
    ]
    return with_ctes(*PROBES, body=f"SELECT *, {TIER.format('confidence', 'NONE')} AS tier FROM (" + "\nUNION ALL ".join(parts) + ")")


def conf_cte(workflow: str, avail=available_sql, source: str = "probed") -> str:
    cols = ", ".join(f"{confidence_sql(c, avail)} AS conf_{c.criterion_id}" for c in catalog.criteria_for(workflow))
    return f"conf AS (SELECT *, {cols} FROM {source})"


def composite_sql(workflow: str, prefix: str = "") -> str:
    specs = [c for c in catalog.criteria_for(workflow) if c.criterion_id.startswith(prefix)]
    scored = [c for c in specs if c.kind == "scored"]
    screens = [c for c in specs if c.kind == "exclusion"]
    num = " + ".join(f"conf_{c.criterion_id} * {c.weight:e}" for c in scored)
    worst = "least(" + ", ".join(f"conf_{c.criterion_id}" for c in screens) + ")" if screens else "1e0"
    return f"(({num}) / {sum(c.weight for c in scored)!r}e0 * (5e-1 + 5e-1 * {worst}))"


def list_sql(workflow: str, test: str) -> str:
    picks = ", ".join(f"CASE WHEN conf_{c.criterion_id} {test} THEN '{c.criterion_id}' END" for c in catalog.criteria_for(workflow))
    return f"concat_ws(',', {picks})"


def count_sql(workflow: str, test: str, kind: str | None = None) -> str:
    return " + ".join(
        f"CASE WHEN conf_{c.criterion_id} {test} THEN 1 ELSE 0 END"
        for c in catalog.criteria_for(workflow) if kind in (None, c.kind)
    )


def _coverage_rows() -> str:
    rows = []
    for sid, _m, cov, states, rel, _c, _w, fb, status in catalog.SOURCES:
        usable = "TRUE" if fb and not (status or "").startswith("UNVERIFIED") else "FALSE"
        rows.append(f"('{sid}', '{cov}', '{rel}', {usable})")
    return ", ".join(rows)


CHECKS = {c.criterion_id: c for c in catalog.criteria_for(catalog.SOLAR)}
MEASURED = f"""line_near AS (SELECT loc_id, min(d) AS line_m FROM (SELECT p.loc_id, {segment_sql('p', 'e')} AS d FROM sites p JOIN lines e
    ON p.lat BETWEEN least(e.ay, e.by) - 0.5 AND greatest(e.ay, e.by) + 0.5) WHERE d <= 50000 GROUP BY loc_id),
sub_near AS (SELECT loc_id, min(d) AS sub_m FROM (SELECT s.loc_id, {hav('s.lng', 's.lat', 'b.lng', 'b.lat')} AS d
    FROM sites s JOIN substations b ON abs(s.lat - b.lat) < 0.5) WHERE d <= 50000 GROUP BY loc_id),
flags AS (SELECT loc_id, bool_or(kind = 'protected' AND gap_status IN (1, 2)) AS in_gap12, bool_or(kind = 'wetland') AS in_wetland,
    bool_or(kind = 'habitat') AS in_habitat, arg_min(flood_zone, zone_id) AS zone
  FROM zone_hits JOIN zones USING (zone_id) GROUP BY loc_id),
measured AS (SELECT s.*, line_m, sub_m, coalesce(in_gap12, FALSE) AS in_gap12, coalesce(in_wetland, FALSE) AS in_wetland,
    coalesce(in_habitat, FALSE) AS in_habitat, coalesce(zone, 'X') AS flood_zone
  FROM sites s LEFT JOIN line_near USING (loc_id) LEFT JOIN sub_near USING (loc_id) LEFT JOIN flags USING (loc_id)),
sub_scores AS (SELECT *,
  least(1e0, greatest(0e0, (capacity_factor_pct - 14) / 8e0)) AS s_ghi,
  coalesce(least(1e0, greatest(0e0, 1 - slope_pct / 15e0)), 0e0) AS s_slope,
  CASE WHEN aspect_deg IS NULL OR coalesce(slope_pct, 0) < 1 THEN 1e0
    ELSE greatest(0e0, cos(radians(least(abs(aspect_deg - 180), 360 - abs(aspect_deg - 180))))) END AS s_aspect,
  coalesce(least(1e0, greatest(0e0, 1 - coalesce(line_m, sub_m) / 16000e0)), 0e0) AS s_tx,
  CASE nlcd_code WHEN 11 THEN 0e0 WHEN 21 THEN 0.3e0 WHEN 23 THEN 0e0 WHEN 31 THEN 0.9e0 WHEN 42 THEN 0.3e0 WHEN 52 THEN 0.6e0
    WHEN 71 THEN 0.7e0 WHEN 82 THEN 0.9e0 WHEN 81 THEN 0.8e0 ELSE 0.5e0 END AS s_cover,
  CASE WHEN hydric_rating = 'Yes' THEN 0.2e0 WHEN drainage_class = 'Well drained' THEN 1e0 WHEN drainage_class = 'Moderately well drained' THEN 0.8e0
    WHEN drainage_class = 'Somewhat poorly drained' THEN 0.5e0 WHEN drainage_class = 'Poorly drained' THEN 0.3e0 ELSE 0.6e0 END AS s_soil,
  1 - (CASE WHEN ej_percentile = 0 THEN 50e0 ELSE ej_percentile END) / 100e0 AS s_ej,
  CASE WHEN flood_zone LIKE 'V%' THEN 0e0 WHEN flood_zone LIKE 'A%' THEN 0.35e0 ELSE 1e0 END AS s_flood
  FROM measured),
rounded AS (SELECT * REPLACE (round(s_ghi, 4) AS s_ghi, round(s_slope, 4) AS s_slope, round(s_aspect, 4) AS s_aspect, round(s_tx, 4) AS s_tx,
    round(s_ej, 4) AS s_ej) FROM sub_scores),
composed AS (SELECT *, concat_ws(',', CASE WHEN in_habitat THEN 'excl_critical_habitat' END, CASE WHEN flood_zone LIKE 'V%' THEN 'excl_flood' END,
    CASE WHEN in_gap12 THEN 'excl_protected' END, CASE WHEN slope_pct >= 20 THEN 'excl_steep' END, CASE WHEN nlcd_code IN (23, 24) THEN 'excl_urban' END,
    CASE WHEN in_wetland OR hydric_rating = 'Yes' THEN 'excl_wetlands' END) AS exclusions,
  CASE WHEN flood_zone LIKE 'A%' THEN 0.05e0 * 0.65e0 ELSE 0e0 END AS deduction,
  (s_ghi * 0.15e0 + s_slope * 0.15e0 + s_aspect * 0.1e0 + s_tx * 0.25e0 + 0.5e0 * 0.12e0 + s_cover * 0.1e0 + s_soil * 0.08e0 + coalesce(s_ej * 0.05e0, 0e0))
    / (0.95e0 + CASE WHEN s_ej IS NULL THEN 0e0 ELSE 0.05e0 END) AS mean FROM rounded),
final AS (SELECT *, greatest(0e0, mean - deduction) AS composite FROM composed)"""
SOLAR_CTES = ("sites", "lines", "substations", "zones", ZONE_EDGES, inside("sites", "loc_id"), MEASURED)

PARCELS = """parcels AS (SELECT * REPLACE (acreage / 5e0 AS acreage),
  CASE WHEN loc_id % 21 <> 0 THEN (loc_id * 977) % 60000 * 1e0 END AS grid_m, CASE WHEN loc_id % 23 <> 0 THEN (loc_id * 331) % 25000 * 1e0 END AS road_m,
  loc_id % 10 = 0 AS in_flood, CASE WHEN loc_id % 4 <> 0 THEN loc_id % 14 = 1 END AS in_wetland, loc_id % 18 = 5 AS in_protected FROM sites),
span AS (SELECT CASE WHEN max(ghi) - min(ghi) > 0.1 THEN min(ghi) ELSE 4e0 END AS lo, CASE WHEN max(ghi) - min(ghi) > 0.1 THEN max(ghi) ELSE 7e0 END AS hi FROM parcels),
parts AS (SELECT *, (ghi - lo) / (hi - lo) AS p_ghi, greatest(0e0, least(1e0, 1 - coalesce(grid_m, 50000e0) / 50000e0)) AS p_grid,
  greatest(0e0, least(1e0, 1 - coalesce(slope_pct, 15e0) / 15e0)) AS p_slope,
  CASE WHEN aspect_deg IS NULL THEN 1e0 ELSE greatest(0e0, cos(radians(least(abs(aspect_deg - 180), 360 - abs(aspect_deg - 180))))) END AS p_aspect,
  (9 - coalesce(soil_class, 4)) / 8e0 AS p_soil, greatest(0e0, least(1e0, 1 - coalesce(road_m, 20000e0) / 20000e0)) AS p_road,
  CASE zone_code WHEN 'A-1' THEN 1e0 WHEN 'R-1' THEN 0.15e0 WHEN 'C-2' THEN 0.35e0 WHEN 'M-1' THEN 0.5e0 ELSE 0.85e0 END AS p_use,
  coalesce(acreage, 0) >= 10 AND NOT in_flood AND NOT coalesce(in_wetland, FALSE) AND NOT in_protected AS base_ok
  FROM parcels CROSS JOIN span),
v1 AS (SELECT *, round(p_ghi * 0.1e0 + p_grid * 0.45e0 + p_slope * 0.12e0 + p_aspect * 0.04e0 + p_soil * 0.06e0 + p_road * 0.18e0 + p_use * 0.05e0, 4) AS score,
  base_ok AND coalesce(slope_pct <= 15, FALSE) AS passed_all FROM parts),
rated AS (SELECT *, CASE WHEN score >= 0.7 THEN 'High' WHEN score >= 0.4 THEN 'Moderate' ELSE 'Low' END AS rating,
  degrees(atan(slope_pct / 100e0)) AS slope_degrees FROM v1),
boxed AS (SELECT *, acreage >= 10 AND NOT coalesce(in_wetland, FALSE) AND NOT in_protected AND NOT in_flood
    AND (slope_degrees IS NULL OR slope_degrees <= 8.530765609948133e0) AS ok
  FROM rated WHERE lng BETWEEN -118 AND -80 AND lat BETWEEN 28 AND 46)"""

ORACLES = {
    "select_alternatives": selection_sql(catalog.SOLAR),
    "select_components": selection_sql(catalog.HAZARD),
    "select_trade_area": selection_sql(catalog.TRADE),
    "source_probe": with_ctes("sites", "substations", "plants", "pois", body=f"""
, feats AS (SELECT 'osm_substations' AS source_id, 50000 AS r, lng, lat FROM substations UNION ALL SELECT 'eia_form860', 25000, lng, lat FROM plants
  UNION ALL SELECT 'osm_pois', 5000, lng, lat FROM pois)
SELECT loc_id, source_id, coalesce(n, 0) AS n, nearest_m FROM sites CROSS JOIN (SELECT DISTINCT source_id FROM feats) LEFT JOIN (SELECT loc_id, source_id, count(*) AS n, round(min(d), 2) AS nearest_m FROM (
  SELECT s.loc_id, f.source_id, f.r, {hav('s.lng', 's.lat', 'f.lng', 'f.lat')} AS d FROM sites s JOIN feats f ON abs(s.lat - f.lat) < 0.5)
WHERE d <= r GROUP BY loc_id, source_id) USING (loc_id, source_id)"""),
    "source_coverage": with_ctes("sites", body=f"""
, src AS (SELECT * FROM (VALUES {_coverage_rows()}) AS v(source_id, cov, rel, fb)),
q AS (SELECT source_id, CASE WHEN cov = 'national' AND rel = 'verified' THEN 'full' WHEN cov = 'national' AND rel = 'degraded' THEN 'degraded'
    WHEN cov = 'national' THEN 'unavailable' WHEN fb THEN 'fallback' ELSE 'out_of_coverage' END AS quality FROM src CROSS JOIN sites)
SELECT source_id, quality, count(*) AS n, count(*) FILTER (WHERE quality IN ('full', 'degraded', 'fallback')) AS n_available FROM q GROUP BY ALL"""),
    "composite_confidence": with_ctes(*PROBES, conf_cte(catalog.SOLAR), body=f"""
SELECT loc_id, round(c, 4) AS composite, {TIER.format('c', 'INSUFFICIENT')} AS tier, completeness, gaps, weakest, n_strong, critical_gaps FROM (
  SELECT loc_id, {composite_sql(catalog.SOLAR)} AS c,
    format('{{}} of 9 scored criteria, {{}} of 5 exclusion criteria', {count_sql(catalog.SOLAR, '> 0', 'scored')}, {count_sql(catalog.SOLAR, '> 0', 'exclusion')}) AS completeness,
    {list_sql(catalog.SOLAR, '= 0')} AS gaps, {list_sql(catalog.SOLAR, 'IN (0.4, 0.5)')} AS weakest, {count_sql(catalog.SOLAR, '>= 0.85')} AS n_strong,
    CASE WHEN conf_solar_ghi = 0 THEN 'solar_ghi' ELSE '' END AS critical_gaps FROM conf)"""),
    "hazard_confidence": with_ctes(*PROBES, conf_cte(catalog.HAZARD), body=f"""
SELECT loc_id, round({composite_sql(catalog.HAZARD)}, 4) AS composite, round({composite_sql(catalog.HAZARD, 'wf_')}, 4) AS wildfire,
  round({composite_sql(catalog.HAZARD, 'fl_')}, 4) AS flood,
  concat_ws(',', CASE WHEN conf_wf_likelihood = 0 THEN 'wf_likelihood' END, CASE WHEN conf_fl_zone = 0 THEN 'fl_zone' END) AS critical_gaps FROM conf"""),
    "critical_gaps": with_ctes("sites", body=f"""
SELECT 'solar_siting' AS workflow, 'solar_ghi' AS criterion_id, count(*) AS n_sites FROM sites WHERE NOT {_OUTAGE['nrel_pvwatts_v8']} AND NOT {_OUTAGE['nrel_nsrdb_ghi']}
UNION ALL SELECT 'hazard_assessment', 'fl_zone', count(*) FROM sites WHERE NOT {_OUTAGE['fema_nfhl']}"""),
    "weight_resolution": with_ctes("sites", "tiles", body="""
SELECT loc_id, r_name AS region, CASE WHEN r_regionkey % 2 = 0 THEN 'calibrated' ELSE 'literature_default' END AS weight_method,
  CASE WHEN r_regionkey % 2 = 0 THEN round(0.1 + r_regionkey / 100e0, 4) ELSE 0.15e0 END AS w_solar_ghi,
  CASE WHEN r_regionkey % 2 = 0 THEN 0.3e0 ELSE 0.25e0 END AS w_solar_transmission, 0.15e0 AS w_solar_slope
FROM sites s JOIN tiles t ON s.lng >= t.x0 AND s.lng < t.x1 AND s.lat >= t.y0 AND s.lat < t.y1 JOIN region ON region_id = r_regionkey"""),
    "solar_composite": with_ctes(*SOLAR_CTES, body="""
SELECT loc_id, round(composite, 8) AS composite, CASE WHEN exclusions <> '' THEN 'Excluded' WHEN composite >= 0.7 THEN 'High'
    WHEN composite >= 0.4 THEN 'Moderate' ELSE 'Low' END AS rating, exclusions, round(deduction, 4) AS flood_deduction, s_tx AS s_transmission,
  s_cover AS s_solar_land_cover, s_soil AS s_solar_soil FROM final"""),
    "exclusion_diagnosis": with_ctes(*SOLAR_CTES, body="""
SELECT criterion_id, count(*) AS n, count(*) FILTER (WHERE n_excl = 1) AS n_sole FROM (
  SELECT unnest(string_split(exclusions, ',')) AS criterion_id, len(string_split(exclusions, ',')) AS n_excl FROM final WHERE exclusions <> '') GROUP BY 1"""),
    "exclusion_classes": with_ctes("sites", "zones", ZONE_EDGES, inside("sites", "loc_id"), body="""
, f AS (SELECT loc_id, bool_or(kind = 'protected') AS pr, bool_or(kind = 'protected' AND gap_status IN (1, 2)) AS g, bool_or(kind = 'wetland') AS we, arg_min(flood_zone, zone_id) AS z
  FROM zone_hits JOIN zones USING (zone_id) GROUP BY loc_id),
s AS (SELECT sites.loc_id, nlcd_code, slope_pct, hydric_rating, coalesce(pr, FALSE) AS pr, coalesce(g, FALSE) AS g, coalesce(we, FALSE) AS we, coalesce(z, 'X') AS z FROM sites LEFT JOIN f USING (loc_id)),
v AS (SELECT loc_id, 'excl_protected' AS criterion_id, CASE WHEN g THEN 'true' ELSE 'false_positive' END AS verdict FROM s WHERE pr
  UNION ALL SELECT loc_id, 'excl_urban', CASE WHEN nlcd_code IN (23, 24) THEN 'true' ELSE 'false_positive' END FROM s WHERE nlcd_code BETWEEN 21 AND 24
  UNION ALL SELECT loc_id, 'excl_flood', CASE WHEN z LIKE 'V%' THEN 'true' ELSE 'false_positive' END FROM s WHERE z LIKE 'A%' OR z LIKE 'V%'
  UNION ALL SELECT loc_id, 'excl_steep', CASE WHEN slope_pct >= 20 THEN 'true' ELSE 'false_positive' END FROM s WHERE slope_pct > 15
  UNION ALL SELECT loc_id, 'excl_wetlands', 'review' FROM s WHERE we OR hydric_rating = 'Yes')
SELECT criterion_id, verdict, count(*) AS n, min(loc_id) AS first_site FROM v GROUP BY ALL"""),
    "solar_v1_score": with_ctes("sites", PARCELS, body="""
SELECT loc_id, score AS suitability_score, rating AS suitability_rating, round(acreage / 5e0, 1) AS capacity_mw, passed_all FROM rated"""),
    "solar_v1_provisional": with_ctes("sites", PARCELS, body="""
SELECT loc_id, round(s, 4) AS suitability_score, CASE WHEN s >= 0.6 THEN 'High' WHEN s >= 0.4 THEN 'Moderate' ELSE 'Low' END AS suitability_rating,
  base_ok AS passed_all FROM (SELECT loc_id, base_ok,
    (p_ghi * 0.3e0 + p_grid * 0.3e0 + p_soil * 0.06e0 + p_road * 0.18e0 + p_use * 0.05e0) / 0.89e0 AS s FROM parts)"""),
    "discover": with_ctes("sites", PARCELS, body="""
SELECT loc_id, score AS suitability_score, rating AS suitability_rating FROM boxed WHERE ok ORDER BY score DESC, loc_id LIMIT 25"""),
    "discover_summary": with_ctes("sites", PARCELS, body="""
SELECT count(*) AS total_in_geo, count(*) FILTER (WHERE ok) AS passing, round(coalesce(sum(acreage) FILTER (WHERE ok), 0e0) / 5e0, 3) AS capacity_mw,
  count(*) FILTER (WHERE ok AND rating = 'High') AS n_high, count(*) FILTER (WHERE ok AND rating = 'Moderate') AS n_moderate,
  count(*) FILTER (WHERE ok AND rating = 'Low') AS n_low FROM boxed"""),
    "batch_rank": with_ctes("sites", PARCELS, body="""
SELECT segment, loc_id, NOT passed_all AS excluded, row_number() OVER (PARTITION BY segment ORDER BY NOT passed_all, score DESC, loc_id) AS rank FROM rated"""),
    "deep_resource": with_ctes("sites", body="""
SELECT loc_id, kw AS system_capacity_kw, tilt AS tilt_deg, round(kw * capacity_factor_pct / 100e0 * 8760e0, 0) AS annual_kwh,
  CASE WHEN capacity_factor_pct >= 23 THEN 'excellent' WHEN capacity_factor_pct >= 20 THEN 'strong' WHEN capacity_factor_pct >= 17 THEN 'moderate'
    WHEN capacity_factor_pct >= 14 THEN 'weak' ELSE 'very weak' END AS cf_class, capacity_factor_pct < 17 AS low_cf_advisory FROM (
  SELECT *, CASE WHEN acreage > 0 THEN round(acreage / 5e0 * 1000e0, 1) ELSE 0e0 END AS kw, round(CAST(greatest(5e0, least(35e0, abs(lat) - 5)) AS DECIMAL(18,6)), 1)::DOUBLE AS tilt FROM sites)"""),
    "interconnection_cost": with_ctes("sites", "lines", "substations", "plants", body=f"""
, best AS (SELECT p.loc_id, min({segment_sql('p', 'e')}) AS d, arg_min(coalesce(e.voltage, ''), ({segment_sql('p', 'e')}, e.line_id)) AS voltage
  FROM sites p CROSS JOIN lines e GROUP BY p.loc_id),
st AS (SELECT loc_id, arg_min(sub_id, (d, sub_id)) AS sub_id, min(d) AS sub_m FROM (
  SELECT s.loc_id, b.sub_id, {hav('s.lng', 's.lat', 'b.lng', 'b.lat')} AS d FROM sites s CROSS JOIN substations b) GROUP BY loc_id),
mw AS (SELECT s.loc_id, sum(p.capacity_mw) AS mw, count(*) AS n_plants FROM sites s JOIN plants p ON abs(s.lat - p.lat) < 0.3 AND p.operating_status = 'OP'
  AND {hav('s.lng', 's.lat', 'p.lng', 'p.lat')} <= 25000 GROUP BY s.loc_id),
c AS (SELECT loc_id, round(d / 1000e0, 2) AS km, CASE voltage WHEN '' THEN 620000e0 WHEN '115000' THEN 620000e0 WHEN '230 kV' THEN 1550000e0
    WHEN '500000;230000' THEN 1550000e0 ELSE 620000e0 END AS rate, acreage / 7.5e0 AS cap, coalesce(mw, 0e0) AS mw, coalesce(n_plants, 0) AS n_plants, sub_id, sub_m
  FROM sites JOIN best USING (loc_id) JOIN st USING (loc_id) LEFT JOIN mw USING (loc_id))
SELECT loc_id, km AS distance_km, rate AS usd_per_km, round(round(km * rate + 3500000e0, 0) / 1000e0, 0) AS total_kusd,
  CASE WHEN mw < 50 THEN 'low' WHEN mw < 200 THEN 'moderate' ELSE 'high' END AS congestion, km > 16.1 AS distant_line,
  CASE WHEN cap > 0 THEN (km * rate + 3500000e0) / cap > 500000 END AS high_cost, sub_id, round(sub_m, 1) AS sub_m, n_plants, round(mw, 3) AS existing_mw FROM c"""),
}
ORACLES["availability_record"] = with_ctes(*PROBES, body=f"""
SELECT loc_id, source_id, coalesce(n, 0) AS n, round(nearest_m, 2) AS nearest_m FROM sites CROSS JOIN (SELECT unnest([{', '.join(repr(s) for s in PROBED)}]) AS source_id) LEFT JOIN probe_counts USING (loc_id, source_id)""")
ORACLES["source_document"] = with_ctes(*PROBES, body=" UNION ALL ".join(
    f"SELECT '{w}' AS workflow, '{s}' AS source_id, (SELECT count(*) FROM probed WHERE {available_sql(s)}) AS n_sites"
    for w, s in sorted({(c.workflow, n.source_id) for c in catalog.CRITERIA for n in c.tree})))
ORACLES["gap_messages"] = with_ctes(*PROBES, body="SELECT workflow, criterion_id, message, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{c.workflow}' AS workflow, '{c.criterion_id}' AS criterion_id, '{catalog.CRITERION_NAMES[c.criterion_id]} has no data here.' AS message, {confidence_sql(c)} AS conf FROM probed"
    for c in catalog.CRITERIA) + ") WHERE conf = 0 GROUP BY ALL")
ORACLES["enrich_parcels"] = with_ctes("sites", "lines", "substations", "zones", ZONE_EDGES, inside("sites", "loc_id"), body=f"""
, hits AS (SELECT loc_id, zone_id, gap_status, CASE WHEN flood_zone LIKE 'A%' OR flood_zone LIKE 'V%' THEN 'flood' ELSE kind END AS kind FROM zone_hits JOIN zones USING (zone_id)),
f AS (SELECT loc_id, bool_or(kind = 'flood') AS fl, bool_or(kind = 'wetland') AS we, bool_or(kind = 'protected') AS pr, min(zone_id) AS unit_id, arg_min(gap_status, zone_id) AS soil_class FROM hits GROUP BY loc_id),
d AS (SELECT p.loc_id, e.voltage IS NOT NULL AS live, {segment_sql('p', 'e')} AS d FROM sites p CROSS JOIN lines e),
n AS (SELECT loc_id, min(d) FILTER (WHERE live) AS g, min(d) AS r FROM d GROUP BY loc_id),
s AS (SELECT p.loc_id, arg_min(b.sub_id, ({hav('p.lng', 'p.lat', 'b.lng', 'b.lat')}, b.sub_id)) AS station_id FROM sites p CROSS JOIN substations b GROUP BY p.loc_id)
SELECT loc_id, coalesce(fl, FALSE) AS in_flood, coalesce(we, FALSE) AS in_wetland, coalesce(pr, FALSE) AS in_protected, unit_id, f.soil_class,
  round(g, 2) AS grid_distance_m, round(r, 2) AS road_distance_m, station_id FROM sites LEFT JOIN f USING (loc_id) LEFT JOIN n USING (loc_id) LEFT JOIN s USING (loc_id)""")
_LOST = (
    "sites", "zones", "raster", ZONE_EDGES, PARCEL_BOXES, ZONE_SHAPES, TERRAIN,
    "union_parts AS (SELECT *, kind AS part FROM zone_boxes WHERE kind <> 'wetland' UNION ALL SELECT *, 'flood' FROM zone_boxes WHERE flood_zone LIKE 'A%' OR flood_zone LIKE 'V%')",
    strip_areas("cover", "parcels", "loc_id", f"union_parts ON {NEAR_ZONE}", "zone_shapes"),
    strip_areas("wet", "parcels", "loc_id", f"(SELECT *, shape AS part FROM zone_boxes WHERE kind = 'wetland') ON {NEAR_ZONE}", "zone_shapes"),
    f"""areas AS (SELECT loc_id, part, area FROM cover UNION ALL SELECT loc_id, 'wetland', sum(area) FROM wet GROUP BY loc_id),
lost AS (SELECT loc_id, layer, round(x, 2) AS x FROM (
  SELECT loc_id, part AS layer, area * pow(111320e0, 2) * cos(radians(lat)) / 4046.8564224e0 AS x FROM areas JOIN parcels USING (loc_id)
  UNION ALL SELECT loc_id, 'perimeter_setback', acres * 2e0 / 100e0 FROM parcels UNION ALL SELECT loc_id, 'road_setback', acres * 3e0 / 100e0 FROM parcels
  UNION ALL SELECT loc_id, 'steep_slope', any_value(acres) * count(*) FILTER (WHERE sqrt(dx * dx + dy * dy) * 100e0 >= {STEEP_PCT}) / count(*) FROM inner_points JOIN parcels USING (loc_id) GROUP BY loc_id) WHERE round(x, 2) > 0)""",
)
ORACLES["excluded_acres"] = with_ctes(*_LOST, body="SELECT loc_id, layer, round(x, 1) AS overlap_acres FROM lost")
ORACLES["buildable_area"] = with_ctes(*_LOST, body=f"""
, t AS (SELECT loc_id, round(sum(x), 2) AS total FROM lost GROUP BY loc_id)
SELECT loc_id, round(coalesce(total, 0e0), 1) AS total_exclusion_acres, CASE WHEN acres > 0 THEN round(round(greatest(0e0, acres - coalesce(total, 0e0)) * 100e0 / acres, 2), 1) ELSE 0e0 END AS buildable_pct,
  round(round(greatest(0e0, acres - coalesce(total, 0e0)) / {K.ACRES_PER_MW[2]!r}, 2), 0) AS adjusted_capacity_mw FROM parcels LEFT JOIN t USING (loc_id)""")
