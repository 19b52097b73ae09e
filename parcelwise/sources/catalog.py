"""Source and criterion catalogs as typed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K

SOURCE_SCHEMA = (
    "source_id string, access_method string, coverage_type string, coverage_states array<string>, "
    "reliability string, data_category string, applicable_workflows array<string>, has_fallback boolean, "
    "fallback_status string"
)
CRITERION_SCHEMA = (
    "criterion_id string, workflow_type string, criterion_type string, weight_default double, weight_min double, "
    "weight_max double, data_tree array<struct<source_id:string,relationship:string,quality:string,"
    "confidence_value:double,missing_confidence:double>>"
)

SOLAR, HAZARD, TRADE = "solar_siting", "hazard_assessment", "trade_area"

# ── fixed values: sources ───────────────────────────────────────────────────
# id, access, coverage, states, reliability, category, workflows, fallback?, fallback status
SOURCES = (
    ("nrel_pvwatts_v8", "rest_api", "national", None, "verified", "solar_resource", (SOLAR,), False, None),
    ("usgs_3dep", "rest_api", "national", None, "verified", "terrain", (SOLAR, HAZARD), False, None),
    ("fema_nfhl", "rest_api", "national", None, "verified", "hazard", (SOLAR, HAZARD), False, None),
    ("usace_nsi", "rest_api", "national", None, "verified", "building", (HAZARD,), False, None),
    ("usda_sda_ssurgo", "rest_api", "national", None, "verified", "soil", (SOLAR,), False, None),
    ("hifld_transmission", "postgis_table", "national", None, "verified", "infrastructure", (SOLAR,), False, None),
    ("osm_substations", "postgis_table", "national", ("CA", "TX", "AZ", "NV", "FL", "NC"), "verified", "infrastructure", (SOLAR,), True, None),
    ("eia_form860", "postgis_table", "national", None, "verified", "infrastructure", (SOLAR,), False, None),
    ("usfws_critical_habitat", "rest_api", "national", None, "verified", "environmental", (SOLAR,), False, None),
    ("usgs_padus", "rest_api", "national", None, "verified", "environmental", (SOLAR, HAZARD), False, None),
    ("nlcd_land_cover", "wms", "national", None, "verified", "land_cover", (SOLAR,), False, None),
    ("epa_ejscreen", "postgis_table", "national", None, "verified", "environmental", (SOLAR,), False, None),
    ("nwi_wetlands", "postgis_table", "county", ("CA",), "degraded", "environmental", (SOLAR,), True, "UNVERIFIED"),
    ("google_inundation_history", "postgis_table", "regional", None, "verified", "hydrology", (HAZARD,), False, None),
    ("google_grrr", "file", "national", None, "verified", "hydrology", (HAZARD,), False, None),
    ("usgs_nhdplus", "rest_api", "national", None, "verified", "hydrology", (HAZARD,), False, None),
    ("openfema_disasters", "rest_api", "national", None, "verified", "hazard", (HAZARD,), False, None),
    ("usgs_peak_flow", "rest_api", "national", None, "verified", "hydrology", (HAZARD,), False, None),
    ("hazus_ddfs", "postgis_table", "national", None, "verified", "hazard", (HAZARD,), False, None),
    ("usfs_fsim", "postgis_table", "national", None, "verified", "hazard", (HAZARD,), False, None),
    ("landfire_fuels_canopy", "postgis_table", "national", None, "verified", "hazard", (HAZARD,), False, None),
    ("census_acs", "rest_api", "national", None, "verified", "demographic", (TRADE,), False, None),
    ("census_lehd", "postgis_table", "county", ("TX",), "verified", "demographic", (TRADE,), False, None),
    ("osm_pois", "postgis_table", "county", ("TX",), "verified", "demographic", (TRADE,), False, None),
    ("ors_isochrones", "rest_api", "national", None, "verified", "infrastructure", (TRADE,), False, None),
    ("nwi_wetlands_rest", "rest_api", "national", None, "degraded", "environmental", (SOLAR, HAZARD), False, None),
    ("osm_substations_overpass", "rest_api", "national", None, "verified", "infrastructure", (SOLAR,), False, None),
    ("osm_pois_overpass", "rest_api", "national", None, "verified", "demographic", (TRADE,), False, None),
    ("census_acs_commuter", "rest_api", "national", None, "verified", "demographic", (TRADE,), False, None),
    ("nrel_nsrdb_ghi", "rest_api", "national", None, "verified", "solar_resource", (SOLAR,), False, None),
    ("osm_roads_overpass", "rest_api", "national", None, "verified", "infrastructure", (SOLAR,), False, None),
    ("nifc_fire_perimeters", "rest_api", "national", None, "verified", "hazard", (HAZARD,), False, None),
    ("landfire_wcs_fuel", "wcs", "national", None, "verified", "hazard", (HAZARD,), False, None),
    ("landfire_wcs_canopy", "wcs", "national", None, "verified", "hazard", (HAZARD,), False, None),
)


@dataclass(frozen=True)
class Node:
    source_id: str
    relationship: str
    quality: str
    confidence: float
    missing: float | None = None


@dataclass(frozen=True)
class Criterion:
    criterion_id: str
    workflow: str
    kind: str
    weight: float | None
    low: float | None
    high: float | None
    tree: tuple[Node, ...]

    @property
    def tree_type(self) -> str:
        kinds = {n.relationship for n in self.tree}
        return "component" if "component" in kinds else "alternative" if "alternative" in kinds else "empty"


def _either(source: str, quality: str = "authoritative", confidence: float = 1.0) -> Node:
    return Node(source, "alternative", quality, confidence)


def _part(source: str, missing: float) -> Node:
    return Node(source, "component", "authoritative", 1.0, missing)


def _extra(source: str) -> Node:
    return Node(source, "supplementary", "supplementary", 1.0)


def _scored(cid: str, workflow: str, weight: float, low: float, high: float, *tree: Node) -> Criterion:
    return Criterion(cid, workflow, "scored", weight, low, high, tree)


def _screen(cid: str, *tree: Node) -> Criterion:
    return Criterion(cid, SOLAR, "exclusion", None, None, None, tree)


# ── fixed values: criteria, weights (default, min, max) and data trees ──────
CRITERIA = (
    _scored("solar_ghi", SOLAR, 0.15, 0.10, 0.18, _either("nrel_pvwatts_v8"), _either("nrel_nsrdb_ghi", "fallback", 0.7)),
    _scored("solar_slope", SOLAR, 0.15, 0.11, 0.17, _either("usgs_3dep")),
    _scored("solar_aspect", SOLAR, 0.10, 0.08, 0.12, _either("usgs_3dep")),
    _scored(
        "solar_transmission", SOLAR, 0.25, 0.10, 0.45,
        _either("hifld_transmission"), _either("osm_substations"), _either("osm_substations_overpass", "fallback", 0.7),
    ),
    _scored("solar_road", SOLAR, 0.12, 0.10, 0.14, _either("osm_roads_overpass")),
    _scored("solar_land_cover", SOLAR, 0.10, 0.08, 0.12, _either("nlcd_land_cover")),
    _scored("solar_soil", SOLAR, 0.08, 0.05, 0.10, _either("usda_sda_ssurgo")),
    _scored("solar_ej", SOLAR, 0.05, 0.00, 0.05, _either("epa_ejscreen")),
    _screen("excl_protected", _either("usgs_padus")),
    _screen("excl_wetlands", _either("nwi_wetlands"), _either("nwi_wetlands_rest"), _either("usda_sda_ssurgo", "proxy", 0.4)),
    _screen("excl_critical_habitat", _either("usfws_critical_habitat")),
    _scored("excl_flood", SOLAR, 0.05, 0.03, 0.07, _either("fema_nfhl")),
    _screen("excl_steep", _either("usgs_3dep")),
    _screen("excl_urban", _either("nlcd_land_cover")),
    _scored("wf_likelihood", HAZARD, 0.35, 0.30, 0.45, _either("usfs_fsim"), _either("nifc_fire_perimeters", "proxy", 0.5)),
    _scored("wf_fuel_proximity", HAZARD, 0.20, 0.15, 0.25, _either("landfire_fuels_canopy"), _either("landfire_wcs_fuel", confidence=0.9)),
    _scored(
        "wf_canopy", HAZARD, 0.15, 0.10, 0.20,
        _either("landfire_fuels_canopy"), _either("landfire_wcs_canopy", confidence=0.9), _either("nlcd_land_cover", "proxy", 0.4),
    ),
    _scored("wf_slope", HAZARD, 0.10, 0.05, 0.15, _either("usgs_3dep")),
    _scored("wf_structure", HAZARD, 0.20, 0.15, 0.25, _either("usace_nsi")),
    _scored("fl_zone", HAZARD, 0.30, 0.25, 0.40, _either("fema_nfhl")),
    _scored(
        "fl_depth", HAZARD, 0.30, 0.25, 0.40,
        _part("fema_nfhl", 0.4), _part("usgs_3dep", 0.0), _part("usace_nsi", 0.7), _extra("google_inundation_history"),
    ),
    _scored("fl_historical", HAZARD, 0.15, 0.10, 0.20, _either("openfema_disasters"), _either("usgs_peak_flow", "fallback", 0.7)),
    _scored("fl_hydrology", HAZARD, 0.15, 0.10, 0.20, _either("google_grrr"), _part("usgs_nhdplus", 0.4), _extra("usgs_peak_flow")),
    _scored("fl_building", HAZARD, 0.10, 0.05, 0.15, _part("hazus_ddfs", 0.0), _part("usace_nsi", 0.4)),
    _scored("ta_population", TRADE, 0.25, 0.20, 0.30, _either("census_acs")),
    _scored("ta_competitive_gap", TRADE, 0.20, 0.15, 0.25, _either("osm_pois"), _either("osm_pois_overpass", "fallback", 0.7)),
    _scored("ta_income", TRADE, 0.15, 0.10, 0.20, _either("census_acs")),
    _scored("ta_daytime", TRADE, 0.15, 0.10, 0.20, _either("census_lehd"), _either("census_acs_commuter", "proxy", 0.4)),
    _scored("ta_accessibility", TRADE, 0.15, 0.10, 0.20, _either("ors_isochrones"), _either("euclidean_buffer", "proxy", 0.3)),
    _scored("ta_complementary", TRADE, 0.05, 0.00, 0.10, _either("osm_pois"), _either("osm_pois_overpass", "fallback", 0.7)),
    _scored("ta_flood", TRADE, 0.05, 0.00, 0.10, _either("fema_nfhl")),
)

# ── fixed values: criterion names shown to readers ──────────────────────────
CRITERION_NAMES = {
    "solar_transmission": "Transmission proximity",
    "solar_ghi": "Solar resource (GHI)",
    "solar_slope": "Terrain slope",
    "solar_road": "Road access",
    "solar_aspect": "Terrain aspect",
    "solar_land_cover": "Land cover type",
    "solar_soil": "Soil buildability",
    "solar_ej": "Environmental Justice",
    "excl_protected": "Protected areas",
    "excl_wetlands": "Wetlands",
    "excl_critical_habitat": "Critical habitat",
    "excl_flood": "Flood zone",
    "excl_steep": "Steep slope",
    "excl_urban": "Developed land",
    "wf_likelihood": "Wildfire burn probability",
    "wf_fuel_proximity": "Distance to burnable fuel",
    "wf_canopy": "Canopy cover (defensible space)",
    "wf_slope": "Terrain slope (fire behavior)",
    "wf_structure": "Building vulnerability",
    "fl_zone": "FEMA flood zone",
    "fl_depth": "Estimated flood depth",
    "fl_historical": "Historical flood events",
    "fl_hydrology": "Hydrological exposure",
    "fl_building": "Building damage estimate",
    "ta_population": "Population density",
    "ta_competitive_gap": "Competitive density",
    "ta_income": "Household income",
    "ta_daytime": "Daytime population",
    "ta_accessibility": "Drive-time accessibility",
    "ta_complementary": "Complementary businesses",
    "ta_flood": "Flood zone exposure",
}

# ── fixed values: criteria without which nothing can be assessed ────────────
# (workflow, criterion, peril)
CRITICAL = (
    (SOLAR, "solar_ghi", None),
    (HAZARD, "wf_likelihood", "wildfire"),
    (HAZARD, "fl_zone", "flood"),
    (TRADE, "ta_population", None),
)


def criteria_for(workflow: str) -> list[Criterion]:
    return [c for c in CRITERIA if c.workflow == workflow]


def default_weights(workflow: str) -> dict[str, float]:
    return {c.criterion_id: c.weight for c in criteria_for(workflow) if c.kind == "scored"}


def sources_table(spark: SparkSession) -> DataFrame:
    rows = [(*s[:3], list(s[3]) if s[3] else None, s[4], s[5], list(s[6]), s[7], s[8]) for s in SOURCES]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def criteria_table(spark: SparkSession) -> DataFrame:
    rows = [
        (
            c.criterion_id, c.workflow, c.kind, c.weight, c.low, c.high,
            [(n.source_id, n.relationship, n.quality, n.confidence, n.missing) for n in c.tree],
        )
        for c in CRITERIA
    ]
    return spark.createDataFrame(rows, CRITERION_SCHEMA)


def damage_curves(spark: SparkSession) -> DataFrame:
    """Depth–damage curves exploded from their arrays, with a length check."""
    from pyspark.sql import functions as F

    for name, (_, struct, cont) in K.DEPTH_DAMAGE.items():
        if not len(struct) == len(cont) == len(K.DDF_DEPTHS_FT):
            raise ValueError(f"curve {name} needs {len(K.DDF_DEPTHS_FT)} values")
    rows = [(n, f, list(map(float, s)), list(map(float, c))) for n, (f, s, c) in K.DEPTH_DAMAGE.items()]
    wide = spark.createDataFrame(rows, "occupancy_class string, foundation_type string, s array<double>, c array<double>")
    return wide.select(
        "occupancy_class", "foundation_type", F.posexplode(F.arrays_zip("s", "c")).alias("i", "v")
    ).select(
        "occupancy_class",
        "foundation_type",
        (F.col("i") + K.DDF_DEPTHS_FT[0]).cast("double").alias("depth_ft"),
        F.col("v.s").alias("structural_damage_pct"),
        F.col("v.c").alias("contents_damage_pct"),
    )


def region_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.STATE_REGION.items()), "state string, region string")
