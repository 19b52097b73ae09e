"""Tables, thresholds and identifiers that results depend on."""

from __future__ import annotations

# ── fixed values: earth and unit constants ──────────────────────────────────
EARTH_RADIUS_M = 6_371_000.0
WEB_MERCATOR_RADIUS_M = 6_378_137.0
METRES_PER_DEGREE = 111_320.0
MIN_COS_LAT = 0.1
SQUARE_METRES_PER_ACRE = 4046.8564224

# ── fixed values: wildfire vulnerability model ──────────────────────────────
WILDFIRE_COEFFICIENTS = {
    "const": 0.9304137982718326,
    "burn_probability": -130.75537981077997,
    "distance_to_fuel_m": 0.01919159438809745,
    "canopy_cover_100m": -0.023897246113682814,
    "slope_degrees": 0.06880940046522348,
    "is_res1": 0.24504502964155503,
}
WILDFIRE_THRESHOLD = 0.8621269859078249
RETURN_PERIODS_YEARS = (10, 25, 50, 100, 250, 500, 1000)
# (label, lower, upper); None is unbounded. "$0" means exactly zero.
LOSS_BUCKETS = (
    ("$0", 0.0, 0.0),
    ("$0-10", 0.0, 10.0),
    ("$10-100", 10.0, 100.0),
    ("$100-500", 100.0, 500.0),
    ("$500-1000", 500.0, 1000.0),
    ("$1000+", 1000.0, None),
)
RISK_HIGH_USD = 500.0
RISK_MODERATE_USD = 50.0
FIRE_RECORD_YEARS = 45

# ── fixed values: flood ─────────────────────────────────────────────────────
FLOOD_AEP = {"sfha": 0.01, "shaded_x": 0.002, "minimal": 0.001}
DEFAULT_SFHA_DEPTH_FT = 3.0
DEFAULT_FIRST_FLOOR_FT = 1.0
BFE_SENTINEL = -9000.0
DDF_DEPTHS_FT = tuple(range(-4, 25))
# class -> (foundation, structure %, contents %) at DDF_DEPTHS_FT
DEPTH_DAMAGE = {
    "RES1-1SNB": (
        "slab",
        (0, 0, 0, 0, 18, 22, 25, 28, 30, 31, 40, 43, 43, 45, 46, 47, 47, 49, 50, 50, 50, 51, 51, 52, 52, 53, 53, 54, 54),
        (0, 0, 0, 0, 12, 25, 35, 36, 38, 41, 45, 50, 55, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60),
    ),
    "RES1-1SWB": (
        "basement",
        (7, 7, 7, 11, 17, 21, 29, 34, 38, 43, 50, 50, 54, 55, 55, 57, 58, 60, 62, 63, 65, 67, 69, 70, 72, 74, 76, 77, 79),
        (0, 5, 7, 8, 16, 20, 22, 28, 33, 39, 44, 50, 55, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60),
    ),
    "RES1-2SNB": (
        "slab",
        (0, 0, 0, 0, 11, 12, 14, 18, 20, 22, 24, 26, 30, 34, 38, 39, 40, 42, 43, 44, 45, 47, 48, 49, 50, 52, 53, 54, 56),
        (0, 0, 0, 0, 8, 11, 19, 23, 28, 33, 39, 44, 50, 54, 58, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60),
    ),
    "RES1-2SWB": (
        "basement",
        (4, 4, 8, 14, 19, 21, 26, 29, 34, 39, 44, 50, 55, 57, 59, 61, 63, 65, 66, 68, 69, 71, 72, 74, 75, 77, 79, 80, 82),
        (0, 5, 7, 8, 16, 18, 25, 29, 33, 37, 42, 46, 52, 55, 58, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60, 60),
    ),
    "RES2": (
        "manufactured",
        (0, 0, 0, 0, 11, 44, 63, 73, 78, 79, 81, 82, 83, 84, 85, 86, 88, 89, 90, 91, 92, 94, 95, 96, 97, 98, 99, 100, 100),
        (0, 0, 0, 0, 3, 27, 49, 64, 70, 76, 78, 79, 81, 83, 83, 83, 83, 83, 83, 83, 83, 83, 83, 83, 83, 83, 83, 83, 83),
    ),
    "COM1": (
        "slab",
        (0, 0, 0, 0, 1, 9, 14, 16, 18, 20, 23, 26, 30, 34, 38, 42, 47, 51, 55, 58, 61, 64, 67, 69, 71, 74, 76, 78, 80),
        (0, 0, 0, 0, 2, 26, 42, 56, 68, 78, 83, 85, 87, 88, 89, 90, 91, 92, 92, 92, 93, 93, 94, 94, 94, 94, 94, 94, 94),
    ),
}

# ── fixed values: earthquake ────────────────────────────────────────────────
QUAKE_RETURN_YEARS = 2475.0
DAMAGE_STATES = ("slight", "moderate", "extensive", "complete")
DAMAGE_RATIOS = {"slight": 0.02, "moderate": 0.10, "extensive": 0.50, "complete": 1.00}
FRAGILITY_BETA = 0.64
# building type -> code level -> median PGA (g) per damage state
FRAGILITY_MEDIANS = {
    "W1": {
        "pre_code": (0.18, 0.29, 0.51, 0.77),
        "low": (0.20, 0.34, 0.62, 1.03),
        "moderate": (0.24, 0.43, 0.91, 1.80),
        "high": (0.26, 0.55, 1.28, 2.50),
    },
    "W2": {
        "pre_code": (0.14, 0.22, 0.40, 0.70),
        "low": (0.16, 0.28, 0.55, 1.00),
        "moderate": (0.20, 0.38, 0.80, 1.55),
        "high": (0.24, 0.50, 1.10, 2.10),
    },
    "S1L": {
        "pre_code": (0.10, 0.15, 0.28, 0.55),
        "low": (0.12, 0.19, 0.35, 0.70),
        "moderate": (0.15, 0.25, 0.49, 1.05),
        "high": (0.18, 0.32, 0.66, 1.55),
    },
    "C1L": {
        "pre_code": (0.10, 0.14, 0.24, 0.43),
        "low": (0.12, 0.18, 0.34, 0.65),
        "moderate": (0.15, 0.24, 0.49, 1.05),
        "high": (0.18, 0.31, 0.65, 1.55),
    },
    "RM1L": {
        "pre_code": (0.13, 0.19, 0.34, 0.62),
        "low": (0.15, 0.24, 0.45, 0.85),
        "moderate": (0.19, 0.32, 0.66, 1.40),
        "high": (0.22, 0.41, 0.88, 2.10),
    },
    "URML": {
        "pre_code": (0.13, 0.17, 0.26, 0.37),
        "low": (0.14, 0.20, 0.32, 0.46),
        "moderate": (0.18, 0.27, 0.46, 0.71),
        "high": (0.18, 0.27, 0.46, 0.71),
    },
    "MH": {
        "pre_code": (0.11, 0.18, 0.31, 0.60),
        "low": (0.13, 0.22, 0.40, 0.80),
        "moderate": (0.13, 0.22, 0.40, 0.80),
        "high": (0.13, 0.22, 0.40, 0.80),
    },
}
# (largest slope m/m, VS30 m/s); the last row has no upper slope
SLOPE_VS30 = (
    (0.0005, 180.0),
    (0.0014, 240.0),
    (0.0028, 300.0),
    (0.0044, 360.0),
    (0.0078, 400.0),
    (0.0136, 490.0),
    (0.0250, 620.0),
    (0.0480, 760.0),
    (None, 900.0),
)
DEFAULT_VS30 = 490.0
# (class, lowest VS30, amplification, description), hardest first
SITE_CLASSES = (
    ("A", 1500.0, 0.8, "hard rock"),
    ("B", 760.0, 1.0, "rock"),
    ("C", 360.0, 1.2, "very dense soil / soft rock"),
    ("D", 180.0, 1.6, "stiff soil"),
    ("E", 0.0, 2.5, "soft clay / fill"),
)

# ── fixed values: land cover ────────────────────────────────────────────────
NLCD_LABELS = {
    11: "Open Water",
    12: "Perennial Ice/Snow",
    21: "Developed, Open Space",
    22: "Developed, Low Intensity",
    23: "Developed, Medium Intensity",
    24: "Developed, High Intensity",
    31: "Barren Land (Rock/Sand/Clay)",
    41: "Deciduous Forest",
    42: "Evergreen Forest",
    43: "Mixed Forest",
    51: "Dwarf Scrub",
    52: "Shrub/Scrub",
    71: "Grassland/Herbaceous",
    72: "Sedge/Herbaceous",
    73: "Lichens",
    74: "Moss",
    81: "Pasture/Hay",
    82: "Cultivated Crops",
    90: "Woody Wetlands",
    95: "Emergent Herbaceous Wetlands",
}
NLCD_GROUPS = {
    "water": (11, 12),
    "developed": (21, 22, 23, 24),
    "barren": (31,),
    "forest": (41, 42, 43),
    "shrubland": (51, 52),
    "grassland": (71, 72, 73, 74),
    "cropland": (81, 82),
    "wetlands": (90, 95),
}
NLCD_SCORES = {
    11: 0.0, 12: 0.0,
    21: 0.3, 22: 0.1, 23: 0.0, 24: 0.0,
    31: 0.9,
    41: 0.3, 42: 0.3, 43: 0.3,
    51: 0.6, 52: 0.6,
    71: 0.7, 72: 0.7, 73: 0.7, 74: 0.7,
    81: 0.8,
    82: 0.9,
    90: 0.0, 95: 0.0,
}
NON_BURNABLE_FUELS = (0, 91, 92, 93, 98, 99, -9999, 255)

# ── fixed values: solar ─────────────────────────────────────────────────────
STEEP_SLOPE_PCT = 20.0
SOLAR_V1_WEIGHTS = {
    "ghi": 0.10, "grid": 0.45, "slope": 0.12, "aspect": 0.04,
    "soil": 0.06, "road": 0.18, "land_use": 0.05,
}
LAND_USE_SCORES = {
    "agricultural": 1.0, "rural": 0.85, "unknown": 0.75, "industrial": 0.5,
    "commercial": 0.35, "residential": 0.15, "other": 0.6,
}
SOLAR_V1_DEFAULTS = {
    "min_acreage": 10.0,
    "max_slope_pct": 15.0,
    "grid_max_distance_m": 50_000.0,
    "road_max_distance_m": 20_000.0,
    "ghi_ref_min": 4.0,
    "ghi_ref_max": 7.0,
    "high_threshold": 0.70,
    "moderate_threshold": 0.40,
    "acres_per_mw": 5.0,
    "default_soil_class": 4,
}
ACRES_PER_MW = {0: 5.0, 1: 5.0, 2: 7.5, 3: 7.5, 4: 9.0}
# (largest kV, USD per km, label); the last row has no upper voltage
GEN_TIE_COSTS = (
    (69.0, 310_000.0, "<69 kV"),
    (138.0, 620_000.0, "69-138 kV"),
    (230.0, 930_000.0, "138-230 kV"),
    (None, 1_550_000.0, ">230 kV"),
)
UNKNOWN_VOLTAGE_COST = 620_000.0
INTERCONNECTION_EQUIPMENT_USD = 3_500_000.0
CONGESTION_RADIUS_M = 25_000.0
HIGH_COST_PER_MW = 500_000.0
DISTANT_TRANSMISSION_KM = 16.1

# ── fixed values: trade area ────────────────────────────────────────────────
TRADE_CATEGORIES = {
    "coffee_shop": ("amenity:cafe",),
    "pharmacy": ("amenity:pharmacy",),
    "restaurant": ("amenity:restaurant",),
    "fast_food": ("amenity:fast_food",),
    "bank": ("amenity:bank",),
    "gym": ("leisure:fitness_centre",),
    "grocery": ("shop:supermarket", "shop:convenience"),
    "urgent_care": ("amenity:clinic",),
}
TRADE_CATEGORY_PREFIXES = {"urgent_care": ("healthcare:",)}
REFERENCE_DENSITY = {
    "coffee_shop": 3.0, "pharmacy": 1.5, "restaurant": 8.0, "fast_food": 6.0,
    "bank": 2.0, "gym": 1.5, "grocery": 2.0, "urgent_care": 1.0,
}
DEFAULT_REFERENCE_DENSITY = 3.0
TRADE_WEIGHTS = {
    "population": 0.25, "income": 0.15, "competitive_gap": 0.20, "daytime": 0.15,
    "accessibility": 0.10, "complementary": 0.10, "flood": 0.05,
}
TRADE_REFERENCES = {
    "population": 100_000.0,
    "income": 75_000.0,
    "daytime_jobs": 50_000.0,
    "complementary": 50.0,
    "intersection_pois": 200.0,
    "competitors_5km": 15.0,
    "complementary_5km": 300.0,
    "total_pois_5km": 600.0,
}
EUCLIDEAN_RINGS_M = {5: 3000.0, 10: 7000.0, 15: 12000.0}

# ── fixed values: probe radius (m) per table source ─────────────────────────
PROBE_RADIUS_M = {
    "hifld_transmission": 50_000.0,
    "osm_substations": 50_000.0,
    "eia_form860": 25_000.0,
    "epa_ejscreen": 1_000.0,
    "nwi_wetlands": 1_000.0,
    "google_inundation_history": 5_000.0,
    "usgs_padus": 1_000.0,
    "usfws_critical_habitat": 1_000.0,
    "census_lehd": 1_000.0,
    "osm_pois": 5_000.0,
    "hazus_ddfs": 0.0,
    "usfs_fsim": 1_000.0,
    "landfire_fuels_canopy": 1_000.0,
}

# ── fixed values: grid regions and member states ────────────────────────────
STATE_REGION = {
    "CA": "WECC", "NV": "WECC", "AZ": "WECC", "CO": "WECC", "UT": "WECC", "NM": "WECC", "OR": "WECC",
    "WA": "WECC", "MT": "WECC", "WY": "WECC", "ID": "WECC",
    "TX": "ERCOT",
    "OK": "SPP", "KS": "SPP", "NE": "SPP", "SD": "SPP", "ND": "SPP",
    "MN": "MISO", "WI": "MISO", "IA": "MISO", "IL": "MISO", "IN": "MISO", "MI": "MISO", "MO": "MISO",
    "AR": "MISO", "LA": "MISO",
    "PA": "PJM", "NJ": "PJM", "OH": "PJM", "VA": "PJM", "WV": "PJM", "MD": "PJM", "DE": "PJM",
    "KY": "PJM", "DC": "PJM",
    "NC": "SERC", "SC": "SERC", "GA": "SERC", "AL": "SERC", "TN": "SERC", "MS": "SERC", "FL": "SERC",
    "NY": "NPCC", "ME": "NPCC", "NH": "NPCC", "VT": "NPCC", "MA": "NPCC", "RI": "NPCC", "CT": "NPCC",
}

CANNOT_ASSESS = "CANNOT ASSESS"
