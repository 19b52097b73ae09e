"""Solar siting: sub-scores, exclusions, composites, discovery and deep stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import geo
from ..functions import scoring as S
from ..operators import aggregates as A
from ..operators import counts, overlap
from ..operators import raster as raster_ops
from ..operators import spatial as X
from ..sources import catalog

SCORED = [c.criterion_id for c in catalog.criteria_for(catalog.SOLAR) if c.kind == "scored"]
AVERAGED = [c for c in SCORED if c != "excl_flood"]


# ── current method ──────────────────────────────────────────────────────────
def transmission_km() -> Column:
    """Distance from the selected source, else the nearest line."""
    chosen = F.col("src_solar_transmission")
    line, sub = F.col("nearest_hifld_transmission"), F.col("nearest_osm_substations")
    from_source = F.when(chosen == "hifld_transmission", line).when(
        chosen.isin("osm_substations", "osm_substations_overpass"), sub
    )
    return F.coalesce(from_source, line) / 1000.0


def sub_scores(road: Column | None = None) -> dict[str, Column]:
    """Raw 0–1 score per criterion from the measurement columns."""
    ej = F.when(F.coalesce(F.col("ej_percentile"), F.lit(0.0)) == 0, 50.0).otherwise(F.col("ej_percentile"))
    no_ej = F.col("ej_percentile").isNull()
    return {
        "solar_ghi": S.linear(F.coalesce(F.col("capacity_factor_pct"), F.lit(0.0)), 14.0, 22.0),
        "solar_slope": S.linear("slope_pct", 0.0, 15.0, inverted=True),
        "solar_aspect": S.aspect_score("aspect_deg", "slope_pct"),
        "solar_transmission": S.linear(transmission_km(), 0.0, 16.0, inverted=True),
        "solar_road": road if road is not None else F.lit(0.5),
        "solar_land_cover": F.when(F.col("nlcd_code").isNull(), 0.0).otherwise(S.nlcd_score("nlcd_code")),
        "solar_soil": F.when(F.col("drainage_class").isNull() & F.col("hydric_rating").isNull(), 0.5).otherwise(
            S.drainage_score("drainage_class", "hydric_rating")
        ),
        "solar_ej": F.when(no_ej, 0.5).otherwise(S.linear(ej, 0.0, 100.0, inverted=True)),
        "excl_flood": S.flood_site_score("flood_zone"),
    }


def exclusion_checks() -> dict[str, Column]:
    """True / false / null (unknown) per screen."""
    hydric = F.lower(F.coalesce(F.col("hydric_rating"), F.lit(""))) == "yes"
    wet_source = F.col("src_excl_wetlands")
    return {
        "excl_protected": F.coalesce(F.col("in_gap12"), F.lit(False)),
        "excl_wetlands": F.when(wet_source == "nwi_wetlands", F.coalesce(F.col("in_wetland"), F.lit(False))).when(
            wet_source == "usda_sda_ssurgo", hydric
        ),
        "excl_critical_habitat": F.coalesce(F.col("in_habitat"), F.lit(False)),
        "excl_steep": F.col("slope_pct") >= K.STEEP_SLOPE_PCT,
        "excl_urban": F.col("nlcd_code").isin(23, 24),
    }


def resolve_weights(
    locations: DataFrame, profiles: DataFrame | None = None, override: dict[str, float] | None = None
) -> DataFrame:
    """``w_<criterion>`` columns: override, else calibrated profile, else default.

    ``profiles``: region, method, weights MAP<STRING, DOUBLE>.
    """
    defaults = catalog.default_weights(catalog.SOLAR)
    if override:
        merged = {**defaults, **{k: float(v) for k, v in override.items() if k in defaults}}
        cols = {f"w_{c}": F.lit(merged[c]) for c in SCORED}
        return locations.withColumns({**cols, "weight_method": F.lit("explicit_override")})
    if profiles is None:
        cols = {f"w_{c}": F.lit(defaults[c]) for c in SCORED}
        return locations.withColumns({**cols, "weight_method": F.lit("literature_default")})
    side = profiles.select("region", F.col("method").alias("_method"), F.col("weights").alias("_weights"))
    joined = locations.join(side, "region", "left")
    calibrated = F.coalesce(F.col("_method") == "constrained_optimization", F.lit(False))
    cols = {
        f"w_{c}": F.when(calibrated, F.coalesce(F.col("_weights")[c], F.lit(defaults[c]))).otherwise(F.lit(defaults[c]))
        for c in SCORED
    }
    method = F.when(calibrated, "calibrated").otherwise("literature_default")
    return joined.withColumns({**cols, "weight_method": method}).drop("_method", "_weights")


def score_solar(sites: DataFrame, road: Column | None = None) -> DataFrame:
    """Composite, rating and exclusions per site.

    ``sites`` carries the measurements, ``conf_/src_`` columns from data
    selection and ``w_`` weight columns. Flood is kept out of the average and
    taken off as weight·(1 − score) in A zones; V zones exclude.
    """
    raw = sub_scores(road)
    scored = sites.withColumns(
        {f"s_{c}": F.when(F.col(f"conf_{c}") > 0, F.round(raw[c], 4)) for c in SCORED}
    )
    used = {c: F.col(f"s_{c}").isNotNull() & (F.col(f"w_{c}") != 0) for c in AVERAGED}
    zero = F.lit(0.0)
    num = reduce(lambda a, b: a + b, [F.when(used[c], F.col(f"s_{c}") * F.col(f"w_{c}")).otherwise(zero) for c in AVERAGED])
    den = reduce(lambda a, b: a + b, [F.when(used[c], F.col(f"w_{c}")).otherwise(zero) for c in AVERAGED])
    mean = F.coalesce(F.try_divide(num, den), zero)
    zone = F.upper(F.col("flood_zone"))
    in_a = (F.col("conf_excl_flood") > 0) & zone.startswith("A")
    deduction = F.when(in_a, F.col("w_excl_flood") * (1.0 - F.col("s_excl_flood"))).otherwise(zero)
    composite = F.greatest(zero, mean - deduction)
    checks = exclusion_checks()
    hits = [F.when((F.col(f"conf_{c}") > 0) & test, c) for c, test in checks.items()]
    v_zone = F.when((F.col("conf_excl_flood") > 0) & zone.startswith("V"), "excl_flood")
    exclusions = F.array_sort(F.array_compact(F.array(*hits, v_zone)))
    blocked = (F.col("conf_solar_ghi") == 0) | F.col("capacity_factor_pct").isNull()
    out = scored.withColumns({"composite": composite, "exclusions": exclusions, "cannot_assess": blocked})
    rating = F.when(F.col("cannot_assess"), K.CANNOT_ASSESS).when(F.size("exclusions") > 0, "Excluded").otherwise(
        S.rating("composite")
    )
    return out.withColumns(
        {"score": F.when(~F.col("cannot_assess"), F.round("composite", 4)), "rating": rating, "flood_deduction": F.round(deduction, 4)}
    )


# ── parcel method (seven criteria) ──────────────────────────────────────────
def parcel_weights(override: dict[str, float] | None = None) -> dict[str, float]:
    """Weights merged with overrides and renormalised to one."""
    merged = {**K.SOLAR_V1_WEIGHTS, **(override or {})}
    total = sum(merged.values())
    return {k: v / total for k, v in merged.items()}


def parcel_constraints(cfg: dict, terrain_known: bool = True) -> dict[str, Column]:
    slope_ok = F.coalesce(F.col("slope_pct") <= cfg["max_slope_pct"], F.lit(False)) if terrain_known else F.lit(True)
    return {
        "min_acreage": F.coalesce(F.col("acreage"), F.lit(0.0)) >= cfg["min_acreage"],
        "max_slope": slope_ok,
        "flood_zone_clear": ~F.coalesce(F.col("in_flood"), F.lit(False)),
        "wetlands_clear": ~F.coalesce(F.col("in_wetland"), F.lit(False)),
        "protected_lands_clear": ~F.coalesce(F.col("in_protected"), F.lit(False)),
    }


def ghi_range(parcels: DataFrame, cfg: dict) -> DataFrame:
    """One row (lo, hi): the cohort's range, or the reference when too narrow."""
    stats = parcels.agg(F.min("ghi").alias("a"), F.max("ghi").alias("b"), F.count("ghi").alias("n"))
    wide = (F.col("n") >= 2) & ((F.col("b") - F.col("a")) > 0.1)
    return stats.select(
        F.struct(
            F.when(wide, F.col("a")).otherwise(cfg["ghi_ref_min"]).alias("lo"),
            F.when(wide, F.col("b")).otherwise(cfg["ghi_ref_max"]).alias("hi"),
        ).alias("r")
    )


def score_parcels(
    parcels: DataFrame, overrides: dict | None = None, weights: dict[str, float] | None = None, terrain_known: bool = True
) -> DataFrame:
    """Composite, rating, capacity and constraint flags per parcel.

    Without terrain, slope and aspect leave the average and its weights.
    """
    cfg = {**K.SOLAR_V1_DEFAULTS, **(overrides or {})}
    w = parcel_weights(weights)
    span = parcels.withColumn("_r", ghi_range(parcels, cfg).scalar())
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    ghi = F.coalesce(F.col("ghi"), F.lit(cfg["ghi_ref_min"]))
    parts = {
        "ghi": F.when(hi - lo < 1e-9, 0.5).otherwise(S.clamp01(F.try_divide(ghi - lo, hi - lo))),
        "grid": S.clamp01(1.0 - F.coalesce(F.col("grid_distance_m"), F.lit(cfg["grid_max_distance_m"])) / cfg["grid_max_distance_m"]),
        "slope": S.clamp01(1.0 - F.coalesce(F.col("slope_pct"), F.lit(cfg["max_slope_pct"])) / cfg["max_slope_pct"]),
        "aspect": S.aspect_score("aspect_deg"),
        "soil": (9.0 - F.coalesce(F.col("soil_class"), F.lit(cfg["default_soil_class"]))) / 8.0,
        "road": S.clamp01(1.0 - F.coalesce(F.col("road_distance_m"), F.lit(cfg["road_max_distance_m"])) / cfg["road_max_distance_m"]),
        "land_use": S.lookup(S.land_use_category("zone_code"), K.LAND_USE_SCORES, K.LAND_USE_SCORES["unknown"]),
    }
    used = list(parts) if terrain_known else ["ghi", "grid", "soil", "road", "land_use"]
    total = sum(w[k] for k in used) or 1.0
    composite = reduce(lambda a, b: a + b, [parts[k] * w[k] for k in used]) / total
    checks = parcel_constraints(cfg, terrain_known)
    passed = reduce(lambda a, b: a & b, checks.values())
    return (
        span.withColumns({f"p_{k}": c for k, c in parts.items()})
        .withColumn("_c", composite)
        .withColumns(
            {
                "suitability_score": F.round("_c", 4),
                "suitability_rating": S.rating("_c", cuts=(cfg["high_threshold"], cfg["moderate_threshold"])),
                "capacity_mw": F.round(F.coalesce(F.col("acreage"), F.lit(0.0)) / cfg["acres_per_mw"], 1),
                "passed_all": passed,
                **{f"ok_{k}": c for k, c in checks.items()},
            }
        )
        .drop("_r", "_c")
    )


def enrich_parcels(
    parcels: DataFrame, key: str, screens: DataFrame, grid: DataFrame, roads: DataFrame, soils: DataFrame, resource: DataFrame, cell: float
) -> DataFrame:
    """All measurements of the parcel method for a whole table at once.

    ``screens`` are polygons with a ``kind`` (flood, wetland, protected), ``grid``
    and ``roads`` are segments, ``soils`` polygons with soil_class and zone_code,
    ``resource`` points with station_id and ghi. Parcels are points with acreage.
    """
    at = parcels.select(key, "lng", "lat")
    kinds = {f"in_{k}": F.col("kind") == k for k in ("flood", "wetland", "protected")}
    flags = X.polygon_flags(at, screens.select("kind", "rings", "x0", "y0", "x1", "y1"), cell, key, kinds).drop("lng", "lat")
    soil = X.first_polygon(at, soils, cell, key, "unit_id", ["unit_id", "soil_class", "zone_code"]).drop("lng", "lat")
    grid_m = X.nearest_line(at, grid.withColumn("_s", F.lit(0)), key, "_s", []).select(key, F.col("dist").alias("grid_distance_m"))
    road_m = X.nearest_line(at, roads.withColumn("_s", F.lit(0)), key, "_s", []).select(key, F.col("dist").alias("road_distance_m"))
    station = X.nearest(at, resource, key, "station_id", ["ghi"]).select(key, "station_id", "ghi", F.col("dist").alias("station_m"))
    out = parcels
    for side in (flags, soil, grid_m, road_m, station):
        out = out.join(side, key, "left")
    return out


# Criterion, condition under which a loose screen fires on it.
LOOSE_SCREENS = {
    "excl_protected": "in_protected_zone",
    "excl_urban": "nlcd_code IN (21, 22, 23, 24)",
    "excl_flood": "flood_zone LIKE 'A%' OR flood_zone LIKE 'V%'",
    "excl_steep": "slope_pct > 15",
    "excl_wetlands": "in_wetland OR hydric_rating = 'Yes'",
}


def exclusion_verdicts(sites: DataFrame, key: str) -> DataFrame:
    """(key, criterion_id, verdict) for every loose screen that fires.

    `true` where the siting rules exclude: managed-protected land of status 1 or 2, dense
    development, a coastal zone, a slope of 20 % or more. `false_positive` where they only
    restrict. Screens without such a rule are `review`.
    """
    verdict = {
        "excl_protected": F.when(F.col("in_gap12"), "true").otherwise("false_positive"),
        "excl_urban": F.when(F.col("nlcd_code").isin(23, 24), "true").otherwise("false_positive"),
        "excl_flood": F.when(F.col("flood_zone").startswith("V"), "true").otherwise("false_positive"),
        "excl_steep": F.when(F.col("slope_pct") >= 20, "true").otherwise("false_positive"),
    }
    fired = [F.when(F.expr(when), F.struct(F.lit(c).alias("criterion_id"), verdict.get(c, F.lit("review")).alias("verdict"))) for c, when in LOOSE_SCREENS.items()]
    return sites.select(key, F.explode(F.array_compact(F.array(*fired))).alias("_e")).select(key, "_e.*")


def passing(cfg: dict) -> Column:
    """Discover screen on enriched parcels; unknown flags count as clear."""
    max_slope_deg = F.lit(float(cfg["max_slope_deg"]))
    return (
        (F.col("acreage") >= cfg["min_acreage"])
        & ~F.coalesce(F.col("in_wetland"), F.lit(False))
        & ~F.coalesce(F.col("in_protected"), F.lit(False))
        & ~F.coalesce(F.col("in_flood"), F.lit(False))
        & (F.col("slope_degrees").isNull() | (F.col("slope_degrees") <= max_slope_deg))
        & F.col("suitability_score").isNotNull()
    )


def in_envelope(west: float, south: float, east: float, north: float) -> Column:
    return F.col("lng").between(west, east) & F.col("lat").between(south, north)


def discover(parcels: DataFrame, envelope: tuple, cfg: dict, top_n: int, key: str) -> DataFrame:
    return (
        parcels.filter(in_envelope(*envelope))
        .filter(passing(cfg))
        .orderBy(F.desc_nulls_last("suitability_score"), key)
        .limit(top_n)
    )


def discover_summary(parcels: DataFrame, envelope: tuple, cfg: dict) -> DataFrame:
    ok = passing(cfg)
    return parcels.filter(in_envelope(*envelope)).agg(
        F.count(F.lit(1)).alias("total_in_geo"),
        F.count_if(ok).alias("passing"),
        (F.coalesce(F.sum(F.when(ok, F.col("acreage"))), F.lit(0.0)) / 5.0).alias("capacity_mw"),
        *[F.count_if(ok & (F.col("suitability_rating") == r)).alias(f"n_{r.lower()}") for r in ("High", "Moderate", "Low")],
    )


# ── deep stages ─────────────────────────────────────────────────────────────
def resource_stage(parcels: DataFrame, array_type: int = 2) -> DataFrame:
    """Sizing, tilt, yearly yield and capacity-factor class."""
    at = F.lit(array_type)
    sized = parcels.withColumn("system_capacity_kw", S.capacity_kw("acreage", at))
    hours = 8760.0
    return sized.withColumns(
        {
            "tilt_deg": S.suggested_tilt("lat", at),
            "annual_kwh": F.round(F.col("system_capacity_kw") * F.col("capacity_factor_pct") / 100.0 * hours, 0),
            "cf_class": S.capacity_factor_class("capacity_factor_pct"),
            "low_cf_advisory": F.col("capacity_factor_pct") < 17.0,
        }
    )


def terrain_irradiance_factor(slope_pct: Column, aspect_deg: Column) -> Column:
    """Cosine of the deviation from south within [0.7, 1]; 1 below 1 % slope."""
    f = F.greatest(F.lit(0.7), F.least(F.lit(1.0), F.cos(F.radians(S.south_deviation(aspect_deg)))))
    return F.when(aspect_deg.isNull() | (slope_pct < 1.0), 1.0).otherwise(F.round(f, 3))


def parcel_elevations(parcels: DataFrame, key: str, raster: DataFrame, value: str, nodata: float, n: int, **affine: float) -> DataFrame:
    """Elevations on an n×n lattice over each parcel, read from the raster's cells.

    ``parcels``: key, lng, lat, acres. A lattice point outside the raster or on nodata is null.
    """
    side = geo.parcel_side_m("acres")
    lattice = F.explode(geo.lattice("lng", "lat", side, n)).alias("_p")
    points = parcels.filter(F.col("acres") > 0).select(key, (side / (n - 1)).alias("dx_m"), (side / (n - 1)).alias("dy_m"), lattice)
    points = points.select(key, "dx_m", "dy_m", "_p.i", "_p.j", "_p.lng", "_p.lat")
    read = raster_ops.sample(points, raster.select("row", "col", value), [value], nodata, **affine)
    return read.select(key, "i", "j", F.col(value).alias("elev"), "dx_m", "dy_m")


def terrain_cells(points: DataFrame, key: str) -> DataFrame:
    """Slope (rise over run) and downslope aspect of the interior lattice points.

    ``points``: key, i, j, elev, dx_m, dy_m. Neighbours meet by an equi-join on
    (key, i, j); only interior points with four known neighbours count.
    """
    slim = points.select(key, "i", "j", "elev")

    def shifted(name: str, di: int, dj: int) -> DataFrame:
        return slim.select(key, (F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col("elev").alias(name))

    stencil = points.filter(F.col("elev").isNotNull())
    for name, di, dj in (("e", 0, -1), ("w", 0, 1), ("n", -1, 0), ("s", 1, 0)):
        stencil = stencil.join(shifted(name, di, dj).filter(F.col(name).isNotNull()), [key, "i", "j"])
    slope, _ = S.stencil_slope_aspect("e", "w", "n", "s", F.col("dx_m") * 2.0, F.col("dy_m") * 2.0)
    dz_dx, dz_dy = (F.col("e") - F.col("w")) / (F.col("dx_m") * 2.0), (F.col("n") - F.col("s")) / (F.col("dy_m") * 2.0)
    aspect = F.pmod(F.degrees(F.atan2(-dz_dx, -dz_dy)) + 360.0, F.lit(360.0))
    return stencil.select(key, "i", "j", slope.alias("slope"), aspect.alias("aspect_deg"))


def terrain_stage(points: DataFrame, key: str) -> DataFrame:
    """Slope, dominant aspect and uniformity from a lattice of elevations."""
    cells = terrain_cells(points, key)
    grades = cells.groupBy(key).agg(
        F.count(F.lit(1)).alias("interior_cells"),
        F.avg("slope").alias("_g"),
        A.circular_mean(F.col("slope"), F.col("aspect_deg")).alias("dominant_aspect_deg"),
    )
    spread = points.groupBy(key).agg(F.stddev_pop("elev").alias("elev_std_m"))
    std = F.col("elev_std_m")
    return grades.join(spread, key).select(
        key,
        "interior_cells",
        (F.col("_g") * 100.0).alias("mean_slope_pct"),
        S.slope_degrees("_g").alias("mean_slope_deg"),
        "dominant_aspect_deg",
        "elev_std_m",
        F.when(std < 2, "flat").when(std < 5, "gently rolling").when(std < 15, "variable").otherwise("steep/irregular").alias("terrain_rating"),
        terrain_irradiance_factor(F.col("_g") * 100.0, F.col("dominant_aspect_deg")).alias("irradiance_factor"),
    )


def buildable_stage(parcels: DataFrame, exclusions: DataFrame, key: str, array_type: int = 2) -> DataFrame:
    """Total − Σ exclusion acres. Layers are summed, not unioned, by intent."""
    lost = exclusions.groupBy(key).agg(F.sum("overlap_acres").alias("_x"))
    apm = K.ACRES_PER_MW.get(array_type, 5.0)
    total = F.round(F.coalesce(F.col("_x"), F.lit(0.0)), 2)
    left = F.greatest(F.lit(0.0), F.col("acres") - total)
    return parcels.join(lost, key, "left").select(
        key,
        "acres",
        total.alias("total_exclusion_acres"),
        F.round(left, 2).alias("buildable_acres"),
        F.round(F.coalesce(F.try_divide(left * 100.0, F.col("acres")), F.lit(0.0)), 2).alias("buildable_pct"),
        F.round(left / apm, 2).alias("adjusted_capacity_mw"),
    )


def steep_acres(cells: DataFrame, parcels: DataFrame, key: str, threshold_pct: float) -> DataFrame:
    """Share of interior lattice slopes at or over the threshold × parcel acres."""
    share = F.count_if(F.col("slope") * 100.0 >= threshold_pct) / F.count(F.lit(1))
    return cells.groupBy(key).agg(share.alias("_s")).join(parcels.select(key, "acres"), key).select(key, (F.col("_s") * F.col("acres")).alias("overlap_acres"))


def exclusion_layers(parcels: DataFrame, key: str, summed: dict[str, DataFrame], unions: DataFrame, cells: DataFrame, steep_pct: float, setbacks: dict[str, float], cell: float) -> DataFrame:
    """Acres of each parcel lost to each layer, as (key, layer, overlap_acres); layers without loss give no row.

    ``summed`` layers count every feature, ``unions`` (column ``layer``) count overlapping features
    once, both by exact areas; ``cells`` are the parcels' terrain cells; setbacks are flat shares.
    """
    size = parcels.select(key, "lat", "acres")

    def acres(areas: DataFrame) -> DataFrame:
        return areas.join(size, key).select(key, "layer", geo.deg2_to_acres("area_deg2", "lat").alias("overlap_acres"))

    parts = [acres(overlap.union_cover(parcels, unions, key, "layer", cell))]
    parts += [acres(overlap.summed_overlap(parcels, layer, key, cell).withColumn("layer", F.lit(name))) for name, layer in summed.items()]
    parts.append(steep_acres(cells, parcels, key, steep_pct).select(key, F.lit("steep_slope").alias("layer"), "overlap_acres"))
    parts += [size.select(key, F.lit(name).alias("layer"), setback_acres(F.col("acres"), share).alias("overlap_acres")) for name, share in setbacks.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.select(key, "layer", F.round("overlap_acres", 2).alias("overlap_acres")).filter("overlap_acres > 0")


def setback_acres(acres: Column, percent: float) -> Column:
    """Flat share of the parcel lost to a setback."""
    return acres * percent / 100.0


def interconnection_stage(sites: DataFrame, equipment_usd: float = K.INTERCONNECTION_EQUIPMENT_USD) -> DataFrame:
    """Gen-tie and total cost, cost per MW, congestion and advisories.

    Needs line_m, line_voltage, sub_m, capacity_mw, nearby_mw.
    """
    km = F.round(F.col("line_m") / 1000.0, 2)
    rate = S.gen_tie_usd_per_km(S.voltage_kv("line_voltage"))
    out = sites.withColumns({"distance_km": km, "usd_per_km": rate})
    tie = F.col("distance_km") * F.col("usd_per_km")
    total = tie + equipment_usd
    per_mw = F.when(F.col("capacity_mw") > 0, total / F.nullif(F.col("capacity_mw"), F.lit(0.0)))
    return out.withColumns(
        {
            "gen_tie_usd": F.round(tie, 0),
            "total_usd": F.round(total, 0),
            "usd_per_mw": F.round(per_mw, 0),
            "congestion": S.congestion_class(F.coalesce(F.col("nearby_mw"), F.lit(0.0))),
            "distant_line": F.col("distance_km") > K.DISTANT_TRANSMISSION_KM,
            "high_cost": per_mw > K.HIGH_COST_PER_MW,
        }
    )


def queue_context(sites: DataFrame, queue: DataFrame, key: str, radius_m: float = 50_000.0) -> DataFrame:
    """Queue projects near each site: counts, megawatts, status mix, usual ISO.

    Projects are summed per (position, ISO) before the radius join, so counties
    placed on one centroid cost one candidate each.
    """
    active = F.col("status") == "Active"
    solar = active & F.coalesce(F.lower("fuel_type").startswith("solar"), F.lit(False))
    measures = {
        "n_projects": F.count(F.lit(1)),
        "n_active": F.count_if(active),
        "n_active_solar": F.count_if(solar),
        "solar_mw": F.sum(F.when(solar, F.col("capacity_mw")).otherwise(0.0)),
        "n_withdrawn": F.count_if(F.col("status") == "Withdrawn"),
    }
    spots = queue.groupBy("f_lng", "f_lat", "iso").agg(*[c.alias(n) for n, c in measures.items()])
    pairs = X.within_radius(sites.select(key, "lng", "lat"), spots, radius_m)
    by_iso = pairs.groupBy(key, "iso").agg(*[F.sum(n).alias(n) for n in measures])
    usual = F.min_by("iso", F.struct(-F.col("n_projects"), F.col("iso")))
    found = by_iso.groupBy(key).agg(*[F.sum(n).alias(n) for n in measures], usual.alias("usual_iso"))
    zeros = {n: F.coalesce(F.col(n), F.lit(0.0 if n == "solar_mw" else 0)) for n in measures}
    return sites.select(key).join(found, key, "left").withColumns(zeros)


def largest_projects(sites: DataFrame, queue: DataFrame, plants: DataFrame, key: str, k: int = 5, radius_m: float = 50_000.0) -> DataFrame:
    """The k largest active queue projects near each site, with the operating capacity in the same radius.

    Ties go by ``queue_id``.
    """
    active = queue.filter((F.col("status") == "Active") & F.col("capacity_mw").isNotNull())
    top = X.largest_within(sites, active, key, radius_m, "capacity_mw", "queue_id", k)
    running = counts.sums_within_radius(sites, plants.filter(F.col("operating_status") == "OP"), key, radius_m, {"operating_mw": F.sum("capacity_mw"), "n_operating": F.count(F.lit(1))})
    return top.join(running, key, "left").select(
        key, "rank", "queue_id", "capacity_mw", "dist", F.coalesce("operating_mw", F.lit(0.0)).alias("operating_mw"), F.coalesce("n_operating", F.lit(0)).alias("n_operating")
    )
