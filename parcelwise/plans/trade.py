"""Trade areas: rings, competition, cannibalisation, discovery, site reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import geo
from ..functions import scoring as S
from ..operators import counts, overlap
from ..operators import spatial as X

BOX = ("rings", "x0", "y0", "x1", "y1")


def competes(category: str, business: str, custom: list[str] | None = None) -> Column:
    """Category is in the exact list or starts with a listed prefix."""
    exact = list(custom) if custom else list(K.TRADE_CATEGORIES.get(business, ()))
    prefixes = () if custom else K.TRADE_CATEGORY_PREFIXES.get(business, ())
    tests = ([F.col(category).isin(*exact)] if exact else []) + [F.col(category).startswith(p) for p in prefixes]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def circle_rings(locations: DataFrame, key: str, radii: dict[int, float] = K.EUCLIDEAN_RINGS_M) -> DataFrame:
    """One circle polygon per location and drive-time stand-in."""
    steps = F.array(*[F.struct(F.lit(m).alias("minutes"), F.lit(r).alias("radius_m")) for m, r in radii.items()])
    rows = locations.select(key, "lng", "lat", F.explode(steps).alias("_r")).select(key, "lng", "lat", "_r.*")
    rows = rows.withColumn("rings", geo.circle_rings("lng", "lat", "radius_m"))
    hx, hy = geo.parcel_half_width(F.col("radius_m") * 2.0, "lat")
    return rows.withColumns(
        {"x0": F.col("lng") - hx, "x1": F.col("lng") + hx, "y0": F.col("lat") - hy, "y1": F.col("lat") + hy}
    )


def ring_profiles(rings: DataFrame, tracts: DataFrame, key: str, cell: float) -> DataFrame:
    """Area-weighted demographics per (location, ring)."""
    tagged = rings.withColumn("_ring", F.struct(key, "minutes"))
    out = overlap.areal_rollup(tagged, tracts, "_ring", cell)
    return out.select(f"_ring.{key}", "_ring.minutes", *[c for c in out.columns if c != "_ring"])


def ring_competition(rings: DataFrame, pois: DataFrame, key: str, business: str) -> DataFrame:
    """Competitors, complements and all POIs inside each ring."""
    points = pois.select(F.col("lng").alias("f_lng"), F.col("lat").alias("f_lat"), competes("category", business).alias("_c"))
    measures = {"competitors": F.count_if("_c"), "complements": F.count_if(~F.col("_c")), "poi_count": F.count(F.lit(1))}
    found = counts.sums_in_polygons(rings.withColumn("_ring", F.struct(key, "minutes")), points, "_ring", measures)
    return found.select(f"_ring.{key}", "_ring.minutes", *measures)


def competitor_points(rings: DataFrame, pois: DataFrame, key: str, business: str, cell: float, most: int | None = None) -> DataFrame:
    """Same-category points in each ring for a map, with the full count beside them.

    ``most`` keeps a location's first points only, by id; the count stays that of all.
    """
    points = pois.filter(competes("category", business)).select("poi_id", "lng", "lat")
    hits = X.points_in_polygons(points, rings.select(key, *BOX), cell)
    if most is None:
        # The count beside each row comes from the same window's rows, so that pairs are listed and shuffled once.
        own = Window.partitionBy(key)
        every = hits.withColumns({"rank": F.row_number().over(own.orderBy("poi_id")), "n_total": F.count(F.lit(1)).over(own)})
        return every.filter(F.col(key).isNotNull())
    total = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_total"))
    return X.top_k_per_key(hits, [key], [F.col("poi_id")], most).join(total, key)


def competitive_gap(competitors: Column, population: Column, business: str) -> tuple[Column, Column]:
    """(density per 10 000 people, gap)."""
    reference = K.REFERENCE_DENSITY.get(business, K.DEFAULT_REFERENCE_DENSITY)
    density = F.when(population > 0, competitors / F.nullif(population / 10_000.0, F.lit(0.0))).otherwise(0.0)
    return density, S.clamp01(1.0 - F.least(density / reference, F.lit(1.0)))


def pick_ring(profiles: DataFrame, key: str, minutes: int) -> DataFrame:
    """The ring closest to the wanted minutes; the shorter one on ties."""
    rest = [c for c in profiles.columns if c != key]
    best = profiles.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(F.abs(F.col("minutes") - minutes), "minutes")).alias("_r")
    )
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def composite(inputs: DataFrame) -> DataFrame:
    """Seven criteria against their references.

    Needs population, median_income, jobs, competitive_gap (10-minute ring),
    complements_5, poi_count_5 (5-minute ring), road_m, in_sfha.
    """
    r = K.TRADE_REFERENCES

    def share(column: str, reference: float) -> Column:
        return S.clamp01(F.coalesce(F.col(column), F.lit(0.0)) / reference)

    road = F.coalesce(S.clamp01(1.0 - F.col("road_m") / 5000.0), F.lit(0.5))
    parts = {
        "population": share("population", r["population"]),
        "income": share("median_income", r["income"]),
        "competitive_gap": F.col("competitive_gap"),
        "daytime": share("jobs", r["daytime_jobs"]),
        "accessibility": (share("poi_count_5", r["intersection_pois"]) + road) / 2.0,
        "complementary": share("complements_5", r["complementary"]),
        "flood": F.when(F.coalesce(F.col("in_sfha"), F.lit(False)), 0.5).otherwise(1.0),
    }
    out = inputs.withColumns({f"c_{k}": F.round(v, 3) for k, v in parts.items()})
    total = reduce(lambda a, b: a + b, [F.col(f"c_{k}") * w for k, w in K.TRADE_WEIGHTS.items()])
    return out.withColumn("composite", total).withColumn(
        "rating", S.rating("composite", ("Strong", "Moderate", "Weak"))
    )


def score_trade_area(
    locations: DataFrame, tracts: DataFrame, pois: DataFrame, roads: DataFrame, flags: DataFrame, key: str, business: str, cell: float
) -> DataFrame:
    """Rings → demographics and competition → ring pick → composite."""
    rings = circle_rings(locations, key)
    people = ring_profiles(rings.filter(F.col("minutes") == 10), tracts, key, cell).drop("minutes")
    comp = ring_competition(rings.filter(F.col("minutes").isin(5, 10)), pois, key, business)
    # Both rings in one pass: taken apart, the counts would be made twice.
    at = lambda minutes, c: F.max(F.when(F.col("minutes") == minutes, F.col(c)))
    counted = comp.groupBy(key).agg(at(10, "competitors").alias("competitors"), at(5, "complements").alias("complements_5"), at(5, "poi_count").alias("poi_count_5"))
    near = X.line_distance_within(locations.select(key, "lng", "lat"), roads.withColumn("_road", F.lit(0)), key, "_road", 5_000.0).select(key, F.col("dist").alias("road_m"))
    joined = locations.join(people, key, "left").join(counted, key, "left").join(near, key, "left").join(
        flags, key, "left"
    )
    # A road beyond 5 km scores 0 like one at 5 km; only a missing layer gives the midpoint.
    joined = joined.withColumn("road_m", F.coalesce("road_m", F.lit(5_000.0)))
    density, gap = competitive_gap(
        F.coalesce(F.col("competitors"), F.lit(0)), F.coalesce(F.round("population"), F.lit(0.0)), business
    )
    return composite(joined.withColumns({"density_per_10k": density, "competitive_gap": gap}))


def partial_score(rows: DataFrame) -> DataFrame:
    """Score outside the loaded area: weights renormalised over what is known.

    Needs competitors_5km, complements_5km, pois_5km (null when not counted) and in_sfha.
    """
    r = K.TRADE_REFERENCES
    parts = {
        "flood": F.when(F.coalesce(F.col("in_sfha"), F.lit(False)), 0.5).otherwise(1.0),
        "competitive_gap": S.clamp01(1.0 - F.least(F.col("competitors_5km") / r["competitors_5km"], F.lit(1.0))),
        "complementary": S.clamp01(F.col("complements_5km") / r["complementary_5km"]),
        "accessibility": S.clamp01(F.col("pois_5km") / r["total_pois_5km"]),
    }
    known = F.col("competitors_5km").isNotNull()
    parts["competitive_gap"] = F.when(known, parts["competitive_gap"])
    zero = F.lit(0.0)
    rounded = {k: F.round(v, 3) for k, v in parts.items()}
    num = reduce(lambda a, b: a + b, [F.coalesce(v * K.TRADE_WEIGHTS[k], zero) for k, v in rounded.items()])
    den = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), K.TRADE_WEIGHTS[k]).otherwise(zero) for k, v in rounded.items()])
    return rows.withColumns({"composite": num / den, "weight_share": den}).withColumn(
        "rating", S.rating("composite", ("Strong", "Moderate", "Weak"))
    )


def route(locations: DataFrame) -> DataFrame:
    """Which method applies: full, euclidean, national, or cannot assess.

    Needs in_area, has_isochrone, conf_ta_population.
    """
    branch = (
        F.when(F.col("conf_ta_population") == 0, K.CANNOT_ASSESS)
        .when(F.col("in_area") & F.col("has_isochrone"), "full")
        .when(F.col("in_area"), "full_euclidean_fallback")
        .otherwise("national_fallback")
    )
    return locations.withColumn("coverage", branch)


def huff(pairs: DataFrame, key: str, beta: float = 2.0) -> DataFrame:
    """Existing-store capture and the largest cannibalisation per candidate.

    ``pairs``: key, overlap (0–1), t_new_m, t_ex_m, and n_stores where a row stands for several.
    """
    t_new, t_ex = F.greatest(F.col("t_new_m"), F.lit(1.0)), F.greatest(F.col("t_ex_m"), F.lit(1.0))
    p_ex = F.lit(1.0) / (F.pow(t_ex / t_new, F.lit(beta)) + 1.0)
    est = pairs.withColumn("capture", p_ex).withColumn("estimate", F.col("overlap") * F.col("capture"))
    stores = F.sum("n_stores") if "n_stores" in pairs.columns else F.count(F.lit(1))
    out = est.groupBy(key).agg(stores.alias("n_stores"), F.max("estimate").alias("max_estimate"), F.max("overlap").alias("max_overlap"))
    e = F.col("max_estimate")
    return out.withColumn("risk", F.when(e > 0.30, "High").when(e > 0.10, "Medium").otherwise("Low"))


def catchment_pairs(candidates: DataFrame, stores: DataFrame, key: str, cell: float) -> DataFrame:
    """Overlap share of each candidate's catchment with the stores' catchments, and how far
    the candidate and the store are from the middle of the common part.

    Both sides have lng, lat, rings and box. Stores that share place and catchment become one
    row with their number.
    """
    placed = stores.withColumnsRenamed({"lng": "f_lng", "lat": "f_lat"})
    shapes = overlap.same_shapes(placed, ["f_lng", "f_lat"], {"n_stores": F.count(F.lit(1))})
    met = overlap.overlap_moments(candidates, shapes, [key, "lng", "lat"], ["f_lng", "f_lat", "n_stores"], cell)
    return met.select(
        key, "n_stores", "overlap", geo.haversine_m("lng", "lat", "c_lng", "c_lat").alias("t_new_m"), geo.haversine_m("f_lng", "f_lat", "c_lng", "c_lat").alias("t_ex_m")
    )


def discover(
    grid: DataFrame, pois: DataFrame, tracts: DataFrame, business: str, min_population: float, top_n: int, cell: float
) -> DataFrame:
    """Lattice points near a POI, ranked by people and missing competition.

    ``grid``: point_id, lng, lat. Distances are planar degrees.
    """
    feats = pois.select(F.col("lng").alias("f_lng"), F.col("lat").alias("f_lat"), competes("category", business).alias("_c"))
    spots = X.collapse_copies(feats, {"_n": F.count_if("_c")})
    near = X.within_radius(grid, spots, 0.015, geo.DEGREE)
    counts = near.groupBy("point_id").agg(
        F.sum("_n").alias("competitors"), F.min("dist").alias("_nearest")
    ).filter(F.col("_nearest") <= 0.005)
    people = population_within(grid, tracts, 0.015, cell)
    pop = F.coalesce(F.col("population"), F.lit(0.0))
    density, gap = competitive_gap(F.col("competitors"), pop, business)
    scored = (
        grid.join(counts, "point_id").join(people, "point_id", "left").filter(pop >= min_population)
        .withColumn("score", F.round(S.clamp01(pop / 50_000.0) * 0.6 + gap * 0.4, 3))
        .withColumn("density_per_10k", F.round(density, 2))
    )
    return scored.orderBy(F.desc("score"), "point_id").limit(top_n)


def population_within(points: DataFrame, tracts: DataFrame, radius_deg: float, cell: float) -> DataFrame:
    """Population of every tract within planar degrees of the point."""
    left = X.own_cell(points.select("point_id", "lng", "lat"), cell)
    grown = [F.col("x0") - radius_deg, F.col("y0") - radius_deg, F.col("x1") + radius_deg, F.col("y1") + radius_deg]
    right = X.cover_cells(tracts.select("population", "x0", "y0", "x1", "y1"), cell, *grown)
    dx = F.greatest(F.col("x0") - F.col("lng"), F.lit(0.0), F.col("lng") - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col("lat"), F.lit(0.0), F.col("lat") - F.col("y1"))
    near = X.meet(left, right, X.CELL).filter(F.sqrt(dx * dx + dy * dy) <= radius_deg)
    return near.groupBy("point_id").agg(F.sum("population").alias("population"))


def regular_grid(boxes: DataFrame, step: float) -> DataFrame:
    """Lattice over each box by integer steps: i, j, lng, lat.

    Columns of the lattice are spread over tasks before their rows are made.
    """
    nx, ny = F.floor((F.col("x1") - F.col("x0")) / step + 1e-9), F.floor((F.col("y1") - F.col("y0")) / step + 1e-9)
    return (
        boxes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), nx)))
        .repartition("i")
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), ny)))
        .withColumns({"lng": F.round(F.col("x0") + F.col("i") * step, 5), "lat": F.round(F.col("y0") + F.col("j") * step, 5)})
    )


# ── site report ─────────────────────────────────────────────────────────────
def site_report(inputs: DataFrame) -> DataFrame:
    """Five 0–100 factors and their mean.

    Needs in_sfha, in_tract, in_fire_hazard, transit_count, facility_count, poi_count.
    """
    t, e, p = F.col("transit_count"), F.col("facility_count"), F.col("poi_count")
    curve = (
        F.when(p == 0, 40.0)
        .when(p <= 30, F.round(p / 30.0 * 40.0 + 40.0))
        .otherwise(F.greatest(F.lit(20.0), 80.0 - F.round((p - 30) / 3.0)))
    )
    out = inputs.withColumns(
        {
            "flood_factor": F.when(F.col("in_sfha"), 0.0).otherwise(100.0),
            "demographics_factor": F.when(F.col("in_tract"), 75.0).otherwise(40.0),
            "transit_factor": F.least(F.lit(100.0), F.round(t / 5.0 * 100.0)),
            "environment_factor": F.greatest(F.lit(0.0), 100.0 - e * 20.0 - F.when(F.col("in_fire_hazard"), 40.0).otherwise(0.0)),
            "competition_factor": curve,
        }
    )
    total = reduce(lambda a, b: a + b, [F.col(f"{k}_factor") for k in ("flood", "demographics", "transit", "environment", "competition")])
    return out.withColumn("composite", F.bround(total / 5.0))


def site_suitability(hits: DataFrame, key: str, weights: dict[str, float], layers: list[str]) -> DataFrame:
    """Log-scaled densities over every layer; a layer with no hits counts as 0.

    ``hits``: key, layer, n for layers with hits.
    """
    weight = S.lookup("layer", {name: float(weights.get(name, 0.5)) for name in layers}, 0.5)
    total = sum(float(weights.get(name, 0.5)) for name in layers)
    return hits.groupBy(key).agg((F.sum(S.log_density("n", weight)) / (total or 1.0)).alias("overall_score"))
