"""Wildfire, flood and earthquake loss per location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import geo
from ..functions import scoring as S
from ..operators import spatial as X
from .portfolio import destruction_log_odds


# ── wildfire ────────────────────────────────────────────────────────────────
def wildfire_property_risk(properties: DataFrame, structures: DataFrame, key: str, radius_m: float = 500.0) -> DataFrame:
    """Structure-model risk from the nearest structure (by degrees) in the radius.

    Missing features count as zero; a negative value counts as zero.
    """
    feats = [
        "occtype", "val_struct", "burn_probability", "distance_to_fuel_m", "canopy_cover_100m", "slope_degrees",
        "cbfips", "expected_annual_loss",
    ]
    if "expected_annual_loss" not in structures.columns:
        structures = structures.withColumn("expected_annual_loss", F.lit(None).cast("double"))
    layer = structures.withColumnsRenamed({"lng": "f_lng", "lat": "f_lat"}).select("fd_id", "f_lng", "f_lat", *feats)
    near = X.nearest_within(properties, layer, key, radius_m, "fd_id", feats, geo.HAVERSINE, geo.DEGREE)
    filled = near.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("burn_probability", "distance_to_fuel_m", "canopy_cover_100m", "slope_degrees")}
    )
    matched = F.col("fd_id").isNotNull()
    value = F.greatest(F.lit(0.0), F.coalesce(F.col("val_struct"), F.lit(0.0)))
    scored = filled.withColumns(
        {
            "log_odds": F.when(matched, destruction_log_odds()),
            "value_usd": F.when(matched, value),
        }
    ).withColumn("damage_probability", S.logistic("log_odds"))
    rate = F.col("burn_probability") * F.col("damage_probability")
    scored = scored.withColumns(
        {
            "damage_frequency": rate,
            "annual_risk_usd": F.coalesce(F.col("expected_annual_loss"), rate * F.col("value_usd")),
        }
    )
    return scored.withColumns(
        {
            "exceeds_threshold": F.col("damage_probability") >= K.WILDFIRE_THRESHOLD,
            "return_period_years": F.when(
                F.col("damage_frequency") > 0, F.round(1.0 / F.nullif(F.col("damage_frequency"), F.lit(0.0)))
            ),
            "risk_tier": S.risk_tier("annual_risk_usd"),
        }
    )


def fire_frequency(near_fires: DataFrame, key: str, name: str = "fire_name", year: str = "fire_year") -> DataFrame:
    """Distinct (upper-case name, year) fires per location over the record length."""
    distinct = near_fires.select(key, F.upper(F.trim(F.col(name))).alias("_n"), F.col(year).alias("_y")).distinct()
    return distinct.groupBy(key).agg(
        F.count(F.lit(1)).alias("fire_count"), (F.count(F.lit(1)) / float(K.FIRE_RECORD_YEARS)).alias("fire_frequency")
    )


def wildfire_proxy(sites: DataFrame) -> DataFrame:
    """Fire frequency × damage factor × value where the structure model has no data.

    Needs fire_frequency, burnable, canopy_pct, replacement_value; a missing
    value leaves the dollars null.
    """
    burn = F.when(F.col("burnable"), 1.0).when(~F.col("burnable"), 0.25).otherwise(0.5)
    canopy = F.coalesce(F.col("canopy_pct") / 100.0, F.lit(0.0))
    damage = S.clamp01(burn * 0.40 + canopy * 0.30 + 0.30)
    value = F.when(F.col("replacement_value") != 0, F.col("replacement_value"))
    annual = F.coalesce(F.col("fire_frequency"), F.lit(0.0)) * damage * value
    return sites.withColumns({"damage_probability": damage, "annual_risk_usd": annual}).withColumn(
        "risk_tier", S.risk_tier("annual_risk_usd")
    )


# ── flood ───────────────────────────────────────────────────────────────────
def damage_at_depth(rows: DataFrame, curves: DataFrame, depth: str = "depth_ft", occupancy: str = "ddf_class") -> DataFrame:
    """Curve row nearest in depth per class; the shallower row on ties.

    Depth steps are one foot, so the nearest row is a rounding of the clamped
    depth and the lookup is an equi-join with a 174-row table.
    """
    lo, hi = float(K.DDF_DEPTHS_FT[0]), float(K.DDF_DEPTHS_FT[-1])
    step = F.ceil(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(depth))) - 0.5).cast("double")
    side = curves.select(
        F.col("occupancy_class").alias(occupancy), F.col("depth_ft").alias("_d"), "structural_damage_pct", "contents_damage_pct"
    )
    keyed = rows.withColumn("_d", F.when(F.col(depth).isNotNull(), step))
    return keyed.join(F.broadcast(side), [occupancy, "_d"], "left").drop("_d")


def flood_risk(rows: DataFrame, curves: DataFrame) -> DataFrame:
    """Flood loss per row.

    Needs flood_zone, zone_subtype, static_bfe, ground_elv_ft, occtype,
    num_story, found_type, found_ht, val_struct, val_cont.
    """
    bfe = F.when(F.col("static_bfe") > K.BFE_SENTINEL, F.col("static_bfe"))
    ffh = F.coalesce(F.col("found_ht"), F.lit(K.DEFAULT_FIRST_FLOOR_FT))
    inside = S.is_sfha("flood_zone")
    depth = F.when(inside, F.coalesce(bfe - F.col("ground_elv_ft") - ffh, F.lit(K.DEFAULT_SFHA_DEPTH_FT) - ffh))
    prepared = rows.withColumns(
        {
            "in_sfha": inside,
            "aep": S.flood_aep("flood_zone", "zone_subtype"),
            "depth_ft": depth,
            "ddf_class": F.when(F.col("occtype").isNull(), "RES1-1SNB").otherwise(
                S.ddf_class("occtype", "num_story", "found_type")
            ),
        }
    )
    hit = damage_at_depth(prepared, curves)
    zero = F.lit(0.0)
    structural = F.coalesce(F.col("val_struct"), zero) * F.coalesce(F.col("structural_damage_pct"), zero) / 100.0
    contents = F.coalesce(F.col("val_cont"), zero) * F.coalesce(F.col("contents_damage_pct"), zero) / 100.0
    out = hit.withColumns({"structural_loss": structural, "contents_loss": contents})
    total = F.col("structural_loss") + F.col("contents_loss")
    out = out.withColumns({"total_loss": total}).withColumn("annual_risk_usd", F.col("total_loss") * F.col("aep"))
    return out.withColumn("risk_tier", S.risk_tier("annual_risk_usd"))


# ── earthquake ──────────────────────────────────────────────────────────────
def fragility_table(spark) -> DataFrame:
    rows = [
        (b, level, *[float(m) for m in medians])
        for b, levels in K.FRAGILITY_MEDIANS.items()
        for level, medians in levels.items()
    ]
    cols = ", ".join(f"m_{s} double" for s in K.DAMAGE_STATES)
    return spark.createDataFrame(rows, f"building_type string, code_level string, {cols}")


def exceedance(pga: Column, median: Column) -> Column:
    p = S.normal_cdf((F.log(F.nullif(F.greatest(pga, F.lit(0.0)), F.lit(0.0))) - F.log(median)) / K.FRAGILITY_BETA)
    return F.when(pga > 0, p).otherwise(0.0)


def quake_risk(rows: DataFrame) -> DataFrame:
    """Design-event loss and its annual share per row.

    Needs bedrock_pga_g, slope_m_per_m, occtype, bldgtype, num_story,
    med_yr_blt, val_struct, val_cont.
    """
    vs30 = S.slope_vs30("slope_m_per_m")
    prepared = rows.withColumns(
        {
            "vs30": vs30,
            "building_type": F.when(F.col("occtype").isNull(), "W1").otherwise(
                S.quake_building("occtype", "bldgtype", "num_story")
            ),
            "code_level": S.quake_code_level("med_yr_blt"),
        }
    ).withColumns({"site_class": S.site_class("vs30"), "pga_g": F.col("bedrock_pga_g") * S.site_amplification("vs30")})
    # 28 fixed rows.
    joined = prepared.join(F.broadcast(fragility_table(rows.sparkSession)), ["building_type", "code_level"], "left")
    over = {f"p_{s}": exceedance(F.col("pga_g"), F.col(f"m_{s}")) for s in K.DAMAGE_STATES}
    out = joined.withColumns(over)
    ratio = F.lit(0.0)
    for here, after in zip(K.DAMAGE_STATES, [*K.DAMAGE_STATES[1:], None]):
        alone = F.col(f"p_{here}") - F.col(f"p_{after}") if after else F.col(f"p_{here}")
        ratio = ratio + F.greatest(F.lit(0.0), alone) * K.DAMAGE_RATIOS[here]
    out = out.withColumn("damage_ratio", ratio).drop(*[f"m_{s}" for s in K.DAMAGE_STATES])
    zero = F.lit(0.0)
    loss = (F.coalesce(F.col("val_struct"), zero) + F.coalesce(F.col("val_cont"), zero) * 0.5) * F.col("damage_ratio")
    out = out.withColumn("total_loss", loss).withColumn("annual_risk_usd", F.col("total_loss") / K.QUAKE_RETURN_YEARS)
    return out.withColumns({"risk_tier": S.risk_tier("annual_risk_usd"), "hazard_label": S.quake_label("bedrock_pga_g")})


# ── both perils ─────────────────────────────────────────────────────────────
def hazard_score(rows: DataFrame) -> DataFrame:
    """Two perils kept apart, plus the worse of their tiers.

    Needs wildfire_usd, flood_usd and src_wf_likelihood, src_fl_zone from data
    selection; a peril without a likelihood source cannot be assessed.
    """
    fire_known, flood_known = F.col("src_wf_likelihood").isNotNull(), F.col("src_fl_zone").isNotNull()
    out = rows.withColumns(
        {
            "wildfire_tier": F.when(fire_known, S.risk_tier("wildfire_usd")).otherwise(K.CANNOT_ASSESS),
            "flood_tier": F.when(flood_known, S.risk_tier("flood_usd")).otherwise(K.CANNOT_ASSESS),
            "wildfire_usd": F.when(fire_known, F.col("wildfire_usd")),
            "flood_usd": F.when(flood_known, F.col("flood_usd")),
        }
    )
    return out.withColumn("worst_tier", S.worst_tier("wildfire_tier", "flood_tier"))
