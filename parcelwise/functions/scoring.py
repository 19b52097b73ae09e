"""Scalar scoring functions: each takes and returns columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .geo import ColumnLike, col


def clamp01(x: ColumnLike) -> Column:
    """Clamp to [0, 1]; greatest/least skip nulls, so null is kept explicitly."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x))))


def linear(x: ColumnLike, lo: float, hi: float, inverted: bool = False) -> Column:
    """0–1 ramp over [lo, hi]; a missing value scores 0."""
    if hi == lo:
        return F.when(col(x).isNull(), 0.0).otherwise(0.5)
    t = (col(x) - lo) / (hi - lo)
    return F.coalesce(clamp01(1.0 - t if inverted else t), F.lit(0.0))


def lookup(key: ColumnLike, table: dict, default=None) -> Column:
    """Small fixed table as a map literal; a missing key gives ``default``."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    found = F.element_at(F.create_map(*pairs), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def case_ladder(rules: list[tuple[Column, object]], default) -> Column:
    """First matching rule wins."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def rating(score: ColumnLike, labels=("High", "Moderate", "Low"), cuts=(0.70, 0.40)) -> Column:
    s = col(score)
    return F.when(s >= cuts[0], labels[0]).when(s >= cuts[1], labels[1]).otherwise(labels[2])


def risk_tier(annual_usd: ColumnLike) -> Column:
    r = col(annual_usd)
    return F.when(r > K.RISK_HIGH_USD, "HIGH").when(r >= K.RISK_MODERATE_USD, "MODERATE").when(
        r.isNotNull(), "LOW"
    )


def portfolio_tier(annual_usd: ColumnLike) -> Column:
    return F.coalesce(F.lower(risk_tier(annual_usd)), F.lit("unscored"))


def confidence_tier(confidence: ColumnLike, bottom: str = "NONE") -> Column:
    c = col(confidence)
    return F.when(c >= 0.85, "HIGH").when(c >= 0.65, "MODERATE").when(c >= 0.40, "LOW").otherwise(bottom)


# ── terrain ─────────────────────────────────────────────────────────────────
def south_deviation(aspect: ColumnLike) -> Column:
    d = F.abs(col(aspect) - 180.0)
    return F.least(d, 360.0 - d)


def aspect_score(aspect: ColumnLike, slope_pct: ColumnLike | None = None) -> Column:
    """Cosine of the deviation from south; flat ground gets full credit."""
    cosine = F.greatest(F.lit(0.0), F.cos(F.radians(south_deviation(aspect))))
    flat = col(aspect).isNull()
    if slope_pct is not None:
        flat = flat | (F.coalesce(col(slope_pct), F.lit(0.0)) < 1.0)
    return F.when(flat, 1.0).otherwise(cosine)


def stencil_slope_aspect(
    east: ColumnLike, west: ColumnLike, north: ColumnLike, south: ColumnLike, span_x: ColumnLike, span_y: ColumnLike
) -> tuple[Column, Column]:
    """Gradient (m/m) and downslope aspect (degrees, null when flat)."""
    dz_dx = (col(east) - col(west)) / col(span_x)
    dz_dy = (col(north) - col(south)) / col(span_y)
    slope = F.hypot(dz_dx, dz_dy)
    aspect = F.pmod(F.degrees(F.atan2(-dz_dx, -dz_dy)) + 360.0, F.lit(360.0))
    return slope, F.when(slope >= 1e-4, aspect)


def slope_degrees(grade: ColumnLike) -> Column:
    return F.degrees(F.atan(col(grade)))


# ── text parsing ────────────────────────────────────────────────────────────
def voltage_kv(raw: ColumnLike) -> Column:
    """Largest number in a free-text voltage; values over 1000 are volts."""
    numbers = F.regexp_extract_all(col(raw), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    v = F.array_max(F.transform(numbers, lambda s: s.cast("double")))
    return F.when(v > 1000, F.bround(v / 1000.0)).otherwise(F.bround(v))


def soil_class(raw: ColumnLike) -> Column:
    n = F.try_to_number(F.nullif(F.regexp_extract(col(raw), r"^(\d+)", 1), F.lit("")), F.lit("9999")).cast("int")
    return F.when(n.between(1, 8), n)


def land_use_category(zone_code: ColumnLike) -> Column:
    z = F.upper(F.trim(col(zone_code)))
    rural = (
        z.startswith("E(") | z.isin("NR", "RF") | z.startswith("FP") | z.startswith("DI") | z.startswith("WM")
    )
    return (
        F.when(z.isNull(), "unknown")
        .when(z.startswith("A"), "agricultural")
        .when(rural, "rural")
        .when(z.startswith("R"), "residential")
        .when(z.startswith("C"), "commercial")
        .when(z.startswith("M"), "industrial")
        .otherwise("other")
    )


def coordinate_pair(text: ColumnLike) -> tuple[Column, Column]:
    """``"35.35, -119.05"`` → (lat, lng), null when unparsable or out of range."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"
    lat = F.nullif(F.regexp_extract(col(text), pattern, 1), F.lit("")).cast("double")
    lng = F.nullif(F.regexp_extract(col(text), pattern, 2), F.lit("")).cast("double")
    valid = lat.between(-90, 90) & lng.between(-180, 180)
    return F.when(valid, lat), F.when(valid, lng)


def dms_degrees(packed: ColumnLike) -> Column:
    """Integer ``DDMMSS`` → decimal degrees; 0 and null are missing."""
    v = col(packed).cast("long")
    a = F.abs(v)
    magnitude = (
        F.floor(a / 10000).cast("double")
        + (F.floor(a / 100) % 100).cast("double") / 60.0
        + (a % 100).cast("double") / 3600.0
    )
    return F.when(v != 0, F.signum(v.cast("double")) * magnitude)


def fips5(raw: ColumnLike) -> Column:
    """County code as five digits; accepts ints, floats and padded text."""
    n = F.trim(col(raw).cast("string")).try_cast("double")
    return F.when(n.isNotNull(), F.lpad(n.cast("long").cast("string"), 5, "0"))


# ── land cover and soil ─────────────────────────────────────────────────────
def nlcd_label(code: ColumnLike) -> Column:
    return lookup(col(code).cast("int"), K.NLCD_LABELS)


def nlcd_group(code: ColumnLike) -> Column:
    table = {c: g for g, codes in K.NLCD_GROUPS.items() for c in codes}
    return lookup(col(code).cast("int"), table)


def nlcd_score(code: ColumnLike) -> Column:
    return lookup(col(code).cast("int"), K.NLCD_SCORES, 0.5)


def drainage_score(drainage: ColumnLike, hydric: ColumnLike) -> Column:
    d = F.lower(F.coalesce(col(drainage), F.lit("")))
    h = F.lower(F.coalesce(col(hydric), F.lit("")))
    return (
        F.when(h == "yes", 0.2)
        .when(d.contains("well drained") & ~d.contains("moderately"), 1.0)
        .when(d.contains("moderately well drained"), 0.8)
        .when(d.contains("somewhat poorly drained"), 0.5)
        .when(d.contains("poorly drained"), 0.3)
        .otherwise(0.6)
    )


# ── flood ───────────────────────────────────────────────────────────────────
def is_sfha(zone: ColumnLike) -> Column:
    z = F.upper(F.coalesce(col(zone), F.lit("")))
    return z.startswith("A") | z.startswith("V")


def flood_aep(zone: ColumnLike, subtype: ColumnLike) -> Column:
    z = F.upper(F.coalesce(col(zone), F.lit("")))
    sub = F.upper(F.coalesce(col(subtype), F.lit("")))
    shaded = (z == "X") & (sub.contains("0.2") | sub.contains("SHADED"))
    return (
        F.when(is_sfha(zone), K.FLOOD_AEP["sfha"])
        .when(shaded, K.FLOOD_AEP["shaded_x"])
        .otherwise(K.FLOOD_AEP["minimal"])
    )


def flood_site_score(zone: ColumnLike) -> Column:
    """Solar flood score: V 0, A 0.35, unknown 0.5, outside 1."""
    z = F.upper(col(zone))
    return (
        F.when(z.isNull(), 0.5).when(z.startswith("V"), 0.0).when(z.startswith("A"), 0.35).otherwise(1.0)
    )


def ddf_class(occtype: ColumnLike, stories: ColumnLike, foundation: ColumnLike) -> Column:
    occ = F.upper(F.coalesce(col(occtype), F.lit("")))
    two = F.coalesce(col(stories).cast("string").try_cast("double"), F.lit(1.0)).cast("int") >= 2
    base = F.upper(F.coalesce(col(foundation), F.lit(""))) == "B"
    res1 = F.concat(
        F.lit("RES1-"), F.when(two, "2").otherwise("1"), F.lit("S"), F.when(base, "W").otherwise("N"), F.lit("B")
    )
    return F.when(occ.startswith("RES1"), res1).when(occ.startswith("RES2"), "RES2").otherwise("COM1")


# ── earthquake ──────────────────────────────────────────────────────────────
def quake_building(occtype: ColumnLike, material: ColumnLike, stories: ColumnLike) -> Column:
    occ = F.upper(F.coalesce(col(occtype), F.lit("")))
    mat = F.upper(F.coalesce(col(material), F.lit("")))
    floors = F.coalesce(col(stories).cast("string").try_cast("double"), F.lit(1.0)).cast("int")
    home = occ.startswith("RES")
    return (
        F.when(occ.startswith("RES2") | (mat == "MH"), "MH")
        .when(mat.startswith("M") & home, "URML")
        .when(mat.startswith("M"), "RM1L")
        .when(mat.startswith("S"), "S1L")
        .when(mat.startswith("C"), "C1L")
        .when(home, "W1")
        .when(mat.startswith("W") | (floors <= 2), "W2")
        .otherwise("S1L")
    )


def quake_code_level(year_built: ColumnLike) -> Column:
    y = col(year_built).cast("string").try_cast("double").cast("int")
    return (
        F.when(y.isNull(), "low")
        .when(y >= 1997, "high")
        .when(y >= 1974, "moderate")
        .when(y >= 1941, "low")
        .otherwise("pre_code")
    )


def slope_vs30(slope: ColumnLike) -> Column:
    s = F.abs(col(slope))
    ladder = [(s <= top, vs) for top, vs in K.SLOPE_VS30 if top is not None]
    return F.when(s.isNull(), K.DEFAULT_VS30).otherwise(case_ladder(ladder, K.SLOPE_VS30[-1][1]))


def site_class(vs30: ColumnLike) -> Column:
    v = col(vs30)
    return case_ladder([(v >= lo, name) for name, lo, _, _ in K.SITE_CLASSES[:-1]], K.SITE_CLASSES[-1][0])


def site_amplification(vs30: ColumnLike) -> Column:
    v = col(vs30)
    return case_ladder([(v >= lo, amp) for _, lo, amp, _ in K.SITE_CLASSES[:-1]], K.SITE_CLASSES[-1][2])


def quake_label(pga: ColumnLike) -> Column:
    p = col(pga)
    return F.when(p >= 0.40, "high").when(p >= 0.15, "moderate").otherwise("low")


def normal_cdf(x: ColumnLike) -> Column:
    """Φ by the rational erf approximation 7.1.26 (absolute error ≤ 1.5e-7)."""
    # fixed values: approximation coefficients
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    z = F.abs(col(x)) / math.sqrt(2.0)
    t = F.lit(1.0) / (z * p + 1.0)
    poly = ((((t * a5 + a4) * t + a3) * t + a2) * t + a1) * t
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return (F.when(col(x) < 0, -erf).otherwise(erf) + 1.0) * 0.5


def logistic(z: ColumnLike) -> Column:
    return F.lit(1.0) / (F.exp(-col(z)) + 1.0)


# ── solar sizing and cost ───────────────────────────────────────────────────
def suggested_tilt(lat: ColumnLike, array_type: ColumnLike) -> Column:
    """Tilt of a fixed array, rounded as a decimal; trackers lie flat."""
    fixed = F.greatest(F.lit(5.0), F.least(F.lit(35.0), F.abs(col(lat)) - 5.0))
    rounded = F.round(fixed.cast("decimal(18,6)"), 1).cast("double")
    return F.when(col(array_type).isin(2, 3, 4), 0.0).otherwise(rounded)


def capacity_kw(acres: ColumnLike, array_type: ColumnLike) -> Column:
    density = lookup(col(array_type).cast("int"), K.ACRES_PER_MW, 5.0)
    sized = F.round(col(acres) / density * 1000.0, 1)
    return F.when(col(acres) > 0, sized).otherwise(0.0)


def capacity_factor_class(cf_pct: ColumnLike) -> Column:
    c = col(cf_pct)
    return (
        F.when(c >= 23, "excellent").when(c >= 20, "strong").when(c >= 17, "moderate").when(c >= 14, "weak")
        .otherwise("very weak")
    )


def gen_tie_usd_per_km(kv: ColumnLike) -> Column:
    v = col(kv)
    ladder = [(v < top, cost) for top, cost, _ in K.GEN_TIE_COSTS if top is not None]
    known = case_ladder(ladder, K.GEN_TIE_COSTS[-1][1])
    return F.when(v.isNull() | (v <= 0), K.UNKNOWN_VOLTAGE_COST).otherwise(known)


def congestion_class(mw: ColumnLike) -> Column:
    return F.when(col(mw) < 50, "low").when(col(mw) < 200, "moderate").otherwise("high")


# ── combined ────────────────────────────────────────────────────────────────
def worst_tier(a: ColumnLike, b: ColumnLike) -> Column:
    """Worse of two peril tiers; CANNOT ASSESS only when neither is assessable."""
    rank = {"LOW": 1, "MODERATE": 2, "HIGH": 3}
    worst = F.greatest(lookup(a, rank, 0), lookup(b, rank, 0))
    return F.when(worst == 3, "HIGH").when(worst == 2, "MODERATE").when(worst == 1, "LOW").otherwise(K.CANNOT_ASSESS)


def log_density(count: ColumnLike, weight: ColumnLike = 1.0) -> Column:
    n = col(count)
    return F.when(n > 0, F.least(F.log10(n + 1.0) / 3.0, F.lit(1.0))).otherwise(0.0) * col(weight)


# fixed values: structure labels
_OCCUPANCY_WORDS = {
    "RES": "residential", "COM": "commercial", "IND": "industrial", "AGR": "agricultural",
    "REL": "religious", "GOV": "government", "EDU": "educational", "PUB": "public",
}
_MATERIAL_WORDS = {
    "W": "wood frame", "M": "masonry", "C": "concrete", "S": "steel", "H": "manufactured", "MH": "manufactured",
}


def building_label(occtype: ColumnLike, material: ColumnLike) -> Column:
    occ = lookup(F.substring(F.upper(F.coalesce(col(occtype), F.lit(""))), 1, 3), _OCCUPANCY_WORDS)
    mat = lookup(F.upper(F.coalesce(col(material), F.lit(""))), _MATERIAL_WORDS)
    return F.nullif(F.concat_ws(" ", occ, mat), F.lit(""))
