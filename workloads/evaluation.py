"""Model, calibration, sampling and back-test queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import scoring as S
from parcelwise.operators import aggregates as A
from parcelwise.operators import relational as R
from parcelwise.plans import backtest as B
from parcelwise.plans import calibrate as C
from parcelwise.plans import hazard as H
from parcelwise.plans import model as M
from parcelwise.session import cut_lineage
from parcelwise.sources import catalog

from .hazard import FLOOD_IN, NEAREST_CURVE, curves_sql, flood_inputs
from .layers import CROSSES, ZONE_EDGES, box_polygons, hav, inside, layer, table, with_ctes
from .solar import PARCELS, SOLAR_CTES, enriched_parcels, solar_scored
from .spatial import TILE_CELL, zone_cell, zones


def predictions(spark, sf_dir):
    """Scores with ties and a label that follows them."""
    s = layer(spark, sf_dir, "structures")
    k = F.col("fd_id")
    return s.select(
        "fd_id", "segment", "tract", ((k * 31 % 997) / 997.0).alias("score"),
        ((k * 17 + 5) % 499 < k * 31 % 997 * 0.5).cast("int").alias("label"),
    )


def auc_gini(spark, sf_dir):
    """M4: exact AUC and Gini with ties."""
    out = A.auc_gini(predictions(spark, sf_dir), "score", "label")
    return out.select("n_pos", "n_neg", F.round("auc", 8).alias("auc"), F.round("gini", 8).alias("gini"))


def youden(spark, sf_dir):
    """M5: best threshold and its confusion counts."""
    out = A.youden(predictions(spark, sf_dir), "score", "label")
    return out.select(F.round("threshold", 8).alias("threshold"), F.round("youden_j", 8).alias("youden_j"), "tp", "fp", "fn", "tn")


def decile_calibration(spark, sf_dir):
    """Predicted against observed by quantile bin."""
    out = M.calibration_deciles(predictions(spark, sf_dir), "score", "label")
    return out.select("decile", "n", *[F.round(c, 6).alias(c) for c in ("pred_mean", "obs_mean", "pred_min", "pred_max")])


def cohort_table(spark, sf_dir):
    """M7."""
    out = M.cohort_table(predictions(spark, sf_dir), "segment", "label")
    return out.select("segment", "n", "n_destroyed", F.round("destroyed_rate", 6).alias("destroyed_rate"))


def inspections(spark, sf_dir):
    k = F.col("fd_id")
    return layer(spark, sf_dir, "structures").select(
        k.alias("oid"),
        (F.col("lng") + (k % 3 - 1) / 1000.0).alias("lng"),
        F.col("lat"),
        F.when(k % 4 == 0, M.DESTROYED).when(k % 4 == 3, "Affected (1-9%)").otherwise(M.UNDAMAGED).alias("damage"),
    )


def _training(spark, sf_dir):
    per = zones(spark, sf_dir, "zone_name", "year_num", "gis_acres").withColumnsRenamed({"zone_name": "event", "year_num": "fire_year"})
    return M.training_frame(inspections(spark, sf_dir), per, layer(spark, sf_dir, "structures"), zone_cell(spark, sf_dir), min_year=1990)


def training_frame(spark, sf_dir):
    """Labelled inspections with structure features."""
    return _training(spark, sf_dir).select("oid", "event", "fd_id", "destroyed", F.round("dist", 2).alias("dist_m"))


def model_coefficients(spark, sf_dir):
    """M2, M3: logit fit on the structures, with errors, p-values and importance."""
    s = layer(spark, sf_dir, "structures").dropna(subset=["canopy_cover_100m"])
    k = F.col("fd_id")
    frame = s.withColumns(
        {
            "is_res1": F.col("occtype").startswith("RES1").cast("double"),
            "destroyed": ((k * 17 + 5) % 100 < 30 + F.col("slope_degrees")).cast("int"),
        }
    )
    fit = M.fit_logit(frame)
    return M.coefficient_table(fit, frame).select(
        "feature", F.round("coef", 6).alias("coef"), F.round("std_error", 6).alias("std_error"), F.round("z", 4).alias("z"), F.round("standardized", 6).alias("standardized")
    )


def spearman(spark, sf_dir):
    """Rank correlation of value against hazard."""
    out = A.spearman(layer(spark, sf_dir, "structures"), "val_struct", "distance_to_fuel_m")
    return out.select("n", F.round("spearman", 9).alias("spearman"))


def decile_ratio(spark, sf_dir):
    """Means in the outer deciles of a ranking."""
    s = layer(spark, sf_dir, "structures").select("fd_id", "slope_degrees", "val_struct")
    out = A.edge_decile_means(s, "slope_degrees", "val_struct", "fd_id")
    return out.select(F.round("bottom_mean", 4).alias("bottom_mean"), F.round("top_mean", 4).alias("top_mean"))


def stratified_split(spark, sf_dir):
    """Exact 20 % per stratum in hash order."""
    out = R.stratified_split(predictions(spark, sf_dir), "segment", "fd_id", 0.2, 42)
    return out.select("fd_id", "is_val")


def group_sample(spark, sf_dir):
    """A hundred repeatable rows per region."""
    out = R.sample_per_group(layer(spark, sf_dir, "sites").select("loc_id", "segment"), ["segment"], "loc_id", 100, 42)
    return out.select("segment", "loc_id")


def prefer_then_fill(spark, sf_dir):
    """Preferred classes first until thirty per group."""
    s = layer(spark, sf_dir, "sites").select(
        "loc_id", "segment", F.when(F.col("nlcd_code") >= 70, 0).when(F.col("nlcd_code") == 11, 2).otherwise(1).alias("pref")
    )
    return R.prefer_then_fill(s, ["segment"], "pref", "loc_id", 150, 7).select("segment", "loc_id", "pref")


def long_scores(spark, sf_dir):
    """Every sub-score of the solar composite per site; a site without a measure has none. A third of the sites stand for random points."""
    scored = solar_scored(spark, sf_dir).withColumn("s_solar_ej", F.when(F.col("ej_percentile").isNotNull(), F.col("s_solar_ej")))
    long = scored.unpivot(["loc_id", "segment"], [f"s_{c}" for c in C.CRITERIA], "criterion_id", "score")
    kind = F.when(F.col("loc_id") % 3 == 0, "random").otherwise("site")
    return long.select(F.col("segment").alias("region"), kind.alias("kind"), "loc_id", F.substring("criterion_id", 3, 99).alias("criterion_id"), "score")


def masked_composite(spark, sf_dir):
    """Pivoted score matrix and mask-weighted composite."""
    m = C.score_matrix(long_scores(spark, sf_dir), ["region", "kind", "loc_id"])
    m = m.withColumn("w", F.array(*[F.lit(float(w)) for w in C.START]))
    return m.select("loc_id", F.round(C.masked_composite("scores", "mask", "w"), 7).alias("composite"))


def criterion_separation(spark, sf_dir):
    """Mean score of sites minus random points per region and criterion."""
    out = C.criterion_separation(long_scores(spark, sf_dir))
    return out.select("region", "criterion_id", F.round("separation", 6).alias("separation"))


def calibrated_weights(spark, sf_dir):
    """Bounded weights per region that widen the site-random gap."""
    m = C.score_matrix(long_scores(spark, sf_dir), ["region", "kind", "loc_id"])
    profiles = C.profile_table(spark, C.calibrate_weights(m))
    checks = C.profile_checks(profiles)
    return profiles.join(checks, ["region", "method"]).select(
        "region", "method", F.round("total", 6).alias("total"), "out_of_bounds", F.round("start_value", 6).alias("start_value"), (F.col("value") >= F.col("start_value")).alias("not_worse"),
    )


def random_points(spark, sf_dir):
    """Repeatable points inside each region's tiles."""
    tiles = box_polygons(layer(spark, sf_dir, "tiles")).select("region_id", "rings", "x0", "y0", "x1", "y1")
    out = C.random_points(tiles, "region_id", 40, 42, 12, TILE_CELL)
    return out.select("region_id", "point_no", F.round("lng", 9).alias("lng"), F.round("lat", 9).alias("lat"))


def state_rows(spark, sf_dir):
    p = enriched_parcels(spark, sf_dir)
    k = F.col("loc_id")
    return p.select(
        "segment", F.when(k % 2 == 0, "site").otherwise("random").alias("kind"), F.col("suitability_score").alias("score"),
        F.when(F.col("passed_all"), F.col("suitability_rating")).otherwise("Excluded").alias("rating"),
        F.when(k % 3 == 0, "HIGH").otherwise("MODERATE").alias("tier"),
        (k % 5 != 0).alias("from_cache"), F.lit(None).cast("string").alias("error"),
    )


def state_backtest(spark, sf_dir):
    """Ratings and separation per state with the national row."""
    out = B.state_summary(state_rows(spark, sf_dir), "segment", "kind")
    return out.select("segment", "n_sites", "n_random", "excluded_high", "tier_high", *[F.round(c, 5).alias(c) for c in ("pct_high_sites", "pct_high_random", "mean_sites", "separation")])


def coverage_report(spark, sf_dir):
    """B2: distinct composites, cache share, silent failures."""
    out = B.coverage_summary(state_rows(spark, sf_dir), "segment")
    return out.select("segment", "n", "distinct_scores", F.round("cache_pct", 5).alias("cache_pct"), "silent_failures")


def claims_by_tract(spark, sf_dir):
    """Claims, paid and yearly loss per tract."""
    out = B.claims_by_tract(layer(spark, sf_dir, "claims"))
    return out.select("tract_id", "n", F.round("paid", 4).alias("paid"), "first_loss", "last_loss", F.round("paid_per_claim", 10).alias("paid_per_claim"), F.round("paid_per_year", 4).alias("paid_per_year"))


def recent_claims(spark, sf_dir):
    """Ten latest claims per tract."""
    return B.recent_claims(layer(spark, sf_dir, "claims"), "tract_id").select("tract_id", "rank", "claim_id")


def _tract_risk(spark, sf_dir):
    risk = H.flood_risk(flood_inputs(spark, sf_dir), catalog.damage_curves(spark))
    return risk.select((F.col("fd_id") % 150).alias("tract_id"), "annual_risk_usd", "in_sfha", "flood_zone")


def flood_backtest(spark, sf_dir):
    """Predicted mean risk against paid per claim by tract."""
    out = B.tract_backtest(_tract_risk(spark, sf_dir), B.claims_by_tract(layer(spark, sf_dir, "claims")), "tract_id")
    return out.select("tract_id", "n_structures", "n_claims", F.round("predicted", 4).alias("predicted"), F.round("actual", 10).alias("actual"), F.round("pct_in_sfha", 4).alias("pct_in_sfha"))


def flood_backtest_metrics(spark, sf_dir):
    """Rank correlation and decile discrimination of the back-test."""
    t = B.tract_backtest(_tract_risk(spark, sf_dir), B.claims_by_tract(layer(spark, sf_dir, "claims")), "tract_id")
    t = t.select("tract_id", F.round("predicted", 6).alias("predicted"), F.round("actual", 10).alias("actual"))
    out = B.backtest_metrics(t, "tract_id")
    return out.select("n", *[F.round(c, 5).alias(c) for c in ("spearman", "discrimination", "dynamic_range")])


def claimed_vs_unclaimed(spark, sf_dir):
    """B4, W15."""
    claims = layer(spark, sf_dir, "claims").filter(F.col("zone_class") == "purchase").filter(F.col("paid") > 150)
    out = B.claimed_vs_unclaimed(_tract_risk(spark, sf_dir), claims, "tract_id")
    return out.select("n_claimed", "n_unclaimed", *[F.round(c, 4).alias(c) for c in ("claimed_mean", "unclaimed_mean", "sfha_hit_pct", "ratio")])


def claim_rank_correlation(spark, sf_dir):
    """Spearman of mean risk against the number of claims, over all tracts; a tract without claims has 0."""
    risk = _tract_risk(spark, sf_dir).groupBy("tract_id").agg(F.round(F.avg("annual_risk_usd"), 6).alias("risk"))
    n = layer(spark, sf_dir, "claims").groupBy("tract_id").agg(F.count(F.lit(1)).alias("n_claims"))
    both = risk.join(n, "tract_id", "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)).cast("double"))
    return A.spearman(cut_lineage(both.select("risk", "n_claims")), "risk", "n_claims").select("n", F.round("spearman", 8).alias("spearman"))


def zone_spread(spark, sf_dir):
    """Spread of risk within each flood zone."""
    out = B.zone_spread(_tract_risk(spark, sf_dir).filter(F.col("in_sfha")), "flood_zone", "annual_risk_usd")
    return out.select("flood_zone", "n", *[F.round(c, 4).alias(c) for c in ("lowest", "median", "highest")])


def zone_share(spark, sf_dir):
    """Groups with most of their rows in a class, HAVING and top ten."""
    s = layer(spark, sf_dir, "structures")
    return B.share_by_group(s, "tract", F.col("slope_degrees") > 22, 5, 10).select("tract", "n", F.round("pct", 5).alias("pct"))


def chain_vs_random(spark, sf_dir):
    """B6."""
    k = F.col("loc_id")
    rows = layer(spark, sf_dir, "stores").select((F.col("segment") == "BUILDING").alias("chain"), ((k * 37 % 1001) / 1000.0).alias("score"))
    out = B.chain_vs_random(rows.withColumn("rating", S.rating("score", ("Strong", "Moderate", "Weak"))), "chain", "score", "rating")
    return out.select("chain", "n", *[F.round(c, 6).alias(c) for c in ("pct_strong", "mean_score", "median_score")])


def harness_summary(spark, sf_dir):
    """Error metrics of predicted against expected scores."""
    k = F.col("o_orderkey")
    cases = table(spark, sf_dir, "orders").select(
        ((k * 7) % 101).cast("double").alias("predicted"), ((k * 11) % 97).cast("double").alias("expected"),
        ((k * 11) % 97 - 10).cast("double").alias("expected_lo"), ((k * 11) % 97 + 10).cast("double").alias("expected_hi"),
        (F.col("o_totalprice") / 100.0).alias("latency_ms"),
    )
    out = B.calibration_summary(cases)
    counts = ("n", "in_range", "err_0_5", "err_5_10", "err_10_20", "err_20_30", "err_30")
    return out.select(*counts, *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias", "max_abs_error", "latency_min", "latency_max", "latency_p50")])


def bootstrap_ci(spark, sf_dir):
    """Bootstrap interval of the mean claim."""
    c = layer(spark, sf_dir, "claims").select("claim_id", "paid")
    out = B.bootstrap_mean_ci(c, "paid", "claim_id")
    return out.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def top_precision(spark, sf_dir):
    """Precision, net-new and coverage of the best fifteen."""
    p = enriched_parcels(spark, sf_dir)
    k = F.col("loc_id")
    rows = p.select("loc_id", "suitability_score", F.when(k % 4 == 0, "known").when(k % 4 == 1, "pursue").otherwise("reject").alias("outcome"))
    out = B.top_precision(rows, "suitability_score", "loc_id")
    return out.select("k", "net_new", "known_found", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"))


QUERIES = {f.__name__: f for f in (
    auc_gini, youden, decile_calibration, cohort_table, training_frame, model_coefficients, spearman, decile_ratio, stratified_split,
    group_sample, prefer_then_fill, masked_composite, criterion_separation, calibrated_weights, random_points, state_backtest,
    coverage_report, claims_by_tract, recent_claims, flood_backtest, flood_backtest_metrics, claimed_vs_unclaimed, claim_rank_correlation, zone_spread,
    zone_share, chain_vs_random, harness_summary, bootstrap_ci, top_precision,
)}

PRED = """pred AS (SELECT fd_id, segment, (fd_id * 31 % 997) / 997e0 AS score, CASE WHEN (fd_id * 17 + 5) % 499 < fd_id * 31 % 997 * 5e-1 THEN 1 ELSE 0 END AS label FROM structures)"""
LEVELS = """lv AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY score),
cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM lv)"""
HASH = "(({key} % 1000003 + {seed}) * 48271) % 1000003"
_SCORES = {"solar_aspect": "s_aspect", "solar_ej": "s_ej", "solar_ghi": "s_ghi", "solar_land_cover": "s_cover", "solar_road": "0.5e0", "solar_slope": "s_slope", "solar_soil": "s_soil", "solar_transmission": "s_tx"}
LONG = "longs AS (" + " UNION ALL ".join(
    f"SELECT segment AS region, CASE WHEN loc_id % 3 = 0 THEN 'random' ELSE 'site' END AS kind, loc_id, '{c}' AS criterion_id, {float(w)!r} AS w, {_SCORES[c]} AS score FROM rounded"
    for c, w in zip(C.CRITERIA, C.START)) + ")"
RISK = (
    "structures", "zones", ZONE_EDGES, inside("structures", "fd_id"), FLOOD_IN, curves_sql(),
    f"hit AS (SELECT w.*, v.s, v.c {NEAREST_CURVE.format('wet')})",
    """risk AS (SELECT fd_id % 150 AS tract_id, sfha, flood_zone, (val_struct * coalesce(s, 0e0) / 100e0 + val_cont * coalesce(c, 0e0) / 100e0) * aep AS usd FROM hit)""",
    "claims",
)
TRACTS = """actual AS (SELECT tract_id, count(*) AS n, sum(paid + paid_contents) / count(*) AS per FROM claims GROUP BY tract_id),
t AS (SELECT tract_id, avg(usd) AS predicted, any_value(per) AS actual, count(*) AS n_structures, any_value(n) AS n_claims,
  count(*) FILTER (WHERE usd > 0) * 100e0 / count(*) AS pct FROM risk JOIN actual USING (tract_id) GROUP BY tract_id)"""
AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2e0"
STATE = """st AS (SELECT segment, CASE WHEN loc_id % 2 = 0 THEN 'site' ELSE 'random' END AS kind, score, CASE WHEN passed_all THEN rating ELSE 'Excluded' END AS rating, loc_id FROM rated)"""



def newton_sql(rows: str, names: list[str], label: str, steps: int = 9) -> str:
    """Brute-force CTEs: maximum-likelihood logit by Newton steps, each a Gaussian elimination written out.

    ``rows`` has the predictors and the label. The last CTE, ``fit``, has b0, b1, ... (the constant last) and v0, v1, ..., the diagonal of the inverse information.
    """
    n = len(names) + 1
    x = [*names, "1e0"]
    parts = ["beta0 AS (SELECT " + ", ".join(f"0e0 AS b{i}" for i in range(n)) + ")"]
    width = 2 * n + 1  # information, score, identity
    for step in range(steps):
        eta = " + ".join(f"b{i} * {x[i]}" for i in range(n))
        info = ", ".join(f"sum(p * (1 - p) * {x[i]} * {x[j]}) AS a{i}_{j}" for i in range(n) for j in range(n))
        score = ", ".join(f"sum(({label} - p) * {x[i]}) AS a{i}_{n}" for i in range(n))
        unit = ", ".join(f"{1 if i == j - n - 1 else 0}e0 AS a{i}_{j}" for i in range(n) for j in range(n + 1, width))
        parts.append(f"m{step}_0 AS (SELECT {info}, {score}, {unit} FROM (SELECT *, 1e0 / (1e0 + exp(-({eta}))) AS p FROM {rows} CROSS JOIN beta{step}))")
        for k in range(n):
            cells = ", ".join(f"a{k}_{j} / a{k}_{k} AS a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(n) for j in range(width))
            parts.append(f"m{step}_{k + 1} AS (SELECT {cells} FROM m{step}_{k})")
        moved = ", ".join(f"b{i} + a{i}_{n} AS b{i}" for i in range(n))
        spread = ", ".join(f"a{i}_{n + 1 + i} AS v{i}" for i in range(n))
        parts.append(f"beta{step + 1} AS MATERIALIZED (SELECT {moved}, {spread} FROM m{step}_{n} CROSS JOIN beta{step})")
    return ",\n".join([*parts, f"fit AS (SELECT * FROM beta{steps})"])


TRAINED = """trained AS (SELECT *, CASE WHEN occtype LIKE 'RES1%' THEN 1e0 ELSE 0e0 END AS is_res1, CASE WHEN (fd_id * 17 + 5) % 100 < 30 + slope_degrees THEN 1 ELSE 0 END AS destroyed
  FROM structures WHERE canopy_cover_100m IS NOT NULL)"""

_N = len(C.CRITERIA)
_WIDE = "wide AS (SELECT region, kind, loc_id, " + ", ".join(f"max(score) FILTER (WHERE criterion_id = {c!r}) AS s{i}" for i, c in enumerate(C.CRITERIA)) + " FROM longs GROUP BY ALL)"
ORACLES = {
    "calibrated_weights": with_ctes(*SOLAR_CTES, LONG, _WIDE, body=f"""
, composites AS (SELECT region, kind, coalesce(({' + '.join(f'coalesce({float(w)!r} * s{i}, 0e0)' for i, w in enumerate(C.START))}) / nullif({' + '.join(f'CASE WHEN s{i} IS NOT NULL THEN {float(w)!r} ELSE 0e0 END' for i, w in enumerate(C.START))}, 0e0), 0e0) AS c FROM wide),
means AS (SELECT region, kind, count(*) AS n, avg(c) + avg(1e0 / (1e0 + exp(-(c - {C.HIGH}) / {C.SOFTNESS}))) AS v FROM composites GROUP BY ALL),
fitted AS (SELECT s.region, s.n >= {C.MIN_POSITIVES} AS fits, s.v - r.v AS gap FROM means s JOIN means r ON s.kind = 'site' AND r.kind = 'random' AND s.region = r.region)
SELECT region, CASE WHEN fits THEN 'constrained_optimization' ELSE 'literature_default' END AS method, 1e0 AS total, 0 AS out_of_bounds,
  CASE WHEN fits THEN round(gap, 6) END AS start_value, CASE WHEN fits THEN TRUE END AS not_worse FROM fitted"""),
    "model_coefficients": with_ctes("structures", TRAINED, newton_sql("trained", M.PREDICTORS, "destroyed"), body=" UNION ALL ".join(
        f"SELECT '{name}' AS feature, round(b{i}, 6) AS coef, round(sqrt(v{i}), 6) AS std_error, round(b{i} / sqrt(v{i}), 4) AS z, "
        + (f"round(b{i} * (SELECT stddev_samp({name}) FROM trained), 6)" if name != "const" else "NULL::DOUBLE") + " AS standardized FROM fit" for i, name in enumerate([*M.PREDICTORS, "const"]))),
    "auc_gini": with_ctes("structures", PRED, body="""
, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS rk FROM pred),
a AS (SELECT sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n, sum(rk) FILTER (WHERE label = 1) AS s FROM r)
SELECT p AS n_pos, n AS n_neg, round((s - p * (p + 1) / 2e0) / (p * n), 8) AS auc, round(2 * (s - p * (p + 1) / 2e0) / (p * n) - 1, 8) AS gini FROM a"""),
    "youden": with_ctes("structures", PRED, LEVELS, body="""
SELECT round(score, 8) AS threshold, round(tp / p - fp / n, 8) AS youden_j, tp::BIGINT AS tp, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn, (n - fp)::BIGINT AS tn
FROM cu ORDER BY round(tp / p - fp / n, 12) DESC, score DESC LIMIT 1"""),
    "decile_calibration": with_ctes("structures", PRED, body="""
, e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM pred),
b AS (SELECT p.*, len(list_filter(q[2:len(q) - 1], lambda x: x <= score)) + 1 AS decile FROM pred p CROSS JOIN e)
SELECT decile, count(*) AS n, round(avg(score), 6) AS pred_mean, round(avg(label), 6) AS obs_mean, round(min(score), 6) AS pred_min, round(max(score), 6) AS pred_max FROM b GROUP BY decile"""),
    "cohort_table": with_ctes("structures", PRED, body="""
SELECT segment, count(*) AS n, sum(label)::BIGINT AS n_destroyed, round(avg(label), 6) AS destroyed_rate FROM pred GROUP BY segment"""),
    "training_frame": with_ctes("structures", "zones", ZONE_EDGES, body=f"""
, ins AS (SELECT fd_id AS oid, lng + (fd_id % 3 - 1) / 1e3 AS lng, lat, CASE WHEN fd_id % 4 = 0 THEN 1 ELSE 0 END AS destroyed FROM structures WHERE fd_id % 4 <> 3),
hit AS (SELECT p.oid, e.zone_id FROM ins p JOIN zone_edges e ON e.year_num >= 1990 AND e.gis_acres > 1000 AND {CROSSES} GROUP BY ALL HAVING count(*) % 2 = 1),
one AS (SELECT oid, arg_min(zone_name, (-gis_acres, zone_name)) AS event FROM hit JOIN zones USING (zone_id) GROUP BY oid),
near AS (SELECT i.oid, t.fd_id, t.canopy_cover_100m AS cc, {hav('i.lng', 'i.lat', 't.lng', 't.lat')} AS d, sqrt(pow(i.lng - t.lng, 2) + pow(i.lat - t.lat, 2)) AS deg
  FROM ins i JOIN structures t ON abs(i.lng - t.lng) < 0.003 AND abs(i.lat - t.lat) < 0.003),
best AS (SELECT * FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY oid ORDER BY deg, fd_id) = 1) WHERE d <= 100)
SELECT oid, event, fd_id, destroyed, round(d, 2) AS dist_m FROM one JOIN best USING (oid) JOIN ins USING (oid) WHERE cc IS NOT NULL"""),
    "spearman": with_ctes("structures", body=f"""
, r AS (SELECT {AVG_RANK.format('val_struct')} AS a, {AVG_RANK.format('distance_to_fuel_m')} AS b FROM structures)
SELECT count(*) AS n, round(corr(a, b), 9) AS spearman FROM r"""),
    "decile_ratio": with_ctes("structures", body="""
, r AS (SELECT val_struct, row_number() OVER (ORDER BY slope_degrees, fd_id) AS i, count(*) OVER () AS n FROM structures)
SELECT round(avg(val_struct) FILTER (WHERE i <= greatest(1, n // 10)), 4) AS bottom_mean, round(avg(val_struct) FILTER (WHERE i > n - greatest(1, n // 10)), 4) AS top_mean FROM r"""),
    "stratified_split": with_ctes("structures", body=f"""
SELECT fd_id, row_number() OVER (PARTITION BY segment ORDER BY {HASH.format(key='fd_id', seed=42)}, fd_id) <= round(count(*) OVER (PARTITION BY segment) * 0.2e0) AS is_val FROM structures"""),
    "group_sample": with_ctes("sites", body=f"""
SELECT segment, loc_id FROM sites QUALIFY row_number() OVER (PARTITION BY segment ORDER BY {HASH.format(key='loc_id', seed=42)}, loc_id) <= 100"""),
    "prefer_then_fill": with_ctes("sites", body=f"""
, s AS (SELECT *, CASE WHEN nlcd_code >= 70 THEN 0 WHEN nlcd_code = 11 THEN 2 ELSE 1 END AS pref FROM sites)
SELECT segment, loc_id, pref FROM s QUALIFY row_number() OVER (PARTITION BY segment ORDER BY pref, {HASH.format(key='loc_id', seed=7)}, loc_id) <= 150"""),
    "masked_composite": with_ctes(*SOLAR_CTES, LONG, body="""
SELECT loc_id, round(coalesce(sum(score * w) / sum(CASE WHEN score IS NOT NULL THEN w END), 0e0), 7) AS composite FROM longs GROUP BY loc_id"""),
    "criterion_separation": with_ctes(*SOLAR_CTES, LONG, body="""
SELECT region, criterion_id, round(avg(score) FILTER (WHERE kind = 'site') - avg(score) FILTER (WHERE kind = 'random'), 6) AS separation FROM longs GROUP BY region, criterion_id"""),
    "state_backtest": with_ctes("sites", PARCELS, STATE, body="""
SELECT coalesce(segment, 'ALL') AS segment, count(*) FILTER (WHERE kind = 'site') AS n_sites, count(*) FILTER (WHERE kind = 'random') AS n_random,
  count(*) FILTER (WHERE kind = 'site' AND rating = 'Excluded' AND score >= 0.7) AS excluded_high, count(*) FILTER (WHERE loc_id % 3 = 0) AS tier_high,
  round(count(*) FILTER (WHERE kind = 'site' AND rating = 'High') * 100e0 / count(*) FILTER (WHERE kind = 'site'), 5) AS pct_high_sites,
  round(count(*) FILTER (WHERE kind = 'random' AND rating = 'High') * 100e0 / count(*) FILTER (WHERE kind = 'random'), 5) AS pct_high_random,
  round(avg(score) FILTER (WHERE kind = 'site'), 5) AS mean_sites, round(avg(score) FILTER (WHERE kind = 'site') - avg(score) FILTER (WHERE kind = 'random'), 5) AS separation
FROM st GROUP BY GROUPING SETS ((st.segment), ())"""),
    "coverage_report": with_ctes("sites", PARCELS, STATE, body="""
SELECT segment, count(*) AS n, count(DISTINCT score) AS distinct_scores, round(count(*) FILTER (WHERE loc_id % 5 <> 0) * 100e0 / count(*), 5) AS cache_pct, 0 AS silent_failures FROM st GROUP BY segment"""),
    "claims_by_tract": with_ctes("claims", body="""
SELECT tract_id, count(*) AS n, round(sum(paid + paid_contents), 4) AS paid, min(loss_date) AS first_loss, max(loss_date) AS last_loss, round(sum(paid + paid_contents) / count(*), 10) AS paid_per_claim,
  round(sum(paid + paid_contents) / greatest(1e0, (max(loss_date) - min(loss_date)) / 365.25e0), 4) AS paid_per_year FROM claims GROUP BY tract_id"""),
    "recent_claims": with_ctes("claims", body="""
SELECT tract_id, row_number() OVER (PARTITION BY tract_id ORDER BY loss_ts DESC, claim_id) AS rank, claim_id FROM claims QUALIFY rank <= 10"""),
    "flood_backtest": with_ctes(*RISK, TRACTS, body="""
SELECT tract_id, n_structures, n_claims, round(predicted, 4) AS predicted, round(actual, 10) AS actual, round(pct, 4) AS pct_in_sfha FROM t"""),
    "flood_backtest_metrics": with_ctes(*RISK, TRACTS, body=f"""
, u AS (SELECT tract_id, round(predicted, 6) AS p, round(actual, 10) AS a FROM t),
r AS (SELECT *, {AVG_RANK.format('p')} AS rp, {AVG_RANK.format('a')} AS ra, row_number() OVER (ORDER BY a, tract_id) AS ia, row_number() OVER (ORDER BY p, tract_id) AS ip, count(*) OVER () AS n FROM u)
SELECT count(*) AS n, round(corr(rp, ra), 5) AS spearman,
  round(avg(p) FILTER (WHERE ia > n - greatest(1, n // 10)) / nullif(avg(p) FILTER (WHERE ia <= greatest(1, n // 10)), 0), 5) AS discrimination,
  round(avg(p) FILTER (WHERE ip > n - greatest(1, n // 10)) / nullif(avg(p) FILTER (WHERE ip <= greatest(1, n // 10)), 0), 5) AS dynamic_range FROM r"""),
    "claimed_vs_unclaimed": with_ctes(*RISK, body="""
, c AS (SELECT DISTINCT tract_id FROM claims WHERE zone_class = 'purchase' AND paid > 150), x AS (SELECT r.*, c.tract_id IS NOT NULL AS has FROM risk r LEFT JOIN c USING (tract_id))
SELECT count(*) FILTER (WHERE has) AS n_claimed, count(*) FILTER (WHERE NOT has) AS n_unclaimed, round(avg(usd) FILTER (WHERE has), 4) AS claimed_mean,
  round(avg(usd) FILTER (WHERE NOT has), 4) AS unclaimed_mean, round(count(*) FILTER (WHERE has AND sfha) * 100e0 / count(*) FILTER (WHERE has), 4) AS sfha_hit_pct,
  round(avg(usd) FILTER (WHERE has) / avg(usd) FILTER (WHERE NOT has), 4) AS ratio FROM x"""),
    "claim_rank_correlation": with_ctes(*RISK, body=f"""
, m AS (SELECT tract_id, round(avg(usd), 6) AS x FROM risk GROUP BY tract_id), k AS (SELECT tract_id, count(*) AS n FROM claims GROUP BY tract_id),
b AS (SELECT x, coalesce(n, 0)::DOUBLE AS y FROM m LEFT JOIN k USING (tract_id)),
ranked AS (SELECT {AVG_RANK.format('x')} AS rx, {AVG_RANK.format('y')} AS ry FROM b)
SELECT count(*) AS n, round(corr(rx, ry), 8) AS spearman FROM ranked"""),
    "zone_spread": with_ctes(*RISK, body="""
SELECT flood_zone, count(*) AS n, round(min(usd), 4) AS lowest, round(median(usd), 4) AS median, round(max(usd), 4) AS highest FROM risk WHERE sfha GROUP BY flood_zone"""),
    "zone_share": with_ctes("structures", body="""
SELECT tract, count(*) AS n, round(count(*) FILTER (WHERE slope_degrees > 22) * 100e0 / count(*), 5) AS pct FROM structures GROUP BY tract HAVING count(*) >= 5
ORDER BY count(*) FILTER (WHERE slope_degrees > 22) * 100e0 / count(*) DESC, tract LIMIT 10"""),
    "chain_vs_random": with_ctes("stores", body="""
SELECT segment = 'BUILDING' AS chain, count(*) AS n, round(count(*) FILTER (WHERE (loc_id * 37 % 1001) / 1000e0 >= 0.7) * 100e0 / count(*), 6) AS pct_strong,
  round(avg((loc_id * 37 % 1001) / 1000e0), 6) AS mean_score, round(median((loc_id * 37 % 1001) / 1000e0), 6) AS median_score FROM stores GROUP BY 1"""),
    "harness_summary": """
WITH c AS (SELECT (o_orderkey * 7 % 101)::DOUBLE AS p, (o_orderkey * 11 % 97)::DOUBLE AS e, o_totalprice / 1e2 AS ms FROM orders), r AS (SELECT *, abs(p - e) AS a FROM c)
SELECT count(*) AS n, count(*) FILTER (WHERE a <= 10) AS in_range, count(*) FILTER (WHERE a < 5) AS err_0_5, count(*) FILTER (WHERE a >= 5 AND a < 10) AS err_5_10,
  count(*) FILTER (WHERE a >= 10 AND a < 20) AS err_10_20, count(*) FILTER (WHERE a >= 20 AND a < 30) AS err_20_30, count(*) FILTER (WHERE a >= 30) AS err_30,
  round(avg(a), 4) AS mae, round(sqrt(avg(a * a)), 4) AS rmse, round(avg(p - e), 4) AS bias, round(max(a), 4) AS max_abs_error, round(min(ms), 4) AS latency_min,
  round(max(ms), 4) AS latency_max, (SELECT round(ms, 4) FROM (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM c) WHERE i = n // 2) AS latency_p50 FROM r""",
    "top_precision": with_ctes("sites", PARCELS, body="""
, top AS (SELECT loc_id FROM rated ORDER BY score DESC, loc_id LIMIT 15)
SELECT count(*) AS k, count(*) FILTER (WHERE loc_id % 4 = 1) AS net_new, count(*) FILTER (WHERE loc_id % 4 = 0) AS known_found, round(count(*) FILTER (WHERE loc_id % 4 <= 1) / count(*), 6) AS precision,
  round(count(*) FILTER (WHERE loc_id % 4 = 0) / (SELECT count(*) FROM sites WHERE loc_id % 4 = 0), 6) AS coverage FROM top"""),
    "bootstrap_ci": with_ctes("claims", body="""
, r0 AS (SELECT (claim_id % 2147483647 * 48271 + claim_id // 2147483647 % 2147483647 * 69621 + 42) % 2147483647 AS r, paid FROM claims WHERE paid IS NOT NULL),
x AS (SELECT b, paid, (r + b * 1000003) % 2147483647 AS x FROM r0 CROSS JOIN (SELECT unnest(range(1, 2001)) AS b)),
y AS (SELECT b, paid, (x * x % 2147483647 * 48271 + x) % 2147483647 AS y FROM x),
u AS (SELECT b, paid, ((y * y % 2147483647 + y * 69621) % 2147483647) / 2147483647e0 AS u FROM y),
w AS (SELECT b, paid, (u >= 0.36787944)::INT + (u >= 0.73575888)::INT + (u >= 0.91969860)::INT + (u >= 0.98101184)::INT
  + (u >= 0.99634015)::INT + (u >= 0.99940582)::INT + (u >= 0.99991676)::INT AS w FROM u),
m AS (SELECT sum(w * paid) / sum(w) AS mean FROM w GROUP BY b HAVING sum(w) > 0),
r AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS i, count(*) OVER () AS n FROM m)
SELECT round(max(mean) FILTER (WHERE i = floor(n * 0.025)), 6) AS lo, round(max(mean) FILTER (WHERE i = floor(n * 0.975) - 1), 6) AS hi FROM r"""),
    "random_points": with_ctes("tiles", body=f"""
, p AS (SELECT *, CAST(floor((x0 + 180) * 1e3) AS BIGINT) * 360001 + CAST(floor((y0 + 90) * 1e3) AS BIGINT) AS pid FROM tiles),
g AS (SELECT p.*, i, j, {HASH.format(key='(pid % 9973 * 4099 + i * 61 + j)', seed=42)} / 1000003e0 AS jx, {HASH.format(key='(pid % 9967 * 4093 + j * 67 + i)', seed=43)} / 1000003e0 AS jy
  FROM p CROSS JOIN (SELECT unnest(range(12)) AS i) CROSS JOIN (SELECT unnest(range(12)) AS j)),
k AS (SELECT region_id, pid, i * 12 + j AS k, x0 + (x1 - x0) * (i + jx) / 12e0 AS lng, y0 + (y1 - y0) * (j + jy) / 12e0 AS lat FROM g)
SELECT region_id, row_number() OVER (PARTITION BY region_id ORDER BY {HASH.format(key='(pid % 9949 * 4001 + k)', seed=44)}, pid, k) AS point_no, round(lng, 9) AS lng, round(lat, 9) AS lat
FROM k QUALIFY point_no <= 40"""),
}
