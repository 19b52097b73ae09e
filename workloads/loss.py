"""Wildfire loss report queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import constants as K
from parcelwise.plans import portfolio

from .layers import layer, with_ctes

C = K.WILDFIRE_COEFFICIENTS


def scored(spark, sf_dir) -> DataFrame:
    return portfolio.structure_losses(layer(spark, sf_dir, "structures"))


def eal_by_occupancy(spark, sf_dir):
    """F8, H2, A1."""
    out = portfolio.loss_by_occupancy(scored(spark, sf_dir))
    return out.select(
        "occ_group", "n", F.round("total_eal", 2).alias("total_eal"), F.round("mean_eal", 4).alias("mean_eal"),
        F.round("median_eal", 4).alias("median_eal"), F.round("total_exposure", 2).alias("total_exposure"),
        F.round("share_of_total_eal", 6).alias("share_of_total_eal"),
    )


def eal_by_tract(spark, sf_dir):
    """A2."""
    out = portfolio.loss_by_tract(scored(spark, sf_dir))
    return out.select(
        "tract_fips", "n_structures", F.round("total_eal", 2).alias("total_eal"), F.round("mean_eal", 4).alias("mean_eal"),
        F.round("total_exposure", 2).alias("total_exposure"), F.round("centroid_lng", 6).alias("centroid_lng"),
        F.round("centroid_lat", 6).alias("centroid_lat"),
    )


def eal_histogram(spark, sf_dir):
    """A3."""
    out = portfolio.loss_histogram(scored(spark, sf_dir))
    return out.select("bucket", "n", F.round("share", 6).alias("share"), F.round("bucket_total_eal", 2).alias("bucket_total_eal"))


def oep_curve(spark, sf_dir):
    """W4."""
    out = portfolio.exceedance_curve(scored(spark, sf_dir))
    return out.select(
        F.round("loss_amount", 2).alias("loss_amount"), F.round("annual_freq_exceed", 8).alias("annual_freq_exceed")
    )


def oep_return_periods(spark, sf_dir):
    """J22, P4."""
    out = portfolio.return_period_losses(portfolio.exceedance_curve(scored(spark, sf_dir)))
    return out.select("return_period_years", F.round("loss_amount", 2).alias("loss_amount"))


def top_risk(spark, sf_dir):
    """The hundred largest annual losses."""
    out = portfolio.largest_losses(scored(spark, sf_dir), 100)
    return out.select(
        "fd_id", "occtype", F.round("expected_annual_loss", 4).alias("expected_annual_loss"),
        F.round("p_destroyed", 6).alias("p_destroyed"), "tract_fips",
    )


def portfolio_quantiles(spark, sf_dir):
    """A7."""
    out = portfolio.loss_quantiles(scored(spark, sf_dir))
    return out.select(*[F.round(c, 4).alias(c) for c in ("p5", "p95", "max_eal", "total_frequency")])


def loss_report(spark, sf_dir):
    """Every section of the report in one long table."""
    return portfolio.loss_report(scored(spark, sf_dir)).select("section", "label", F.round("value", 2).alias("value"))


LOSSES = f"""losses AS (
  SELECT *, substr(occtype, 1, 3) AS occ_group,
    1e0 / (1e0 + exp(-({C['const']!r} + {C['burn_probability']!r} * burn_probability
      + {C['distance_to_fuel_m']!r} * distance_to_fuel_m + {C['canopy_cover_100m']!r} * canopy_cover_100m
      + {C['slope_degrees']!r} * slope_degrees
      + {C['is_res1']!r} * CASE WHEN occtype LIKE 'RES1%' THEN 1e0 ELSE 0e0 END))) AS p_destroyed
  FROM structures
  WHERE val_struct > 0 AND burn_probability IS NOT NULL AND distance_to_fuel_m IS NOT NULL
    AND canopy_cover_100m IS NOT NULL AND slope_degrees IS NOT NULL AND occtype IS NOT NULL),
eal AS (SELECT *, burn_probability * p_destroyed AS lambda_destroy,
    burn_probability * p_destroyed * val_struct AS expected_annual_loss FROM losses)"""
CURVE = """curve AS (
  SELECT val_struct AS loss_amount, sum(sum(lambda_destroy)) OVER (ORDER BY val_struct DESC) AS freq
  FROM eal GROUP BY val_struct)"""
RETURNS = f"""rp AS (SELECT unnest([{', '.join(map(str, K.RETURN_PERIODS_YEARS))}]) AS rp_years),
targets AS (SELECT rp_years, 1e0 / rp_years AS target,
    (SELECT arg_max(loss_amount, (freq, loss_amount)) FROM curve WHERE freq <= 1e0 / rp_years) AS l0,
    (SELECT max(freq) FROM curve WHERE freq <= 1e0 / rp_years) AS f0,
    (SELECT arg_min(loss_amount, (freq, loss_amount)) FROM curve WHERE freq >= 1e0 / rp_years) AS l1,
    (SELECT min(freq) FROM curve WHERE freq >= 1e0 / rp_years) AS f1 FROM rp),
standard AS (SELECT rp_years, CASE WHEN l0 IS NULL THEN l1 WHEN l1 IS NULL THEN l0 WHEN f1 = f0 THEN l0
    ELSE l0 + (l1 - l0) * (target - f0) / (f1 - f0) END AS loss_amount FROM targets)"""

HIST = """hist AS (SELECT bucket, count(*) FILTER (WHERE hit) AS n,
    coalesce(sum(expected_annual_loss) FILTER (WHERE hit), 0e0) AS total FROM (
  SELECT b.bucket, e.expected_annual_loss,
    CASE WHEN b.hi = 0 THEN e.expected_annual_loss = 0 WHEN b.hi IS NULL THEN e.expected_annual_loss >= b.lo
      ELSE e.expected_annual_loss > b.lo AND e.expected_annual_loss <= b.hi END AS hit
  FROM eal e CROSS JOIN (VALUES ('$0', 0e0, 0e0), ('$0-10', 0e0, 1e1), ('$10-100', 1e1, 1e2), ('$100-500', 1e2, 5e2),
    ('$500-1000', 5e2, 1e3), ('$1000+', 1e3, NULL)) AS b(bucket, lo, hi)) GROUP BY bucket)"""

QUERIES = {
    "eal_by_occupancy": eal_by_occupancy,
    "eal_by_tract": eal_by_tract,
    "eal_histogram": eal_histogram,
    "oep_curve": oep_curve,
    "oep_return_periods": oep_return_periods,
    "top_risk": top_risk,
    "portfolio_quantiles": portfolio_quantiles,
    "loss_report": loss_report,
}

ORACLES = {
    "eal_by_occupancy": with_ctes("structures", LOSSES, body="""
SELECT occ_group, count(*) AS n, round(sum(expected_annual_loss), 2) AS total_eal,
  round(avg(expected_annual_loss), 4) AS mean_eal, round(median(expected_annual_loss), 4) AS median_eal,
  round(sum(val_struct), 2) AS total_exposure,
  round(sum(expected_annual_loss) / sum(sum(expected_annual_loss)) OVER (), 6) AS share_of_total_eal
FROM eal GROUP BY occ_group"""),
    "eal_by_tract": with_ctes("structures", LOSSES, body="""
SELECT substr(cbfips, 1, 11) AS tract_fips, count(*) AS n_structures, round(sum(expected_annual_loss), 2) AS total_eal,
  round(avg(expected_annual_loss), 4) AS mean_eal, round(sum(val_struct), 2) AS total_exposure,
  round(avg(lng), 6) AS centroid_lng, round(avg(lat), 6) AS centroid_lat
FROM eal GROUP BY 1"""),
    "eal_histogram": with_ctes("structures", LOSSES, HIST, body="""
SELECT bucket, n, round(n / (SELECT count(*) FROM eal), 6) AS share, round(total, 2) AS bucket_total_eal FROM hist"""),
    "oep_curve": with_ctes("structures", LOSSES, CURVE, body="""
SELECT round(loss_amount, 2) AS loss_amount, round(freq, 8) AS annual_freq_exceed FROM curve"""),
    "oep_return_periods": with_ctes("structures", LOSSES, CURVE, RETURNS, body="""
SELECT rp_years AS return_period_years, round(loss_amount, 2) AS loss_amount FROM standard"""),
    "top_risk": with_ctes("structures", LOSSES, body="""
SELECT fd_id, occtype, round(expected_annual_loss, 4) AS expected_annual_loss, round(p_destroyed, 6) AS p_destroyed,
  substr(cbfips, 1, 11) AS tract_fips
FROM eal ORDER BY eal.expected_annual_loss DESC, fd_id LIMIT 100"""),
    "portfolio_quantiles": with_ctes("structures", LOSSES, body="""
SELECT round(quantile_cont(expected_annual_loss, 5e-2), 4) AS p5, round(quantile_cont(expected_annual_loss, 9.5e-1), 4) AS p95,
  round(max(expected_annual_loss), 4) AS max_eal, round(sum(lambda_destroy), 4) AS total_frequency FROM eal"""),
    "loss_report": with_ctes("structures", LOSSES, CURVE, RETURNS, HIST, body="""
SELECT 'total' AS section, 'expected_annual_loss' AS label, round(sum(expected_annual_loss), 2) AS value FROM eal
UNION ALL SELECT 'total', 'structures', count(*)::DOUBLE FROM eal
UNION ALL SELECT 'total', 'mean', round(avg(expected_annual_loss), 2) FROM eal
UNION ALL SELECT 'total', 'frequency', round(sum(lambda_destroy), 2) FROM eal
UNION ALL SELECT 'quantile', 'p5', round(quantile_cont(expected_annual_loss, 5e-2), 2) FROM eal
UNION ALL SELECT 'quantile', 'median', round(quantile_cont(expected_annual_loss, 5e-1), 2) FROM eal
UNION ALL SELECT 'quantile', 'p95', round(quantile_cont(expected_annual_loss, 9.5e-1), 2) FROM eal
UNION ALL SELECT 'occupancy', occ_group, round(sum(expected_annual_loss), 2) FROM eal GROUP BY occ_group
UNION ALL SELECT 'histogram', bucket, n::DOUBLE FROM hist
UNION ALL SELECT 'return_period', rp_years::STRING, round(loss_amount, 2) FROM standard
UNION ALL (SELECT 'top_tract', substr(cbfips, 1, 11), round(sum(expected_annual_loss), 2) FROM eal GROUP BY 2
  ORDER BY sum(expected_annual_loss) DESC, 2 LIMIT 20)"""),
}
