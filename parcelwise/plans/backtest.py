"""Back-tests and data-quality reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import relational as R
from ..session import cut_lineage


def state_summary(scored: DataFrame, state: str, kind: str) -> DataFrame:
    """Ratings, means and separation of sites against random points, per state
    and for the nation (``ALL``) from one grouping-sets pass.

    Needs score, rating, tier, n_exclusions.
    """
    site, rnd = F.col(kind) == "site", F.col(kind) == "random"

    def pct(test: Column, base: Column) -> Column:
        return F.try_divide(F.count_if(base & test) * 100.0, F.count_if(base))

    grouped = scored.rollup(state).agg(
        F.grouping(state).alias("_all"),
        F.count_if(site).alias("n_sites"),
        F.count_if(rnd).alias("n_random"),
        pct(F.col("rating") == "High", site).alias("pct_high_sites"),
        pct(F.col("rating") == "High", rnd).alias("pct_high_random"),
        F.avg(F.when(site, F.col("score"))).alias("mean_sites"),
        F.avg(F.when(rnd, F.col("score"))).alias("mean_random"),
        F.count_if(site & (F.col("rating") == "Excluded") & (F.col("score") >= 0.7)).alias("excluded_high"),
        F.count_if(F.col("tier") == "HIGH").alias("tier_high"),
    )
    return (
        grouped.withColumn(state, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(state)))
        .withColumn("separation", F.col("mean_sites") - F.col("mean_random"))
        .drop("_all")
    )


def coverage_summary(scored: DataFrame, group: str) -> DataFrame:
    """Distinct composites, cache share and silent failures per group."""
    return scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.round("score", 4)).alias("distinct_scores"),
        F.try_divide(F.count_if(F.col("from_cache")) * 100.0, F.count(F.lit(1))).alias("cache_pct"),
        F.count_if(F.col("score").isNull() & F.col("error").isNull()).alias("silent_failures"),
    )


def claims_by_tract(claims: DataFrame, key: str = "tract_id") -> DataFrame:
    """Count, paid, dates and yearly loss per tract; at least one year of record."""
    paid = F.coalesce(F.col("paid"), F.lit(0.0)) + F.coalesce(F.col("paid_contents"), F.lit(0.0))
    g = claims.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(paid).alias("paid"), F.min("loss_date").alias("first_loss"), F.max("loss_date").alias("last_loss")
    )
    years = F.greatest(F.lit(1.0), F.date_diff("last_loss", "first_loss") / 365.25)
    return g.withColumns({"paid_per_claim": F.col("paid") / F.col("n"), "paid_per_year": F.col("paid") / years})


def recent_claims(claims: DataFrame, key: str, n: int = 10) -> DataFrame:
    from ..operators.spatial import top_k_per_key

    return top_k_per_key(claims, [key], [F.desc("loss_ts"), F.col("claim_id")], n)


def tract_backtest(predicted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Predicted mean risk against paid per claim, one row per tract."""
    means = predicted.groupBy(key).agg(
        F.avg("annual_risk_usd").alias("predicted"),
        F.count(F.lit(1)).alias("n_structures"),
        F.try_divide(F.count_if(F.col("annual_risk_usd") > 0) * 100.0, F.count(F.lit(1))).alias("pct_in_sfha"),
    )
    return means.join(actual.select(key, F.col("n").alias("n_claims"), F.col("paid_per_claim").alias("actual")), key)


def backtest_metrics(tracts: DataFrame, key: str) -> DataFrame:
    """Rank correlation, discrimination and dynamic range of a tract back-test.

    The tract table feeds several ranks, so it is checkpointed once.
    """
    tracts = cut_lineage(tracts.select(key, "predicted", "actual"))
    rho = A.spearman(tracts, "predicted", "actual")
    disc = A.edge_decile_means(tracts, "actual", "predicted", key).select(
        F.try_divide(F.col("top_mean"), F.col("bottom_mean")).alias("v")
    )
    spread = A.edge_decile_means(tracts, "predicted", "predicted", key).select(
        F.try_divide(F.col("top_mean"), F.col("bottom_mean")).alias("v")
    )
    return rho.select(
        "n", "spearman", disc.scalar().alias("discrimination"), spread.scalar().alias("dynamic_range")
    )


def claimed_vs_unclaimed(predicted: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Means in tracts with and without claims, and their ratio."""
    claimed = claims.select(key).distinct().withColumn("_c", F.lit(True))
    rows = predicted.join(claimed, key, "left")
    has = F.coalesce(F.col("_c"), F.lit(False))
    r = rows.agg(
        F.avg(F.when(has, F.col("annual_risk_usd"))).alias("claimed_mean"),
        F.avg(F.when(~has, F.col("annual_risk_usd"))).alias("unclaimed_mean"),
        F.count_if(has).alias("n_claimed"),
        F.count_if(~has).alias("n_unclaimed"),
        F.try_divide(F.count_if(has & F.col("in_sfha")) * 100.0, F.count_if(has)).alias("sfha_hit_pct"),
    )
    return r.withColumn("ratio", F.try_divide(F.col("claimed_mean"), F.col("unclaimed_mean")))


def zone_spread(losses: DataFrame, zone: str, value: str) -> DataFrame:
    """Min, median and max within each zone."""
    q = A.quantile_columns(losses, value, {"median": 0.5}, [zone])
    s = losses.groupBy(zone).agg(F.count(value).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return s.join(q, zone)


def share_by_group(df: DataFrame, group: str, test: Column, least: int, top: int) -> DataFrame:
    """Percent passing per group with enough rows, the highest first."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (F.count_if(test) * 100.0 / F.count(F.lit(1))).alias("pct"))
    return g.filter(F.col("n") >= least).orderBy(F.desc("pct"), group).limit(top)


def chain_vs_random(scored: DataFrame, chain: str, score: str, rating: str) -> DataFrame:
    """Share strong, mean and median for chain stores and for random points."""
    s = scored.groupBy(chain).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col(rating) == "Strong") * 100.0 / F.count(F.lit(1))).alias("pct_strong"),
        F.avg(score).alias("mean_score"),
    )
    return s.join(A.quantile_columns(scored, score, {"median_score": 0.5}, [chain]), chain)


def calibration_summary(cases: DataFrame) -> DataFrame:
    """Error metrics of predicted against expected scores in one aggregate.

    Needs predicted, expected, expected_lo, expected_hi, latency_ms.
    """
    e = F.col("predicted") - F.col("expected")
    a = F.abs(e)
    inside = F.col("predicted").between(F.col("expected_lo"), F.col("expected_hi"))
    out = cases.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(inside).alias("in_range"),
        F.avg(a).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.count_if(a < 5).alias("err_0_5"),
        F.count_if((a >= 5) & (a < 10)).alias("err_5_10"),
        F.count_if((a >= 10) & (a < 20)).alias("err_10_20"),
        F.count_if((a >= 20) & (a < 30)).alias("err_20_30"),
        F.count_if(a >= 30).alias("err_30"),
        F.max(a).alias("max_abs_error"),
        F.min("latency_ms").alias("latency_min"),
        F.max("latency_ms").alias("latency_max"),
        F.avg("latency_ms").alias("latency_mean"),
    )
    p50 = A.values_at(cases, "latency_ms", {"p50": lambda n: F.floor(n / 2)})
    return out.withColumn("latency_p50", p50.select("quantile").scalar())


def factor_violations(cases: DataFrame, expected: str, actual: str, key: str) -> DataFrame:
    """Factors missing or outside their expected range, from two map columns."""
    rows = cases.select(key, F.explode(expected).alias("factor", "range"), F.col(actual).alias("_a"))
    v = F.col("_a")[F.col("factor")]
    why = F.when(v.isNull(), "missing").when(~v.between(F.col("range.lo"), F.col("range.hi")), "outside")
    return rows.select(key, "factor", v.alias("value"), why.alias("violation")).filter(F.col("violation").isNotNull())


# fixed values: Poisson(1) cumulative probabilities
POISSON_CUTS = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
#: Rows whose weights are drawn at once.
DRAWN_ROWS = 256
_P = 2_147_483_647


def _draws(resamples: int, seed: int, value: str, key: str):
    """Per task and resample: the weighted sum and the weights of the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = np.arange(1, resamples + 1, dtype=np.int64) * 1_000_003
        sums, weights = np.zeros(resamples), np.zeros(resamples, np.int64)
        for batch in batches:
            keys, values = batch.column(key).to_numpy(), batch.column(value).to_numpy()
            row = (keys % _P * 48_271 + keys // _P % _P * 69_621 + seed) % _P
            for at in range(0, len(row), DRAWN_ROWS):
                # Rounds of a quadratic hash that any SQL engine can repeat.
                x = (row[at : at + DRAWN_ROWS, None] + b) % _P
                y = (x * x % _P * 48_271 + x) % _P
                u = (y * y % _P + y * 69_621) % _P / float(_P)
                w = np.searchsorted(POISSON_CUTS, u.ravel(), "right").reshape(u.shape)
                sums += values[at : at + DRAWN_ROWS] @ w
                weights += w.sum(axis=0)
        if weights.any():
            yield pa.RecordBatch.from_pydict({"b": np.arange(1, resamples + 1), "s": sums, "w": weights})

    return run


def bootstrap_mean_ci(df: DataFrame, value: str, key: str, resamples: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean under Poisson(1) resampling of rows.

    Every row draws its own weight in every resample, from a hash of its key, so a lost task
    draws the same again. A task adds up its rows and sends one row a resample.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias(key), F.col(value).cast("double").alias(value))
    sums = rows.mapInArrow(_draws(resamples, seed, value, key), "b long, s double, w long").groupBy("b").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    means = sums.filter(F.col("w") > 0).select((F.col("s") / F.col("w")).alias("mean"))
    at = A.values_at(
        means, "mean", {"lo": lambda n: F.floor(n * (alpha / 2)), "hi": lambda n: F.floor(n * (1 - alpha / 2)) - 1}
    )
    return A.pivot_values(at, ["lo", "hi"])


def top_precision(ranked: DataFrame, score: str, key: str, k: int = 15) -> DataFrame:
    """Precision, net-new share and coverage of the top k.

    Needs outcome ∈ {pursue, known, reject}; coverage is known sites found.
    """
    top = ranked.orderBy(F.desc_nulls_last(score), key).limit(k)
    t = top.agg(
        F.count(F.lit(1)).alias("k"),
        F.count_if(F.col("outcome") == "pursue").alias("net_new"),
        F.count_if(F.col("outcome") == "known").alias("known_found"),
    )
    known = ranked.agg(F.count_if(F.col("outcome") == "known").alias("known_total"))
    return t.withColumn("known_total", known.scalar()).select(
        "k",
        "net_new",
        "known_found",
        ((F.col("net_new") + F.col("known_found")) / F.col("k")).alias("precision"),
        F.try_divide(F.col("known_found"), F.col("known_total")).alias("coverage"),
    )


def curve_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Mean absolute change per class between two damage-curve tables."""
    d = R.table_diff(new, old, ["occupancy_class", "depth_ft"], ["structural_damage_pct", "contents_damage_pct"])
    moved = F.abs("delta_structural_damage_pct") + F.abs("delta_contents_damage_pct")
    return d.groupBy("occupancy_class").agg(
        F.count_if(F.col("status") == "changed").alias("cells_changed"),
        F.count_if(F.col("status") == "new").alias("rows_new"),
        F.avg(F.when(F.col("status") == "changed", moved / 2.0)).alias("mean_abs_delta"),
    )
