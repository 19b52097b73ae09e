"""Structure losses, portfolio summaries and loss reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..operators import aggregates as A

MODEL_INPUTS = ["burn_probability", "distance_to_fuel_m", "canopy_cover_100m", "slope_degrees", "occtype"]


def is_res1(occtype: str = "occtype") -> Column:
    return F.coalesce(F.col(occtype).startswith("RES1"), F.lit(False)).cast("double")


def destruction_log_odds(coefficients: dict[str, float] = K.WILDFIRE_COEFFICIENTS) -> Column:
    z = F.lit(coefficients["const"])
    for name in ("burn_probability", "distance_to_fuel_m", "canopy_cover_100m", "slope_degrees"):
        z = z + F.col(name) * coefficients[name]
    return z + is_res1() * coefficients["is_res1"]


def structure_losses(structures: DataFrame, coefficients: dict[str, float] = K.WILDFIRE_COEFFICIENTS) -> DataFrame:
    """Complete cases only; adds p_destroyed, lambda_destroy, expected_annual_loss."""
    complete = structures.dropna(subset=["val_struct", *MODEL_INPUTS]).filter(F.col("val_struct") > 0)
    return (
        complete.withColumn("p_destroyed", S.logistic(destruction_log_odds(coefficients)))
        .withColumn("lambda_destroy", F.col("burn_probability") * F.col("p_destroyed"))
        .withColumn("expected_annual_loss", F.col("lambda_destroy") * F.col("val_struct"))
    )


def loss_by_occupancy(losses: DataFrame) -> DataFrame:
    slim = losses.select(F.substring("occtype", 1, 3).alias("occ_group"), "expected_annual_loss", "val_struct")
    sums = slim.groupBy("occ_group").agg(
        F.count("expected_annual_loss").alias("n"),
        F.sum("expected_annual_loss").alias("total_eal"),
        F.avg("expected_annual_loss").alias("mean_eal"),
        F.sum("val_struct").alias("total_exposure"),
    )
    medians = A.quantile_columns(slim, "expected_annual_loss", {"median_eal": 0.5}, ["occ_group"])
    # One row per class, so the unpartitioned window is small.
    share = F.col("total_eal") / F.sum("total_eal").over(W.partitionBy())
    return sums.join(medians, "occ_group").withColumn("share_of_total_eal", share).orderBy(F.desc("total_eal"))


def loss_by_tract(losses: DataFrame) -> DataFrame:
    return (
        losses.groupBy(F.substring("cbfips", 1, 11).alias("tract_fips"))
        .agg(
            F.count("expected_annual_loss").alias("n_structures"),
            F.sum("expected_annual_loss").alias("total_eal"),
            F.avg("expected_annual_loss").alias("mean_eal"),
            F.sum("val_struct").alias("total_exposure"),
            F.avg("lng").alias("centroid_lng"),
            F.avg("lat").alias("centroid_lat"),
        )
    )


def loss_histogram(losses: DataFrame) -> DataFrame:
    value = F.col("expected_annual_loss")
    slim = losses.select("expected_annual_loss")
    counts = A.bucket_counts(slim, A.overlapping_buckets(value), "expected_annual_loss")
    total = slim.agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("share", F.col("n") / total.scalar()).withColumnRenamed("bucket_total", "bucket_total_eal")


def exceedance_curve(losses: DataFrame) -> DataFrame:
    """One row per loss level: yearly frequency of any single loss at or above it.

    Rows tied at a level all count.
    """
    levels = losses.groupBy("val_struct").agg(F.sum("lambda_destroy").alias("freq"))
    cum = A.running_total(levels, "val_struct", ["freq"], descending=True)
    freq = F.col("cum_freq")
    return cum.select(
        F.col("val_struct").alias("loss_amount"),
        freq.alias("annual_freq_exceed"),
        F.when(freq > 0, 1.0 / F.nullif(freq, F.lit(0.0))).alias("return_period_years"),
    )


def return_period_losses(curve: DataFrame, periods=K.RETURN_PERIODS_YEARS) -> DataFrame:
    """Loss at each return period by linear interpolation, clamped at the ends.

    One pass: every curve row updates the bracket of each of the few targets.
    """
    spark = curve.sparkSession
    aggs = []
    for p in periods:
        f, point = F.col("annual_freq_exceed"), F.struct(F.col("annual_freq_exceed"), F.col("loss_amount"))
        target = F.lit(1.0 / p)
        aggs += [F.max(F.when(f <= target, point)).alias(f"lo_{p}"), F.min(F.when(f >= target, point)).alias(f"hi_{p}")]
    brackets = curve.agg(*aggs)
    rows = F.array(
        *[F.struct(F.lit(p).alias("return_period_years"), F.col(f"lo_{p}").alias("lo"), F.col(f"hi_{p}").alias("hi")) for p in periods]
    )
    target = F.lit(1.0) / F.col("return_period_years")
    f0, l0 = F.col("lo.annual_freq_exceed"), F.col("lo.loss_amount")
    f1, l1 = F.col("hi.annual_freq_exceed"), F.col("hi.loss_amount")
    mixed = l0 + (l1 - l0) * (target - f0) / F.nullif(f1 - f0, F.lit(0.0))
    return brackets.select(F.explode(rows).alias("_r")).select("_r.*").select(
        "return_period_years", target.alias("annual_freq_exceed"), F.coalesce(mixed, l0, l1).alias("loss_amount")
    )


def largest_losses(losses: DataFrame, n: int) -> DataFrame:
    return (
        losses.withColumn("tract_fips", F.substring("cbfips", 1, 11))
        .orderBy(F.desc_nulls_last("expected_annual_loss"), "fd_id")
        .limit(n)
    )


def loss_quantiles(losses: DataFrame) -> DataFrame:
    q = A.quantile_columns(losses, "expected_annual_loss", {"p5": 0.05, "p95": 0.95})
    s = losses.agg(F.max("expected_annual_loss").alias("max_eal"), F.sum("lambda_destroy").alias("total_frequency"))
    return s.withColumn("_q", q.select(F.struct("p5", "p95")).scalar()).select("_q.*", "max_eal", "total_frequency")


def loss_report(losses: DataFrame, top_tracts: int = 20) -> DataFrame:
    """All sections as (section, label, value)."""
    slim = losses.select("occtype", "cbfips", "val_struct", "lambda_destroy", "expected_annual_loss", "lng", "lat")

    def section(name: str, df: DataFrame, label: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), label.cast("string").alias("label"), value.cast("double").alias("value"))

    # One cube feeds the totals, classes, buckets and tracts; Spark plans its
    # shuffle once and reuses it.
    cube = (
        slim.withColumn("bucket", F.explode(A.overlapping_buckets(F.col("expected_annual_loss"))))
        .withColumn("_first", F.col("bucket") == A.exclusive_bucket(F.col("expected_annual_loss")))
        .groupBy(F.substring("occtype", 1, 3).alias("occ_group"), F.substring("cbfips", 1, 11).alias("tract_fips"), "bucket", "_first")
        .agg(
            F.sum("expected_annual_loss").alias("eal"),
            F.count(F.lit(1)).alias("n"),
            F.sum("lambda_destroy").alias("frequency"),
        )
    )
    rows_once = cube.filter("_first")
    totals = rows_once.agg(
        F.sum("eal").alias("expected_annual_loss"),
        F.sum("n").cast("double").alias("structures"),
        (F.sum("eal") / F.sum("n")).alias("mean"),
        F.sum("frequency").alias("frequency"),
    ).unpivot([], ["expected_annual_loss", "structures", "mean", "frequency"], "label", "value")
    quantiles = A.values_at(
        slim, "expected_annual_loss", {n: A.linear_position(p) for n, p in (("p5", 0.05), ("median", 0.5), ("p95", 0.95))}
    )
    occupancy = rows_once.groupBy("occ_group").agg(F.sum("eal").alias("v"))
    found = cube.groupBy("bucket").agg(F.sum("n").alias("n"))
    labels = losses.sparkSession.createDataFrame([(b,) for b, _, _ in K.LOSS_BUCKETS], "bucket string")
    histogram = labels.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    tracts = rows_once.groupBy("tract_fips").agg(F.sum("eal").alias("total_eal")).orderBy(F.desc("total_eal"), "tract_fips").limit(top_tracts)
    parts = [
        section("total", totals, F.col("label"), F.col("value")),
        section("quantile", quantiles, F.col("name"), F.col("quantile")),
        section("occupancy", occupancy, F.col("occ_group"), F.col("v")),
        section("histogram", histogram, F.col("bucket"), F.col("n")),
        section("return_period", return_period_losses(exceedance_curve(slim)), F.col("return_period_years"), F.col("loss_amount")),
        section("top_tract", tracts, F.col("tract_fips"), F.col("total_eal")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ── portfolios ──────────────────────────────────────────────────────────────
def portfolio_status(records: DataFrame) -> DataFrame:
    """scored / no_coverage / error per property; persisted zero falls through."""
    bad = F.col("lat").isNull() | F.col("lng").isNull()
    matched = F.col("fd_id").isNotNull()
    return records.withColumn("status", F.when(bad, "error").when(matched, "scored").otherwise("no_coverage"))


def portfolio_summary(records: DataFrame) -> DataFrame:
    """One row: counts by status, totals, order statistics, tiers, perimeter share.

    Order statistics come from the running-count quantiles, and p95 is the value
    at position int(0.95·n).
    """
    r = F.col("annual_risk_usd")
    ok = r.isNotNull()
    tier = S.portfolio_tier("annual_risk_usd")
    held = F.coalesce(F.col("in_perimeter"), F.lit(False)) & ok
    sums = records.agg(
        F.count(F.lit(1)).alias("property_count"),
        F.count("annual_risk_usd").alias("scored_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.count_if(F.col("status") == "no_coverage").alias("no_coverage_count"),
        F.round(F.sum(r), 2).alias("total_annual_risk"),
        F.round(F.avg(r), 2).alias("mean_risk"),
        F.round(F.min(r), 2).alias("min_risk"),
        F.round(F.max(r), 2).alias("max_risk"),
        *[F.count_if(tier == t).alias(f"{t}_risk_count") for t in ("high", "moderate", "low")],
        F.count_if(held).alias("in_perimeter_count"),
        F.count_if(held & tier.isin("high", "moderate")).alias("in_perimeter_high_or_moderate"),
    )
    at = A.values_at(
        records.select("annual_risk_usd"),
        "annual_risk_usd",
        {"median": A.linear_position(0.5), "p95": lambda n: F.least(F.floor(n * 0.95), n - 1)},
    )
    ordered = A.pivot_values(at, ["median", "p95"]).select(F.struct("median", "p95").alias("_o")).scalar()
    return sums.withColumn("_o", ordered).withColumns(
        {
            "median_risk": F.round("_o.median", 2),
            "p95_risk": F.round("_o.p95", 2),
            "in_perimeter_share": F.round(
                F.try_divide(F.col("in_perimeter_high_or_moderate"), F.col("in_perimeter_count")), 4
            ),
        }
    ).drop("_o")


def portfolio_histogram(records: DataFrame) -> DataFrame:
    slim = records.filter(F.col("annual_risk_usd").isNotNull()).select("annual_risk_usd")
    return A.bucket_counts(slim, F.array(A.exclusive_bucket(F.col("annual_risk_usd"))), "annual_risk_usd")


def benchmark_mean(losses: DataFrame) -> DataFrame:
    return losses.filter(F.col("expected_annual_loss").isNotNull()).agg(
        F.avg("expected_annual_loss").alias("mean_eal"), F.count(F.lit(1)).alias("n_structures")
    )


# Driver feature, direction (+1 higher is riskier), label, floor of the median.
DRIVERS = (
    ("burn_probability", 1, "burn probability", 1e-9),
    ("distance_to_fuel_m", -1, "distance to fuel", 1.0),
    ("canopy_cover_100m", 1, "canopy cover", 1e-9),
    ("slope_degrees", 1, "slope", 1e-9),
)


def risk_drivers(records: DataFrame, top: int = 2) -> DataFrame:
    """Two features farthest above the portfolio median in their risky direction.

    Fewer than two above the median falls back to the two largest regardless.
    """
    names = [n for n, *_ in DRIVERS]
    scored = records.filter(F.col("status") == "scored")
    long = scored.select(*names).unpivot([], names, "feature", "v")
    at = A.values_at(long, "v", {"median": A.linear_position(0.5)}, ["feature"])
    medians = at.agg(
        F.struct(*[F.max(F.when(F.col("feature") == n, F.col("quantile"))).alias(n) for n in names]).alias("_m")
    )
    with_medians = records.withColumn("_m", medians.scalar())
    entries = []
    for i, (name, direction, label, floor) in enumerate(DRIVERS):
        v = F.coalesce(F.col(name), F.lit(0.0))
        median = F.coalesce(F.col(f"_m.{name}"), F.lit(0.0))
        m = F.when(median == 0, F.lit(floor)).otherwise(median)
        if direction > 0:
            score = (v - m) / F.abs(m)
        else:
            score = F.when(v == 0, F.abs(m)).otherwise((m - v) / F.nullif(F.abs(v), F.lit(0.0)))
        entries.append(F.struct((-score).alias("s"), F.lit(i).alias("i"), F.lit(label).alias("label")))
    ranked = F.array_sort(F.array(*entries))
    above = F.filter(ranked, lambda e: e["s"] < 0)
    picked = F.when(F.size(above) >= top, F.slice(above, 1, top)).otherwise(F.slice(ranked, 1, top))
    return with_medians.withColumn("drivers", F.transform(picked, lambda e: e["label"])).drop("_m")
