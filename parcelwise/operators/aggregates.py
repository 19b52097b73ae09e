"""Aggregates that stay distributed: no global window over rows, no per-group
collection, no value map held in one task.

Running totals, ranks and exact quantiles share one shape: aggregate per distinct
value, sum per order-preserving bucket, offset each bucket by the buckets before
it, then finish with a window inside the bucket.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K


def magnitude_bucket(per_octave: int = 1024) -> Callable[[Column], Column]:
    """Order-preserving buckets of constant relative width.

    Twenty octaves of data make about 20 000 buckets, whatever the row count.
    """

    def bucket(v: Column) -> Column:
        size = F.floor((F.log2(F.abs(v)) + 1100.0) * per_octave).cast("long") + 1
        return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * size)

    return bucket


#: Buckets of a histogram: one window each.
PARTS = 128


def histogram_bucket(df: DataFrame, value: str, parts: int = PARTS) -> Callable[[Column], Column]:
    """Order-preserving buckets that hold about equally many rows of ``df``, wherever its values crowd."""
    edges = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(edges)))) if edges else F.array().cast("array<double>")

    def bucket(v: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b < v)).cast("long")

    return bucket


def text_bucket(v: Column) -> Column:
    """Order-preserving buckets of texts: their first three bytes."""
    return F.conv(F.rpad(F.hex(F.substring(v.cast("binary"), 1, 3)), 6, "0"), 16, 10).cast("long")


def running_total(
    levels: DataFrame,
    order: str,
    values: list[str],
    keys: list[str] | None = None,
    descending: bool = False,
    bucket: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<v>`` and grand totals ``total_<v>``.

    ``levels`` has one row per (keys, order) value.
    """
    keys = keys or []
    bucket = bucket or magnitude_bucket()
    with_bucket = levels.withColumn("_b", bucket(F.col(order)))
    direction = F.desc if descending else F.asc
    per_bucket = with_bucket.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = W.partitionBy(*keys).orderBy(direction("_b")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_bucket
    for v in values:
        offsets = offsets.withColumn(f"_off_{v}", F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0))).withColumn(
            f"total_{v}", F.sum(f"_t_{v}").over(whole)
        )
    offsets = offsets.drop(*[f"_t_{v}" for v in values])
    inside = W.partitionBy(*keys, "_b").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    out = with_bucket.join(offsets, [*keys, "_b"])
    for v in values:
        out = out.withColumn(f"cum_{v}", F.col(f"_off_{v}") + F.sum(v).over(inside))
    return out.drop("_b", *[f"_off_{v}" for v in values])


Position = Callable[[Column], Column]


def values_at(
    df: DataFrame, value: str, positions: dict[str, Position], keys: list[str] | None = None, bucket=None
) -> DataFrame:
    """Values at 0-based ascending positions, fractional ones interpolated.

    Each position is a function of the row count. One row per (keys, name), with
    ``quantile``; all positions share one pass.
    """
    keys = keys or []
    levels = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    cum = running_total(levels, value, ["n"], keys, bucket=bucket)
    wanted = F.array(
        *[F.struct(F.lit(n).alias("name"), f(F.col("total_n")).cast("double").alias("pos")) for n, f in positions.items()]
    )
    at = (
        cum.withColumn("_q", F.explode(wanted))
        .select("*", "_q.*")
        .withColumn("_lo", F.floor("pos"))
        .withColumn("_hi", F.ceil("pos"))
    )
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    holds_lo = F.col("_lo").between(first, last)
    holds_hi = F.col("_hi").between(first, last)
    picked = at.filter(holds_lo | holds_hi).groupBy(*keys, "name").agg(
        F.max(F.when(holds_lo, F.col(value))).alias("_a"),
        F.max(F.when(holds_hi, F.col(value))).alias("_z"),
        F.max(F.col("pos") - F.col("_lo")).alias("_w"),
    )
    return picked.select(*keys, "name", (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_w")).alias("quantile"))


def linear_position(prob: float) -> Position:
    return lambda n: (n - 1) * float(prob)


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None, bucket=None
) -> DataFrame:
    """Linear-interpolated quantiles, one row per (keys, prob) with ``quantile``."""
    at = values_at(df, value, {str(float(p)): linear_position(p) for p in probs}, keys, bucket)
    return at.withColumn("prob", F.col("name").cast("double")).drop("name")


def pivot_values(at: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    picks = [F.max(F.when(F.col("name") == n, F.col("quantile"))).alias(n) for n in names]
    return at.groupBy(*keys).agg(*picks) if keys else at.agg(*picks)


def quantile_columns(
    df: DataFrame, value: str, names: dict[str, float], keys: list[str] | None = None, bucket=None
) -> DataFrame:
    """Quantiles with one column per named probability."""
    at = values_at(df, value, {n: linear_position(p) for n, p in names.items()}, keys, bucket)
    return pivot_values(at, list(names), keys)


def average_ranks(df: DataFrame, value: str, name: str, bucket=None) -> DataFrame:
    """One row per distinct value with its tie-averaged ascending rank."""
    levels = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    cum = running_total(levels, value, ["n"], bucket=bucket)
    return cum.select(value, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias(name))


def spearman(df: DataFrame, x: str, y: str, bucket=None) -> DataFrame:
    """Rank correlation; identical (x, y) rows are collapsed to one weighted row."""
    pairs = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("_w"))
    )
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.join(average_ranks(rows, x, "_rx", bucket), x).join(average_ranks(rows, y, "_ry", bucket), y)
    s = ranked.agg(
        F.sum("_w").alias("n"),
        F.sum(F.col("_w") * F.col("_rx")).alias("sx"),
        F.sum(F.col("_w") * F.col("_ry")).alias("sy"),
        F.sum(F.col("_w") * F.col("_rx") * F.col("_rx")).alias("sxx"),
        F.sum(F.col("_w") * F.col("_ry") * F.col("_ry")).alias("syy"),
        F.sum(F.col("_w") * F.col("_rx") * F.col("_ry")).alias("sxy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    rho = F.try_divide(cov, F.sqrt(vx * vy))
    return s.select(F.col("n").cast("long").alias("n"), rho.alias("spearman"))


def edge_decile_means(df: DataFrame, rank_by: str, value: str, key: str, bucket=None) -> DataFrame:
    """Means of ``value`` in the lowest and highest n//10 rows (at least one).

    Rows tied on ``rank_by`` at an edge are split by ``key``. Values wholly on one side need no
    ranks; the at most two values that an edge cuts are ranked in buckets of their keys, so one
    value for all rows is no more work for a task than any other.
    """
    rows = df.filter(F.col(rank_by).isNotNull())
    levels = rows.groupBy(rank_by).agg(F.count(F.lit(1)).alias("n"))
    cum = running_total(levels, rank_by, ["n"], bucket=bucket).select(
        rank_by, (F.col("cum_n") - F.col("n")).alias("_before"), F.col("cum_n").alias("_after"), F.col("total_n").alias("_total")
    )
    take = F.greatest(F.lit(1), F.floor(F.col("_total") / 10))
    low_end, high_start = take, F.col("_total") - take
    edge = cum.withColumns({
        "_low": F.col("_after") <= low_end, "_high": F.col("_before") >= high_start,
        "_cut": ((F.col("_before") < low_end) & (F.col("_after") > low_end)) | ((F.col("_before") < high_start) & (F.col("_after") > high_start)),
    }).filter(F.col("_low") | F.col("_high") | F.col("_cut"))
    slim = rows.select(rank_by, key, value).join(edge, rank_by)
    whole = slim.filter(~F.col("_cut")).select(value, F.col("_low"), F.col("_high"))
    cut = slim.filter("_cut")
    numbers = dict(df.dtypes)[key] not in ("string", "binary")
    ranks = running_total(cut.groupBy(rank_by, key).agg(F.count(F.lit(1)).alias("n")), key, ["n"], [rank_by], bucket=None if numbers else text_bucket)
    place = F.col("_before") + F.col("cum_n") - 1
    ranked = cut.join(ranks.select(rank_by, key, "cum_n"), [rank_by, key]).select(value, (place < low_end).alias("_low"), (place >= high_start).alias("_high"))
    return whole.unionByName(ranked).agg(
        F.avg(F.when(F.col("_low"), F.col(value))).alias("bottom_mean"), F.avg(F.when(F.col("_high"), F.col(value))).alias("top_mean")
    )


def mode_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value per key, the smallest on ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col(value))).alias("_m")).select(
        *keys, F.col(f"_m.{value}").alias(name)
    )


def circular_mean(slope: Column, aspect: Column) -> Column:
    """Slope-weighted mean aspect in degrees; null when the vectors cancel."""
    x = F.sum(slope * F.sin(F.radians(aspect)))
    y = F.sum(slope * F.cos(F.radians(aspect)))
    return F.when(F.hypot(x, y) > 1e-9, F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0)))


def exclusive_bucket(value: Column) -> Column:
    """Loss bucket label, first match wins; the buckets do not overlap."""
    out = F.when(value == 0, K.LOSS_BUCKETS[0][0])
    for label, lo, hi in K.LOSS_BUCKETS[1:]:
        inside = value > lo if hi is None else (value > lo) & (value <= hi)
        out = out.when(inside, label)
    return out.otherwise(K.LOSS_BUCKETS[-1][0])


def overlapping_buckets(value: Column) -> Column:
    """All report buckets of a value: the open-ended last one starts at its bound,
    so a loss of exactly 1000 is in two."""
    labels = []
    for label, lo, hi in K.LOSS_BUCKETS:
        if hi is None:
            inside = value >= lo
        elif hi == lo:
            inside = value == lo
        else:
            inside = (value > lo) & (value <= hi)
        labels.append(F.when(inside, label))
    return F.array_compact(F.array(*labels))


def bucket_counts(df: DataFrame, labels: Column, value: str) -> DataFrame:
    """Rows per label including empty buckets, in report order."""
    spark = df.sparkSession
    frame = spark.createDataFrame(
        [(i, label) for i, (label, _, _) in enumerate(K.LOSS_BUCKETS)], "bucket_order int, bucket string"
    )
    grouped = (
        df.select(F.explode(labels).alias("bucket"), F.col(value).alias("_v"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("bucket_total"))
    )
    return frame.join(grouped, "bucket", "left").select(
        "bucket_order",
        "bucket",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.coalesce("bucket_total", F.lit(0.0)).alias("bucket_total"),
    )


# ── classifier scores ───────────────────────────────────────────────────────
def score_levels(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score with running sums from the top."""
    levels = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    return running_total(levels, score, ["pos", "neg"], descending=True, bucket=histogram_bucket(levels, score))


def auc_gini(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact AUC with half credit for ties."""
    lv = score_levels(df, score, label)
    wins = F.sum(F.col("pos") * (F.col("total_neg") - F.col("cum_neg") + F.col("neg") / 2.0))
    out = lv.agg(wins.alias("_wins"), F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"))
    auc = F.try_divide(F.col("_wins"), F.col("n_pos") * F.col("n_neg"))
    return out.select("n_pos", "n_neg", auc.alias("auc"), (auc * 2.0 - 1.0).alias("gini"))


def youden(df: DataFrame, score: str, label: str) -> DataFrame:
    """Threshold with the largest tpr − fpr (highest score on ties) and its confusion."""
    lv = score_levels(df, score, label)
    j = F.col("cum_pos") / F.col("total_pos") - F.col("cum_neg") / F.col("total_neg")
    best = lv.agg(
        F.max(F.struct(F.round(j, 12).alias("j"), F.col(score), "cum_pos", "cum_neg", "total_pos", "total_neg")).alias("b")
    ).select("b.*")
    return best.select(
        F.col(score).alias("threshold"),
        F.col("j").alias("youden_j"),
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        (F.col("total_pos") - F.col("cum_pos")).alias("fn"),
        (F.col("total_neg") - F.col("cum_neg")).alias("tn"),
    )


def quantile_bins(df: DataFrame, score: str, name: str = "decile", bins: int = 10) -> DataFrame:
    """Bin number from the distinct quantile edges, as many as differ."""
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(df, score, probs, bucket=histogram_bucket(df, score))
    inner = edges.agg(F.array_sort(F.collect_set("quantile")).alias("_e")).select(
        F.expr("slice(_e, 2, greatest(size(_e) - 2, 0))").alias("_e")
    )
    joined = df.withColumn("_e", inner.scalar())
    passed = F.size(F.filter("_e", lambda e: e <= F.col(score)))
    return joined.withColumn(name, passed + 1).drop("_e")
