"""Vulnerability model: training frame, fit, importance, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import scoring as S
from ..operators import aggregates as A
from ..operators import counts
from ..operators import spatial as X
from ..session import cut_lineage
from .portfolio import destruction_log_odds, is_res1

PREDICTORS = ["burn_probability", "distance_to_fuel_m", "canopy_cover_100m", "slope_degrees", "is_res1"]
# fixed values: damage classes of the training label
DESTROYED, UNDAMAGED = "Destroyed (>50%)", "No Damage"


def training_frame(
    inspections: DataFrame, perimeters: DataFrame, structures: DataFrame, cell: float, match_m: float = 100.0,
    min_year: int = 2017, min_acres: float = 1000.0,
) -> DataFrame:
    """Labelled inspections inside large recent perimeters, with the features of
    the nearest structure within ``match_m``; complete cases only.

    Attribute filters run before the spatial join. An inspection in several
    perimeters takes the largest.
    """
    labelled = inspections.filter(F.col("damage").isin(DESTROYED, UNDAMAGED))
    recent = perimeters.filter((F.col("fire_year") >= min_year) & (F.col("gis_acres") > min_acres))
    places = labelled.select(F.struct("oid", "damage", "lng", "lat").alias("_at"), "lng", "lat")
    # The first event name breaks a tie in acres.
    first = F.min(F.struct((-F.col("gis_acres")).alias("_neg"), F.col("event")))
    hits = counts.held_by(places, recent.select("event", "gis_acres", "rings", "x0", "y0", "x1", "y1"), "_at", {"_p": (first, F.min)}, cell)
    one = hits.select("_at.*", "_p.event")
    feats = ["occtype", "burn_probability", "distance_to_fuel_m", "canopy_cover_100m", "slope_degrees"]
    layer = structures.withColumnsRenamed({"lng": "f_lng", "lat": "f_lat"}).select("fd_id", "f_lng", "f_lat", *feats)
    near = X.nearest_within(one, layer, "oid", match_m, "fd_id", feats, geo.HAVERSINE, geo.DEGREE)
    return (
        near.dropna(subset=feats)
        .withColumn("is_res1", is_res1())
        .withColumn("destroyed", (F.col("damage") == DESTROYED).cast("int"))
    )


def fit_logit(train: DataFrame, label: str = "destroyed", predictors: list[str] | None = None):
    """Maximum-likelihood logit with standard errors and p-values (distributed IRLS)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    names = predictors or PREDICTORS
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(train.select(label, *names))
    # The fit reads its input once per iteration.
    vectors = cut_lineage(vectors.select(label, "features"))
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol=label, maxIter=200, tol=1e-10)
    return glm.fit(vectors)


def coefficient_table(model, train: DataFrame, predictors: list[str] | None = None) -> DataFrame:
    """β, standard error, z, p and the standardised importance β·σ, ranked."""
    names = predictors or PREDICTORS
    s = model.summary
    rows = [
        (n, float(b), float(e), float(t), float(p))
        for n, b, e, t, p in zip(
            [*names, "const"],
            [*model.coefficients, model.intercept],
            s.coefficientStandardErrors,
            s.tValues,
            s.pValues,
        )
    ]
    spark = train.sparkSession
    table = spark.createDataFrame(rows, "feature string, coef double, std_error double, z double, p_value double")
    sigma = train.agg(*[F.stddev_samp(n).alias(n) for n in names]).unpivot([], names, "feature", "feature_sd")
    return importance(table, sigma)


def importance(coefficients: DataFrame, sigma: DataFrame) -> DataFrame:
    joined = coefficients.join(sigma, "feature", "left")
    return joined.withColumn("standardized", F.col("coef") * F.col("feature_sd")).orderBy(
        F.desc_nulls_last(F.abs("standardized"))
    )


def apply_model(df: DataFrame, coefficients: dict[str, float], threshold: float) -> DataFrame:
    """Probability, log-odds and threshold flag; null when a predictor is missing."""
    scored = df.withColumn("log_odds", destruction_log_odds(coefficients))
    return scored.withColumn("p_destroyed", S.logistic("log_odds")).withColumn(
        "exceeds", F.col("p_destroyed") >= threshold
    )


def calibration_deciles(scored: DataFrame, score: str, label: str) -> DataFrame:
    binned = A.quantile_bins(scored, score)
    return binned.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("pred_mean"),
        F.avg(label).alias("obs_mean"),
        F.min(score).alias("pred_min"),
        F.max(score).alias("pred_max"),
    )


def cohort_table(frame: DataFrame, event: str = "event", label: str = "destroyed") -> DataFrame:
    return frame.groupBy(event).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_destroyed"), F.avg(label).alias("destroyed_rate")
    )
