"""Regional weight calibration.

Rows of the score matrix are (region, kind, id, scores, mask); weights are eight
numbers per region. Each step is one grouped aggregate over the whole matrix for
all regions at once; only the per-region sums (region count × 3·k numbers) reach
the driver, where the weights are moved and projected back onto their bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import spatial as X
from ..session import cut_lineage
from ..sources import catalog

HIGH, SOFTNESS, MIN_POSITIVES = 0.70, 0.03, 20
# The finest lattice has 2^(rounds - 1) times the first one's points per axis.
LATTICE_ROUNDS = 8
CRITERIA = sorted(c for c in catalog.default_weights(catalog.SOLAR) if c != "excl_flood")
_SPEC = {c.criterion_id: c for c in catalog.criteria_for(catalog.SOLAR)}
LOW = np.array([_SPEC[c].low for c in CRITERIA])
TOP = np.array([_SPEC[c].high for c in CRITERIA])
START = np.array([_SPEC[c].weight for c in CRITERIA])


def masked_composite(scores: str, mask: str, weights: str) -> Column:
    """Σ s·w·m / Σ w·m over array columns; 0 when nothing is measured."""
    used = F.zip_with(mask, weights, lambda m, w: m * w)
    total = F.aggregate(used, F.lit(0.0), lambda a, b: a + b)
    num = F.aggregate(F.zip_with(scores, used, lambda s, u: F.coalesce(s, F.lit(0.0)) * u), F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 1e-9, num / F.nullif(total, F.lit(0.0))).otherwise(0.0)


def score_matrix(long: DataFrame, key: list[str]) -> DataFrame:
    """Pivot (key…, criterion_id, score) into aligned score and mask arrays."""
    picks = [F.max(F.when(F.col("criterion_id") == c, F.col("score"))).alias(c) for c in CRITERIA]
    wide = long.groupBy(*key).agg(*picks)
    return wide.select(
        *key,
        F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in CRITERIA]).alias("scores"),
        F.array(*[F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0) for c in CRITERIA]).alias("mask"),
    )


def random_points(regions: DataFrame, region: str, n: int, seed: int, per_axis: int, cell: float) -> DataFrame:
    """n repeatable points per region: a jittered lattice over each polygon's box,
    kept where it falls inside, first n in hash order.

    A region whose lattice leaves fewer than n points gets one twice as fine, until
    it has n; a thin polygon takes more rounds. One without area is an error.
    """
    parts: list[DataFrame] = []
    todo = regions
    for _ in range(LATTICE_ROUNDS):
        inside = cut_lineage(_lattice_inside(todo, region, seed, per_axis, cell))
        enough = cut_lineage(inside.groupBy(region).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(region))
        parts.append(inside.join(enough, region, "left_semi"))
        todo = cut_lineage(todo.join(enough, region, "left_anti"))
        if todo.isEmpty():
            break
        per_axis *= 2
    else:
        raise ValueError(f"a region has no area to hold {n} points")
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return X.top_k_per_key(every, [region], [F.col("_h"), F.col("_pid"), F.col("_k")], n).select(
        region, F.col("rank").alias("point_no"), "lng", "lat"
    )


def _lattice_inside(regions: DataFrame, region: str, seed: int, per_axis: int, cell: float) -> DataFrame:
    axis = F.sequence(F.lit(0), F.lit(per_axis - 1))
    corner = F.floor((F.col("x0") + 180.0) * 1e3).cast("long") * 360_001 + F.floor((F.col("y0") + 90.0) * 1e3).cast("long")
    grid = regions.withColumn("_pid", corner).withColumn("_i", F.explode(axis)).withColumn("_j", F.explode(axis))
    jx = R.arithmetic_hash(F.pmod(F.col("_pid"), F.lit(9973)) * 4099 + F.col("_i") * 61 + F.col("_j"), seed) / 1_000_003.0
    jy = R.arithmetic_hash(F.pmod(F.col("_pid"), F.lit(9967)) * 4093 + F.col("_j") * 67 + F.col("_i"), seed + 1) / 1_000_003.0
    pts = grid.select(
        F.col(region).alias("_own"),
        (F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("_i") + jx) / float(per_axis)).alias("lng"),
        (F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("_j") + jy) / float(per_axis)).alias("lat"),
        (F.col("_i") * per_axis + F.col("_j")).alias("_k"),
        "_pid",
    )
    inside = X.points_in_polygons(pts, regions.select(region, "rings", "x0", "y0", "x1", "y1"), cell).filter(F.col(region) == F.col("_own"))
    return inside.withColumn("_h", R.arithmetic_hash(F.pmod(F.col("_pid"), F.lit(9949)) * 4001 + F.col("_k"), seed + 2))


def project(w: np.ndarray, low: np.ndarray = LOW, top: np.ndarray = TOP) -> np.ndarray:
    """Nearest feasible weights: inside the bounds and summing to one.

    Shifting every weight by one amount and clipping is monotone in the shift,
    so bisection finds the sum.
    """
    a, b = float((low - w).min()), float((top - w).max())
    for _ in range(200):
        mid = (a + b) / 2.0
        if np.clip(w + mid, low, top).sum() < 1.0:
            a = mid
        else:
            b = mid
    return np.clip(w + b, low, top)


def _objective_terms(matrix: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, dict[str, np.ndarray]]:
    """Per (region, kind): count, mean composite, mean sigmoid, and both gradients."""
    spark = matrix.sparkSession
    table = spark.createDataFrame([(r, [float(x) for x in w]) for r, w in weights.items()], "region string, w array<double>")
    comp = matrix.join(F.broadcast(table), "region")
    comp = comp.withColumn("_m", F.aggregate(F.zip_with("mask", "w", lambda m, w: m * w), F.lit(0.0), lambda a, b: a + b))
    comp = comp.withColumn("_c", masked_composite("scores", "mask", "w"))
    soft = F.lit(1.0) / (F.exp(-(F.col("_c") - HIGH) / SOFTNESS) + 1.0)
    comp = comp.withColumn("_s", soft)
    slope = F.col("_s") * (1.0 - F.col("_s")) / SOFTNESS + 1.0
    per = [
        F.avg(
            F.when(F.col("_m") > 1e-9, slope * F.col("mask")[i] * (F.coalesce(F.col("scores")[i], F.lit(0.0)) - F.col("_c")) / F.nullif(F.col("_m"), F.lit(0.0))).otherwise(0.0)
        ).alias(f"g{i}")
        for i in range(len(CRITERIA))
    ]
    rows = comp.groupBy("region", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("_c").alias("c"), F.avg("_s").alias("s"), *per).collect()
    out: dict[str, dict[str, np.ndarray]] = {}
    for r in rows:
        out.setdefault(r["region"], {})[r["kind"]] = np.array(
            [r["n"], r["c"], r["s"], *[r[f"g{i}"] for i in range(len(CRITERIA))]]
        )
    return out


#: Longest step of one weight.
WIDEST_STEP = 0.2


def _gap(terms: dict[str, np.ndarray]) -> tuple[float, np.ndarray]:
    diff = terms["site"] - terms["random"]
    return float(diff[1] + diff[2]), diff[3:]


def calibrate_weights(matrix: DataFrame, rate: float = 0.02, tolerance: float = 1e-9, most_steps: int = 500) -> dict[str, dict]:
    """Projected gradient ascent on soft high-rate gap + mean gap, per region.

    A region is done when an accepted step gains less than ``tolerance`` or its step has
    shrunk below ``tolerance``'s root; ``converged`` says so. A region with fewer than 20 sites or no
    random points keeps the defaults. The matrix is read once per step, so it is
    checkpointed first. Only improving steps are kept, so the objective never drops below the start.
    """
    matrix = cut_lineage(matrix.select("region", "kind", "scores", "mask"))
    counts = matrix.groupBy("region", "kind").agg(F.count(F.lit(1)).alias("n")).collect()
    n: dict[str, dict[str, int]] = {}
    for r in counts:
        n.setdefault(r["region"], {})[r["kind"]] = r["n"]
    fit = [r for r, c in n.items() if c.get("site", 0) >= MIN_POSITIVES and c.get("random", 0) > 0]
    best = {r: START.copy() for r in n}
    grads: dict[str, np.ndarray] = {}
    result = {
        r: {"method": "constrained_optimization" if r in fit else "literature_default", "start": None, "value": None} for r in n
    }
    if fit:
        trial, rates = {r: project(START) for r in fit}, {r: rate for r in fit}
        moving = list(fit)
        for _ in range(most_steps):
            terms = _objective_terms(matrix.filter(F.col("region").isin(moving)), {r: trial[r] for r in moving})
            for r in moving:
                value, grad = _gap(terms[r])
                last = result[r]["value"]
                if last is None or value > last:
                    if last is None:
                        result[r]["start"] = value
                    elif value - last < tolerance:
                        result[r]["converged"] = True
                    if last is not None:
                        rates[r] = min(rates[r] * 1.6, WIDEST_STEP)
                    result[r]["value"], best[r], grads[r] = value, trial[r], grad
                else:
                    rates[r] /= 3.0
                    result[r]["converged"] = rates[r] < tolerance**0.5
                g = grads[r] / max(float(np.abs(grads[r]).max()), 1e-12)
                trial[r] = project(best[r] + rates[r] * g)
            moving = [r for r in moving if not result[r].get("converged")]
            if not moving:
                break
    for r in n:
        result[r]["weights"] = {c: float(v) for c, v in zip(CRITERIA, best[r])}
        result[r]["residual"] = _residual(best[r], grads[r]) if r in fit else None
    return result


def _residual(weights: np.ndarray, gradient: np.ndarray, step: float = 1e-6) -> float:
    """How far a small step along the gradient moves feasible weights, per unit: 0 at a constrained optimum."""
    g = gradient / max(float(np.abs(gradient).max()), 1e-12)
    return float(np.abs(project(weights + step * g) - weights).max() / step)


def profile_table(spark, calibrated: dict[str, dict]) -> DataFrame:
    """Weights per region with the objective before and after, whether the search ended by itself, and the optimality residual."""
    rows = [(r, p["method"], p["weights"], p["start"], p["value"], p.get("converged"), p["residual"]) for r, p in calibrated.items()]
    return spark.createDataFrame(
        rows, "region string, method string, weights map<string,double>, start_value double, value double, converged boolean, residual double"
    )


def weight_changes(profiles: DataFrame, separation: DataFrame | None = None, least: float = 0.005) -> DataFrame:
    """Criteria whose weight moved by at least ``least``."""
    base = F.create_map(*[F.lit(x) for c, w in zip(CRITERIA, START) for x in (c, float(w))])
    long = profiles.select("region", F.explode("weights").alias("criterion_id", "weight"))
    out = long.withColumn("default_weight", base[F.col("criterion_id")]).withColumn(
        "delta", F.col("weight") - F.col("default_weight")
    )
    out = out.filter(F.abs("delta") >= least)
    return out.join(separation, ["region", "criterion_id"], "left") if separation is not None else out


def criterion_separation(long: DataFrame) -> DataFrame:
    """Mean score of sites minus random points per region and criterion."""
    site, rnd = F.col("kind") == "site", F.col("kind") == "random"
    return long.filter(F.col("score").isNotNull()).groupBy("region", "criterion_id").agg(
        (F.avg(F.when(site, F.col("score"))) - F.avg(F.when(rnd, F.col("score")))).alias("separation")
    )


def profile_checks(profiles: DataFrame) -> DataFrame:
    """Σ weights and bound violations per region."""
    low = F.create_map(*[F.lit(x) for c, v in zip(CRITERIA, LOW) for x in (c, float(v))])
    top = F.create_map(*[F.lit(x) for c, v in zip(CRITERIA, TOP) for x in (c, float(v))])
    long = profiles.select("region", "method", F.explode("weights").alias("criterion_id", "weight"))
    w, c = F.col("weight"), F.col("criterion_id")
    outside = (w < low[c] - 1e-9) | (w > top[c] + 1e-9)
    return long.groupBy("region", "method").agg(F.sum("weight").alias("total"), F.count_if(outside).alias("out_of_bounds"))
