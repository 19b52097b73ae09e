import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelwise.functions import constants as K
from parcelwise.operators import aggregates as A
from parcelwise.operators import relational as R
from parcelwise.plans import portfolio as P

quick = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@quick
@given(st.lists(st.floats(-1e6, 1e6).map(lambda v: round(v, 3)), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r.prob: r.quantile for r in A.exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-9)


def test_running_total_orders_tiny_and_negative(spark):
    vals = [-5.0, -1e-9, 0.0, 1e-12, 1e-9, 0.5, 3.0, 1e9]
    df = spark.createDataFrame([(v, 1) for v in vals], "v double, n int")
    got = {r.v: r.cum_n for r in A.running_total(df, "v", ["n"]).collect()}
    assert [got[v] for v in vals] == list(range(1, 9))
    down = {r.v: r.cum_n for r in A.running_total(df, "v", ["n"], descending=True).collect()}
    assert [down[v] for v in vals] == list(range(8, 0, -1))


@quick
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=4, max_size=80))
def test_auc_matches_pairs_and_flips(spark, rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    if not pos or not neg:
        return
    df = spark.createDataFrame([(s / 10.0, y) for s, y in rows], "s double, y int")
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    auc = A.auc_gini(df, "s", "y").first().auc
    assert auc == pytest.approx(want) and 0 <= auc <= 1
    flipped = A.auc_gini(df.withColumn("s", 1.0 - F.col("s")), "s", "y").first().auc
    assert flipped == pytest.approx(1 - want)


def test_spearman_matches_pandas(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 20) / 1.0, rng.randint(0, 9) / 1.0) for _ in range(200)]
    pdf = pd.DataFrame(rows, columns=["x", "y"]).rank()
    got = A.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert got.spearman == pytest.approx(pdf["x"].corr(pdf["y"])) and got.n == 200


def test_a_loss_of_exactly_1000_is_in_two_report_buckets(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (1000.0,), (1000.5,)], "expected_annual_loss double")
    rep = {r.bucket: r.n for r in P.loss_histogram(df).collect()}
    assert rep == {"$0": 1, "$0-10": 1, "$10-100": 0, "$100-500": 0, "$500-1000": 1, "$1000+": 2}
    one = {r.bucket: r.n for r in P.portfolio_histogram(df.withColumnRenamed("expected_annual_loss", "annual_risk_usd")).collect()}
    assert one["$1000+"] == 1 and sum(one.values()) == 4


def test_return_periods_clamp(spark):
    curve = spark.createDataFrame([(900.0, 0.002), (500.0, 0.02), (100.0, 0.05)], "loss_amount double, annual_freq_exceed double")
    got = {r.return_period_years: r.loss_amount for r in P.return_period_losses(curve, (10, 50, 100, 1000)).collect()}
    assert got[10] == 100.0 and got[50] == 500.0 and got[1000] == 900.0
    assert got[100] == pytest.approx(np.interp(0.01, [0.002, 0.02, 0.05], [900.0, 500.0, 100.0]))


def test_p95_position_and_tiers(spark):
    rows = [(i, float(i), "scored", False) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "property_id long, annual_risk_usd double, status string, in_perimeter boolean")
    s = P.portfolio_summary(df).first()
    assert s.p95_risk == 20.0 and s.median_risk == 10.5 and s.low_risk_count == 20


def test_mode_and_split(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z"), ("b", "q")], "k string, v string")
    assert {r.k: r.m for r in A.mode_by(df, ["k"], "v", "m").collect()} == {"a": "y", "b": "q"}
    big = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "hot").otherwise("cold"))
    got = R.stratified_split(big, "g", "id", 0.2, 42).groupBy("g").agg(F.count_if("is_val").alias("n")).collect()
    assert {r.g: r.n for r in got} == {"hot": 140, "cold": 60}


def test_upsert_and_guard(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, ver int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k int, v string, ver int")
    assert {r.k: r.v for r in R.upsert_latest(base, new, ["k"], "ver").collect()} == {1: "c", 2: "b", 3: "e"}
    small, n = R.guarded(spark.range(10), 10)
    many, m = R.guarded(spark.range(50), 10)
    assert (small.count(), n, many.count(), m) == (10, 10, 5, 50)


def test_drivers_and_curve_tables():
    assert all(len(s) == len(c) == 29 for _, s, c in K.DEPTH_DAMAGE.values())
    assert sum(len(v) for v in K.FRAGILITY_MEDIANS.values()) == 28


@pytest.mark.parametrize("key", ["k", "name"])
@pytest.mark.parametrize("shape", ["one value", "few values", "distinct"])
def test_edge_deciles_split_ties_by_key(spark, key, shape):
    rng = np.random.default_rng(4)
    n = 500
    rank = {"one value": np.zeros(n), "few values": rng.integers(0, 3, n).astype(float), "distinct": rng.permutation(n).astype(float)}[shape]
    keys, value = rng.permutation(n) * 7 + 1, rng.normal(size=n)
    rows = [(int(k), f"id{k:05d}", float(r), float(v)) for k, r, v in zip(keys, rank, value)]
    df = spark.createDataFrame(rows + [(0, "x", None, 1.0)], "k long, name string, r double, v double")
    order = np.lexsort((keys, rank))
    got = A.edge_decile_means(df, "r", "v", key).first()
    assert got.bottom_mean == pytest.approx(value[order[:50]].mean()) and got.top_mean == pytest.approx(value[order[-50:]].mean())


def test_histogram_buckets_are_even_wherever_values_crowd(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate((rng.uniform(0, 1e-9, 6000), rng.uniform(0, 1, 2000), 0.5 + rng.uniform(0, 1e-7, 4000)))
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    bucket = A.histogram_bucket(df, "v")
    sizes = df.groupBy(bucket(F.col("v")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
    assert len(sizes) > 100 and max(r.n for r in sizes) < 3 * len(values) / len(sizes)
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:]))
    # One value for all rows: ranks come from buckets of the keys.
    tied = spark.range(1, 100_001).select("id", F.lit(0.25).alias("r"), (F.col("id") % 10).cast("double").alias("v"))
    spread = tied.groupBy(A.magnitude_bucket()(F.col("id"))).count().agg(F.max("count")).first()[0]
    assert spread < 100 and A.edge_decile_means(tied, "r", "v", "id").first().bottom_mean == pytest.approx(4.5)
