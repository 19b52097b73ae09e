"""Registered queries against their SQL twins on the smallest data."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from tools.check_oracle import TABLES, ordered  # noqa: E402
from workloads import registry  # noqa: E402


@pytest.fixture(scope="module")
def con(data_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return c


def test_contract_shape():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    own, twins = registry.collect("QUERIES"), registry.collect("ORACLES")
    assert set(own) <= set(queries) and len(own) >= 130
    # The whole score over circles; its parts have twins.
    assert set(own) - set(twins) <= {"trade_area_score"}


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.collect("ORACLES")))
def test_query_equals_sql(spark, con, data_dir, name):
    df = contract.queries()[name](spark, data_dir)
    cur = con.execute(contract.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(cols, cur.fetchall())


def test_guarded_result_reads_all_orders_in_both_cases(spark, data_dir):
    got = contract.queries()["guarded_result"](spark, data_dir).collect()[0]
    orders = spark.read.parquet(f"{data_dir}/orders.parquet")
    n, last = orders.agg(F.count(F.lit(1)), F.max("o_orderkey")).first()
    assert (got.orders_small, got.last_small, got.n_large, got.rows_large) == (n, last, n, 5)
    assert got.rows_small == got.n_small == orders.select("o_orderstatus", "o_orderpriority").distinct().count()


def test_probe_nearest_adds_up_repeated_sites(spark, data_dir, folder):
    """A key on two rows counts the points of both, on each of its rows."""
    for t in ("customer", "part"):
        df = spark.read.parquet(f"{data_dir}/{t}.parquet")
        (df.unionByName(df.limit(40)) if t == "customer" else df).write.parquet(f"{folder}/{t}.parquet")
    run = contract.queries()["probe_nearest"]
    once = {(r.loc_id, r.layer): (r.n, r.nearest_m) for r in run(spark, data_dir).collect()}
    twice = run(spark, folder).collect()
    seen = {}
    for r in twice:
        seen.setdefault((r.loc_id, r.layer), []).append((r.n, r.nearest_m))
    assert len(twice) == len(once) + 40 * len({r.layer for r in twice})
    assert all(v == [(once[k][0] * len(v), once[k][1])] * len(v) for k, v in seen.items())
