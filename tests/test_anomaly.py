"""Anomaly status: the reference's cases, plus exact-threshold and grey edge rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import ts
from tierline.operators import anomaly as Z

HISTORY = [30.0, 32.0, 28.0, 35.0, 31.0, 33.0, 29.0, 34.0, 30.0, 32.0]


def gold(spark, values, entity="ERCOT", start=0):
    rows = [(entity, ts(start + i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity string, window_start timestamp, avg_price double")


def test_baseline_count_and_mean(spark):
    b = Z.anomaly_baseline(gold(spark, HISTORY)).collect()[0]
    assert b.n == 10 and b.mean == pytest.approx(31.4) and b.has_baseline


def test_baseline_insufficient_history(spark):
    assert not Z.anomaly_baseline(gold(spark, [30.0, 31.0])).collect()[0].has_baseline


def z_of(spark, value, mean, std):
    df = spark.range(1).select(Z.z_score(F.lit(value), F.lit(mean), F.lit(std)).alias("z"))
    return df.collect()[0].z


def test_z_score(spark):
    assert z_of(spark, 40.0, 30.0, 5.0) == 2.0
    assert z_of(spark, 40.0, 30.0, 0.0) is None


@pytest.mark.parametrize("z,status", [(0.5, "green"), (1.5, "yellow"), (2.5, "red"), (3.5, "critical"),
                                      (-2.5, "red"), (1.0, "yellow"), (2.0, "red"), (3.0, "critical"),
                                      (None, "grey")])
def test_status(spark, z, status):
    df = spark.createDataFrame([(z,)], "z double").select(Z.anomaly_status(F.col("z")).alias("s"))
    assert df.collect()[0].s == status


def scores(spark, values):
    return {r.entity: r for r in Z.anomaly_scores(gold(spark, values)).collect()}


def test_scores_current_is_latest(spark):
    r = scores(spark, HISTORY + [31.0])["ERCOT"]
    assert r.current_price == 31.0 and r.status == "green" and r.n == 11


def test_constant_history_is_grey_std_zero(spark):
    r = scores(spark, [28.9] * 6)["ERCOT"]
    assert r.status == "grey" and r.reason == "std=0" and r.z_score is None


def test_four_points_is_grey_too_little_data(spark):
    r = scores(spark, [1.0, 2.0, 3.0, 4.0])["ERCOT"]
    assert r.status == "grey" and r.reason.startswith("insufficient data")


def test_reason_formats_z(spark):
    r = scores(spark, HISTORY + [40.0])["ERCOT"]
    assert r.reason == f"z_score={r.z_score:.2f}"


def test_empty_gold(spark):
    assert Z.anomaly_scores(gold(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("value,n", [(31.37, 5), (45.23, 6), (99.99, 7), (12345.67, 5), (0.1, 9), (1e7 + 0.01, 8)])
def test_constant_histories_have_no_spread(spark, value, n):
    r = scores(spark, [value] * n)["ERCOT"]
    assert (r.status, r.reason, r.z_score) == ("grey", "std=0", None)


def test_small_spread_at_large_values_does_not_cancel(spark):
    values = [1e7 + 0.005 * (-1) ** i for i in range(20)]
    b = Z.anomaly_baseline(gold(spark, values)).collect()[0]
    assert b.std == pytest.approx(0.00513, abs=1e-5)


def test_null_current_price_has_its_own_reason(spark):
    r = scores(spark, HISTORY + [None])["ERCOT"]
    assert r.status == "grey" and r.reason == "no current price" and r.std > 0
    assert (r.q25, r.q75, r.spread) == (29.25, 32.75, 3.5) or r.spread == pytest.approx(r.q75 - r.q25)


def test_large_and_odd_values_neither_fail_nor_saturate(spark):
    from tierline.functions.numeric import exact_mean, exact_sum, round_half_away

    df = spark.createDataFrame([("big", 1e18), ("big", 5.0), ("big", 6.0), ("one", 1e18), ("fine", 0.123456), ("fine", 0.1),
                                ("nan", float("nan")), ("many", 8e9), ("many", 8e9)] + [("many", 8e9)] * 20 + [("null", None)],
                               "k string, v double")
    got = {r.k: r for r in df.groupBy("k").agg(round_half_away(exact_mean("v")).alias("mean"), exact_sum("v").alias("total"),
                                               round_half_away(F.max("v")).alias("most")).collect()}
    assert got["big"].mean == pytest.approx(1e18 / 3) and got["big"].most == 1e18
    assert got["one"].mean == 1e18
    assert got["fine"].total == pytest.approx(0.223456, abs=1e-12)
    assert got["nan"].mean != got["nan"].mean
    assert got["many"].mean == 8e9
    assert got["null"].mean is None


def test_statistics_against_duckdb_built_ins(spark):
    """Our order-free mean and spread against DuckDB's own AVG and STDDEV_SAMP, within 1e-9 of the value."""
    import random

    import duckdb

    from tierline.functions.numeric import exact_mean, sample_stddev

    rng = random.Random(6)
    data = [(f"k{i % 7}", rng.lognormvariate(3, 2) / 3) for i in range(2000)]
    con = duckdb.connect()
    con.execute("create table t(k varchar, v double)")
    con.executemany("insert into t values (?, ?)", [list(x) for x in data])
    want = {k: (a, s) for k, a, s in con.execute("select k, avg(v), stddev_samp(v) from t group by k").fetchall()}
    df = spark.createDataFrame(data, "k string, v double")
    for r in df.groupBy("k").agg(exact_mean("v").alias("a"), sample_stddev("v").alias("s")).collect():
        assert r.a == pytest.approx(want[r.k][0], rel=1e-9) and r.s == pytest.approx(want[r.k][1], rel=1e-9)
