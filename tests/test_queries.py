"""Every registered query against its DuckDB oracle on the sf0.001 tables,
and the driver contract of ``__spark_entry__``."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tierline.sources.tables import TABLES, table_path

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        try:
            v = v.replace(tzinfo=None)
        except TypeError:
            pass
        return v.isoformat()
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["entity", "window_start", "window_end"]


def test_every_query_has_a_callable():
    assert len(QUERIES) >= 70
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert len(srows) > 0
        return
    cur = duck.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    sc, s = _rows(df.columns, srows)
    oc, o = _rows(ocols, cur.fetchall())
    assert sc == oc
    assert s == o


def test_results_do_not_depend_on_python_time_zone(spark, duck):
    """Timestamps are handed out as UTC wall-clock, whatever the reader's zone."""
    import os
    import time

    old = os.environ.get("TZ")
    os.environ["TZ"] = "America/New_York"
    time.tzset()
    try:
        df = QUERIES["latest_rows"](spark, SF_SMALL)
        sc, s = _rows(df.columns, [tuple(r) for r in df.collect()])
        cur = duck.execute(ORACLE["latest_rows"])
        oc, o = _rows([d[0] for d in cur.description], cur.fetchall())
        assert sc == oc and s == o
    finally:
        if old is None:
            os.environ.pop("TZ", None)
        else:
            os.environ["TZ"] = old
        time.tzset()


# Queries that run streams or writes while being defined; their read-back has no joins.
_EAGER = {"stream_gold", "stream_late_rows", "stream_dedup", "stream_gold_join", "stream_medallion",
          "stream_two_feeds", "archive_export", "archive_listing", "archive_contents", "land_prices_json", "land_mix_csv",
          "evolve_schema_files", "retention_rewrite"}


def test_no_query_plans_a_nested_loop_or_cartesian_join(spark):
    """With broadcast joins off (the at-scale plan), every join is an equi-join."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bad = []
        for name in sorted(set(QUERIES) - _EAGER):
            plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            if "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan:
                bad.append(name)
        assert bad == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_gold_and_baseline_against_plain_duckdb(spark, duck):
    """An independent form: DuckDB's own AVG and STDDEV_SAMP, none of the package's formulas."""
    got = {(r.entity, r.window_start): r for r in QUERIES["gold_summary"](spark, SF_SMALL).collect()}
    plain = duck.execute("""SELECT event_type, date_trunc('hour', ts), AVG(value), MAX(value), MIN(value)
                            FROM events GROUP BY 1, 2""").fetchall()
    assert len(plain) == len(got)
    for entity, start, avg, high, low in plain:
        r = got[entity, start]
        # rounded to 2 decimals: half a cent, and the double's own error
        for mine, theirs in ((r.avg_price, avg), (r.max_price, high), (r.min_price, low)):
            assert abs(mine - theirs) <= 0.005 + 1e-9 * abs(theirs)
    prices: dict[str, list[float]] = {}
    for (entity, _), r in got.items():
        prices.setdefault(entity, []).append(r.avg_price)
    base = {r.entity: r for r in QUERIES["anomaly_baseline"](spark, SF_SMALL).collect()}
    for entity, values in prices.items():
        std, mean = duck.execute("SELECT STDDEV_SAMP(v), AVG(v) FROM (SELECT unnest(?) AS v)", [values]).fetchone()
        assert abs(base[entity].std - std) <= 1e-5 and abs(base[entity].mean - mean) <= 1e-5
