"""Late-row ledger, isolated landing, layer totals, zone clocks, observed failures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tierline.functions.time import zone_transitions
from tierline.operators import health as H
from tierline.operators import normalize as N
from tierline.operators import snapshot as SN
from tierline.settings import DEFAULT_MIX
from tierline.sources import landing as L
from tierline.streaming import feeds as ST

SCHEMA = "entity string, interval_start timestamp, price double"


def prices(spark, rows):
    return (spark.createDataFrame(rows, "entity string, at string, price double")
            .select("entity", F.col("at").cast("timestamp").alias("interval_start"), "price"))


def accounts(spark, base, batches):
    rows = batches[0]
    for b in batches[1:]:
        rows = rows.unionByName(b)
    return {r["entity"]: (r["landed"], r["emitted"], r["late"], r["open"]) for r in ST.row_accounts(spark, rows, base).collect()}


def test_ledger_accounts_for_every_row_and_replays(spark, tmp_dir):
    first = prices(spark, [("a", "2026-01-01 00:10:00", 1.0), ("a", "2026-01-01 00:50:00", 3.0), ("b", "2026-01-01 02:30:00", 5.0)])
    second = prices(spark, [("a", "2026-01-01 00:30:00", 9.0),       # its hour closed: watermark 01:30
                            ("a", "2026-01-01 01:40:00", 7.0),       # behind the newest row, inside the delay
                            ("a", None, 1.0), (None, "2026-01-01 04:30:00", 2.0)])
    body = ST.LateLedgerBatch(tmp_dir, "1 HOUR")
    body(first, 0)
    assert accounts(spark, tmp_dir, [first]) == {"a": (2, 2, 0, 0), "b": (1, 0, 0, 1)}
    body(second, 1)
    want = {"a": (5, 3, 2, 0), "b": (1, 1, 0, 0), None: (1, 0, 0, 1)}
    assert accounts(spark, tmp_dir, [first, second]) == want
    gold = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_dir}/gold").select("entity", "avg_price", "rows").collect())
    assert gold() == [("a", 2.0, 2), ("a", 7.0, 1), ("b", 5.0, 1)]
    body(second, 1)                                                  # a replayed batch replaces its own output
    assert accounts(spark, tmp_dir, [first, second]) == want
    assert gold() == [("a", 2.0, 2), ("a", 7.0, 1), ("b", 5.0, 1)]
    reasons = sorted(r["late_reason"] for r in spark.read.parquet(f"{tmp_dir}/late").collect())
    assert reasons == ["closed hour", "no time"]
    body(prices(spark, []), 2)                                       # an empty batch closes nothing and loses nothing
    body(prices(spark, [("b", "2026-01-01 06:00:00", 4.0)]), 3)
    assert accounts(spark, tmp_dir, [first, second])[None] == (1, 1, 0, 0)


def test_isolated_landing_names_bad_and_empty_files(spark, tmp_dir):
    good = prices(spark, [("x y", "2026-01-01 00:00:00", 1.0), ("b", "2026-01-01 00:00:00", 2.0)])
    good.withColumn("source", F.col("entity")).repartition("source").write.partitionBy("source").parquet(tmp_dir)
    spark.range(1).select(F.lit("junk").alias("value")).coalesce(1).write.text(f"{tmp_dir}/source=bad")
    spark.range(1).select(F.lit("junk").alias("value")).coalesce(1).write.mode("append").text(f"{tmp_dir}/source=b")
    rows, ledger = L.read_isolated(spark, tmp_dir, good.schema)
    assert sorted(r["price"] for r in rows.collect()) == [1.0, 2.0]
    got = {r["source"]: (r["files"], r["files_read"], r["rows"], len(r["skipped"])) for r in ledger.collect()}
    assert got["bad"] == (1, 0, 0, 1) and got["b"] == (2, 1, 1, 1)
    assert [v for k, v in got.items() if k not in ("bad", "b")] == [(1, 1, 1, 0)]
    assert all(name.endswith(".txt") for r in ledger.collect() for name in r["skipped"])


def test_layer_totals_and_status(spark):
    some, none = spark.range(3), spark.range(0)
    totals = H.layer_totals({("bronze", "p"): some, ("bronze", "m"): none, ("silver", "p"): none, ("gold", "g"): some})
    got = {(r["layer"], r["table"]): r["rows"] for r in totals.collect()}
    assert got[("bronze", None)] == 3 and got[("silver", None)] == 0 and got[(None, None)] == 6 and got[("bronze", "m")] == 0
    row = H.layer_status(totals, ["bronze", "silver", "gold"]).first()
    assert row["status"] == "warning" and row["message"].endswith("silver") and "bronze" not in row["message"]
    full = H.layer_totals({("bronze", "p"): some, ("bronze", "m"): none, ("gold", "g"): some})     # an empty table in a filled layer
    assert H.layer_status(full, ["bronze", "gold"]).first()["status"] == "ok"


@pytest.mark.parametrize("zone", ["America/St_Johns", "Australia/Lord_Howe", "Asia/Kolkata", "Africa/Casablanca", "UTC"])
def test_zone_transitions_agree_with_the_database(zone):
    from zoneinfo import ZoneInfo

    rows = zone_transitions([zone], 2022, 2025)
    assert rows[0][1] == 1640995200 and rows[-1][2] == 1767225600
    assert all(a[2] == b[1] and a[3:] != b[3:] for a, b in zip(rows, rows[1:]))
    for _, start, end, offset, abbr in rows:
        for at in (start, (start + end) // 2, end - 1):
            local = dt.datetime.fromtimestamp(at, ZoneInfo(zone))
            assert (local.utcoffset().total_seconds() // 60, local.tzname()) == (offset, abbr)


def test_local_window_any_zone_at_a_change(spark):
    rows = spark.createDataFrame([("a", "2024-03-31 00:59:59"), ("a", "2024-03-31 01:00:00"), ("b", "2024-06-01 00:00:00"),
                                  ("a", "2051-01-01 00:00:00")], "entity string, at string")
    rows = rows.select("entity", F.col("at").cast("timestamp").alias("window_end"))
    clocks = SN.zone_clock_table(spark, {"a": "Europe/Lisbon"}, 2020, 2030)
    df = SN.local_window_any_zone(rows, clocks)
    got = {(r["entity"], str(r["window_end"])): r["zone_abbr"] for r in df.collect()}
    assert got == {("a", "2024-03-31 00:59:59"): "WET", ("a", "2024-03-31 01:00:00"): "WEST", ("b", "2024-06-01 00:00:00"): "UTC",
                   ("a", "2051-01-01 00:00:00"): None}
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_failures_are_counted_while_the_feed_is_stored(spark, tmp_dir):
    raw = spark.createDataFrame([("a", "2026-01-01 00:00:00", "1.5"), ("a", "no time", "abc"), ("a", None, None), ("a", "2026-01-01", "1_000")],
                                "entity string, `Interval Start` string, LMP string")
    got = N.normalize_counted(raw, "p", lambda df: df.write.parquet(f"{tmp_dir}/p"))
    assert {r["column"]: (r["failures"], r["rows"]) for r in got.collect()} == {"interval_start": (1, 4), "price": (2, 4)}
    assert spark.read.parquet(f"{tmp_dir}/p").filter("price = 0.0").count() == 3
    empty = N.normalize_counted(raw.limit(0), "p", lambda df: df.write.parquet(f"{tmp_dir}/e"))
    assert {r["failures"] for r in empty.collect()} == {0}
    mix = spark.createDataFrame([("a", "2026-01-01 00:00:00", "x", "1")], "entity string, time string, wind string, solar string")
    got = N.normalize_counted(mix, "m", lambda df: df.write.parquet(f"{tmp_dir}/m"), mix=DEFAULT_MIX)
    assert {r["column"]: r["failures"] for r in got.collect()} == {"time": 0, "wind": 1, "solar": 0}


def test_backfill_reads_the_mix_of_the_incomplete_dates_only(spark):
    from tests.conftest import SF_SMALL
    from tierline.plans.catalog import REGISTRY

    plan = REGISTRY["gold_backfill"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_date" in plan and "scalar-subquery" in plan
