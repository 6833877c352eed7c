"""Snapshot, distribution, health and retention operators on small inputs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import ts
from tierline.operators import distribution as D
from tierline.operators import health as H
from tierline.operators import retention as R
from tierline.operators import snapshot as SN

GOLD = "entity string, window_start timestamp, window_end timestamp, avg_price double"


def gold(spark, rows):
    return spark.createDataFrame([(e, w, w + dt.timedelta(hours=1), p) for e, w, p in rows], GOLD)


def test_cdf_ties_get_distinct_positions(spark):
    g = gold(spark, [("A", ts(0), 5.0), ("A", ts(1), 5.0), ("A", ts(2), 7.0), ("A", ts(3), 9.0)])
    got = [r.cdf_pct for r in D.price_cdf(g).orderBy("cdf_pct").collect()]
    assert got == [25.0, 50.0, 75.0, 100.0]


def test_histogram_shared_bins_and_last_edge(spark):
    g = gold(spark, [("A", ts(0), 0.0), ("A", ts(1), 10.0), ("B", ts(0), 20.0)])
    got = {(r.entity, r.bin): r["count"] for r in D.price_histogram(g, bins=2).collect()}
    assert got == {("A", 0): 1, ("A", 1): 1, ("B", 1): 1}


def test_box_stats_and_outliers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    g = gold(spark, [("A", ts(i), v) for i, v in enumerate(vals)])
    b = D.box_stats(g).collect()[0]
    assert (b.q1, b.median, b.q3) == (2.0, 3.0, 4.0)
    assert b.whisker_high == 4.0 and b.outliers == 1
    assert [r.avg_price for r in D.box_outliers(g).collect()] == [100.0]


def test_quantile_spread(spark):
    g = gold(spark, [("A", ts(i), float(i)) for i in range(5)])
    r = D.quantile_spread(g).collect()[0]
    assert (r.q25, r.q75, r.spread) == (1.0, 3.0, 2.0)


def test_snapshot_lookback_range(spark):
    rows = [("A", ts(h), float(h)) for h in range(0, 5)] + [("B", ts(4), 50.0)]
    g = gold(spark, rows).withColumn("share_pct", F.lit(None).cast("double")).withColumn(
        "computed_at", F.current_timestamp())
    from tierline.settings import MixSpec
    snap = {r.entity: r for r in SN.snapshot_lookback(g, hours=2, mix=MixSpec(components=())).collect()}
    assert snap["A"].avg_price == 4.0 and (snap["A"].range_min, snap["A"].range_max) == (2.0, 4.0)
    assert snap["B"].range_min == 50.0


def test_latest_per_entity_vs_global_latest(spark):
    g = gold(spark, [("A", ts(0), 1.0), ("A", ts(3), 2.0), ("B", ts(1), 3.0)])
    assert {r.entity for r in SN.latest_rows(g).collect()} == {"A"}
    assert {(r.entity, r.avg_price) for r in SN.latest_per_entity(g).collect()} == {("A", 2.0), ("B", 3.0)}


def test_price_band_edges(spark):
    g = gold(spark, [("A", ts(0), 25.0), ("A", ts(1), 50.0), ("A", ts(2), 75.0), ("A", ts(3), 150.0)])
    assert [r.band for r in SN.price_band(g).orderBy("window_start").collect()] == ["normal", "off", "off", "inverse"]


def test_gap_single_row_entity_has_no_gap(spark):
    g = gold(spark, [("A", ts(0), 1.0), ("B", ts(0), 1.0), ("B", ts(2), 1.0)])
    got = {r.entity: r for r in H.gap_by_entity(g, expected_minutes=5).collect()}
    assert got["A"].avg_interval_minutes is None and not got["A"].has_gap
    assert got["B"].avg_interval_minutes == 120.0 and got["B"].has_gap
    assert not {r.entity: r for r in H.gap_by_entity(g, expected_minutes=60).collect()}["B"].has_gap


def test_freshness_thresholds(spark):
    b = spark.createDataFrame([(ts(0),)], "ingested_at timestamp")
    for minutes, status in ((5, "ok"), (15, "warning"), (59, "warning"), (60, "error")):
        r = H.freshness_status(b, as_of=ts(0) + dt.timedelta(minutes=minutes)).collect()[0]
        assert r.status == status and r.value == float(minutes)
    empty = H.freshness_status(b.limit(0), as_of=ts(1)).collect()[0]
    assert empty.status == "warning" and empty.value is None


def test_missed_intervals(spark):
    b = spark.createDataFrame([(ts(0),)], "ingested_at timestamp")
    r = H.missed_intervals(b, "prices", as_of=ts(0, 17), poll_minutes=5).collect()[0]
    assert r.missed_intervals == 2 and r.has_gap and r.message.startswith("Gap detected: 2")


def test_row_counts_warn_on_empty_layer(spark):
    a = spark.range(3)
    counts = H.layer_row_counts({"bronze": a, "silver": a.limit(0), "gold": a})
    r = H.row_count_status(counts).collect()[0]
    assert r.status == "warning" and r.message == "Empty layers: silver"


def test_rollup_domains(spark):
    rep = spark.createDataFrame([("last_ingest", "warning", "m", 1.0), ("data_gap", "warning", "m", 1.0),
                                 ("schema", "ok", "m", 1.0)], "check string, status string, message string, value double")
    r = H.health_rollup(rep, H.domain_table(spark)).collect()[0]
    assert (r.errors, r.warnings, r.overall, r.domains) == (0, 2, "warning", "Data Freshness, Data Quality")


def instants(spark, n):
    return spark.createDataFrame([(ts(0) + dt.timedelta(seconds=7 * i),) for i in range(n)], "ingested_at timestamp")


def test_median_cutoff_positions(spark):
    for n, idx in ((4, 2), (5, 2), (6, 3), (7, 4)):
        r = R.median_cutoff(instants(spark, n)).collect()[0]
        assert (r.n, r.k) == (n, idx) and r.cutoff == ts(0) + dt.timedelta(seconds=7 * idx)


def test_median_cutoff_with_hot_instant(spark):
    """A third of all rows on one instant: still exact, no row left out."""
    base = [(ts(0) + dt.timedelta(days=i % 3, microseconds=i),) for i in range(60)]
    hot = [(ts(5),)] * 30
    df = spark.createDataFrame(base + hot, "ingested_at timestamp")
    got = R.median_cutoff(df).collect()[0]
    expect = sorted(r[0] for r in base + hot)[round(90 / 2)]
    assert got.cutoff == expect


def test_archive_plus_keep_is_input(spark):
    df = instants(spark, 11)
    cut = R.median_cutoff_instant(df)
    old, keep = R.archive_split(df, cut)
    assert old.count() + keep.count() == 11


def test_archive_export_and_listing(spark, tmp_dir):
    df = instants(spark, 20).repartition(3)
    n = R.archive_export(df, F.lit(ts(0, 1)).cast("timestamp"), f"{tmp_dir}/bronze_prices_20260101")
    assert n == 9 and spark.read.parquet(f"{tmp_dir}/bronze_prices_20260101").count() == 9
    listing = R.archive_listing(spark, tmp_dir).collect()
    assert 1 <= len(listing) <= 10 and all(r.size_bytes > 0 for r in listing)


def test_retain_table_copy_on_write(spark, tmp_dir):
    from tierline.operators.bronze import write_bronze
    rows = [(f"e{i}", ts(0, day=1 + i % 4)) for i in range(8)]
    df = spark.createDataFrame(rows, "entity string, ingested_at timestamp")
    write_bronze(df, f"{tmp_dir}/v1")
    R.retain_table(spark, f"{tmp_dir}/v1", f"{tmp_dir}/v2", ts(0, day=3))
    assert spark.read.parquet(f"{tmp_dir}/v2").count() == 4
    assert spark.read.parquet(f"{tmp_dir}/v1").count() == 8


def test_entity_coverage(spark):
    obs = spark.createDataFrame([("A",), ("C",)], "entity string")
    got = {r.entity: r.status for r in H.entity_coverage(obs, ["A", "B"]).collect()}
    assert got == {"A": "active", "B": "not observed", "C": "not configured"}


def test_local_window_zone_abbreviation(spark):
    rows = spark.createDataFrame(
        [("A", dt.datetime(2026, 7, 1, 12)), ("B", dt.datetime(2026, 7, 1, 12)),
         ("C", dt.datetime(2026, 1, 15, 12)), ("D", dt.datetime(2026, 7, 1, 12))],
        "entity string, window_end timestamp")
    zones = SN.zone_table(spark, {"A": "America/Chicago", "B": "Europe/Berlin", "C": "America/Chicago",
                                  "D": "Asia/Kolkata"})
    got = {r.entity: (r.zone_abbr, r.label) for r in SN.local_window(rows, zones, hours=48).collect()}
    assert got["A"][0] == "CDT" and got["B"][0] == "CEST" and got["C"][0] == "CST"
    assert got["D"][0] == "UTC+05:30"
    assert got["C"][1] == "Window: Jan 13 06:00AM to Jan 15 06:00AM CST"


def test_size_retention_actions(spark):
    prices = instants(spark, 10)
    mix = instants(spark, 4)
    none = R.retention_by_size(prices, mix, size_gb=1.0).collect()[0]
    assert (none.action, none.archived_prices, none.kept_prices, none.cutoff) == ("none", 0, 10, None)
    warn = R.retention_by_size(prices, mix, size_gb=4.5).collect()[0]
    assert (warn.action, warn.archived_prices, warn.kept_mix) == ("warning", 0, 4)
    cut = R.retention_by_size(prices, mix, size_gb=5.0).collect()[0]
    assert cut.action == "aged off" and cut.cutoff == ts(0) + dt.timedelta(seconds=7 * 5)
    assert (cut.archived_prices, cut.kept_prices) == (5, 5) and cut.archived_mix + cut.kept_mix == 4


def test_empty_inputs_give_empty_results(spark):
    empty = gold(spark, []).limit(0)
    assert D.price_cdf(empty).count() == 0 and D.box_stats(empty).count() == 0
    assert SN.latest_rows(empty).count() == 0 and H.gap_by_entity(empty).count() == 0
    assert R.median_cutoff(instants(spark, 0)).collect()[0].cutoff is None


def test_size_retention_without_prices_takes_no_action(spark):
    r = R.retention_by_size(instants(spark, 0), instants(spark, 3), size_gb=6.0).collect()[0]
    assert (r.action, r.cutoff, r.archived_mix, r.kept_mix) == ("none", None, 0, 3)


def test_snapshot_on_old_layout_gold(spark):
    from tierline.settings import MixSpec
    g = gold(spark, [("A", ts(0), 1.0), ("A", ts(1), 2.0)])
    snap = SN.snapshot_lookback(g, hours=48, mix=MixSpec()).collect()[0]
    assert (snap.avg_price, snap.range_min, snap.range_max) == (2.0, 1.0, 2.0)


def test_logical_size_counts_octets_and_values(spark):
    df = spark.createDataFrame([("é", 1.0, None), (None, None, 3)], "a string, b double, c int")
    assert H.logical_size(df).first().size_bytes == 2 + 8 + 8
    assert H.logical_size(df.limit(0)).first().size_bytes == 0


def test_archive_contents_newest_first(spark):
    df = instants(spark, 3).unionByName(spark.createDataFrame([(ts(0, day=5),)], "ingested_at timestamp")
                                        .withColumns({c: F.lit(None) for c in instants(spark, 1).columns if c != "ingested_at"}))
    got = R.archive_contents(df).collect()
    assert sum(r.rows for r in got) == 4
    assert [r.archived_date for r in got] == sorted({r.archived_date for r in got}, reverse=True)
