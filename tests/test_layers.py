"""Silver and gold layers: insert semantics, incremental runs, backfill."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import ts
from tierline.operators import contracts as C
from tierline.operators import gold as G
from tierline.operators import silver as S
from tierline.settings import MixSpec

PRICES = T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("interval_start", T.TimestampType()),
    T.StructField("location", T.StringType()), T.StructField("location_type", T.StringType()),
    T.StructField("price", T.DoubleType()), T.StructField("market", T.StringType()),
])
MIX = MixSpec(components=("a", "b"), share_of=("a",))
MIX_SCHEMA = "entity string, time timestamp, a double, b double, share_pct double"


def prices(spark, rows):
    return spark.createDataFrame(rows, PRICES)


def test_same_key_twice_in_batch_both_kept(spark):
    b = prices(spark, [("E", ts(0), "n1", None, 10.0, "R"), ("E", ts(0), "n1", None, 11.0, "R")])
    assert S.silver_prices(b).count() == 2


def test_same_key_in_later_batch_refused(spark):
    first = prices(spark, [("E", ts(0), "n1", None, 10.0, "R")])
    later = prices(spark, [("E", ts(0), "n1", None, 99.0, "R"), ("E", ts(1), "n1", None, 5.0, "R")])
    new = S.silver_prices(later, S.silver_prices(first)).collect()
    assert [(r.interval_start, r.price) for r in new] == [(ts(1), 5.0)]


def test_null_location_treated_as_empty(spark):
    first = prices(spark, [("E", ts(0), None, None, 10.0, "R")])
    again = prices(spark, [("E", ts(0), None, None, 12.0, "R")])
    assert S.silver_prices(again, S.silver_prices(first)).count() == 0


def test_rerun_adds_nothing(spark):
    b = prices(spark, [("E", ts(h), "n", None, float(h), "R") for h in range(5)])
    assert S.silver_prices(b, S.silver_prices(b)).count() == 0


def gold_of(spark, price_rows, mix_rows):
    return G.gold_summary(prices(spark, price_rows), spark.createDataFrame(mix_rows, MIX_SCHEMA), MIX,
                          computed_at="2026-02-01 00:00:00")


def test_hour_without_mix_keeps_null_mix(spark):
    g = gold_of(spark, [("E", ts(0, 5), "n", None, 10.0, "R")], [("E", ts(1), 1.0, 2.0, 33.33)]).collect()
    assert len(g) == 1 and g[0].a is None and g[0].share_pct is None and g[0].avg_price == 10.0


def test_several_mix_rows_do_not_change_price_average(spark):
    p = [("E", ts(0, m), "n", None, v, "R") for m, v in ((0, 10.0), (20, 20.0), (40, 40.0))]
    mx = [("E", ts(0, m), 1.0, 3.0, 25.0) for m in (0, 15, 30, 45)]
    r = gold_of(spark, p, mx).collect()[0]
    assert (r.avg_price, r.max_price, r.min_price, r.a, r.b) == (23.33, 40.0, 10.0, 1.0, 3.0)
    assert r.window_end == ts(1)


def test_incremental_first_write_wins(spark):
    mix = spark.createDataFrame([], MIX_SCHEMA)
    existing = G.gold_summary(prices(spark, [("E", ts(0, 5), "n", None, 10.0, "R")]), mix, MIX, "2026-02-01")
    later = prices(spark, [("E", ts(0, 50), "n", None, 90.0, "R"), ("E", ts(1, 5), "n", None, 7.0, "R")])
    new = G.gold_incremental(later, mix, existing, MIX, "2026-02-01").collect()
    assert [(r.window_start, r.avg_price) for r in new] == [(ts(1), 7.0)]
    table = G.append_gold(existing, G.gold_incremental(later, mix, existing, MIX, "2026-02-01"))
    assert {r.window_start: r.avg_price for r in table.collect()} == {ts(0): 10.0, ts(1): 7.0}


def test_evolve_then_backfill(spark):
    mixdf = spark.createDataFrame([("E", ts(0, 10), 2.0, 6.0, 25.0)], MIX_SCHEMA)
    full = G.gold_summary(prices(spark, [("E", ts(0, 5), "n", None, 10.0, "R")]), mixdf, MIX, "2026-02-01")
    old = full.drop("a", "b")
    evolved = G.evolve_schema(old, full.limit(0))
    assert evolved.collect()[0].a is None
    assert G.count_incomplete(evolved, MIX, check=2).collect()[0].incomplete_rows == 1
    filled = G.gold_backfill(evolved, mixdf, MIX).collect()[0]
    assert (filled.a, filled.b, filled.share_pct) == (2.0, 6.0, 25.0)
    again = G.gold_backfill(spark.createDataFrame([filled], evolved.schema), mixdf, MIX).collect()[0]
    assert again == filled


def test_mergeschema_read_of_two_layouts(spark, tmp_dir):
    mixdf = spark.createDataFrame([("E", ts(0, 10), 2.0, 6.0, 25.0)], MIX_SCHEMA)
    full = G.gold_summary(prices(spark, [("E", ts(0, 5), "n", None, 10.0, "R")]), mixdf, MIX, "2026-02-01")
    full.drop("a", "b").write.parquet(f"{tmp_dir}/v=1")
    full.write.parquet(f"{tmp_dir}/v=2")
    got = G.read_gold(spark, tmp_dir)
    assert "a" in got.columns and got.count() == 2 and got.filter("a IS NULL").count() == 1


def test_gold_plan_aggregates_before_join(spark):
    """Both sides are aggregated before the join (no raw-row fan-out)."""
    g = gold_of(spark, [("E", ts(0, 5), "n", None, 10.0, "R")], [("E", ts(0), 1.0, 2.0, 33.33)])
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    join_at = plan.find("Join LeftOuter")
    assert join_at >= 0 and plan.find("Aggregate", join_at) > join_at


def test_hot_group_of_copies_is_collapsed_map_side(spark):
    """A third of the batch is one row copied: one silver row, dedup combined before the shuffle."""
    hot = [("E", ts(0), "n", None, 10.0, "R")] * 50
    rest = [("E", ts(h % 24, h % 60), f"n{h}", None, float(h), "R") for h in range(100)]
    batch = prices(spark, hot + rest).repartition(4)
    out = S.new_price_rows(batch, None)
    assert out.count() == 101
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchange_at = plan.find("Exchange hashpartitioning")
    assert exchange_at >= 0 and plan.find("HashAggregate", exchange_at) > exchange_at


@pytest.fixture
def large_inputs(spark):
    """Plans as for tables above the broadcast threshold, in partitions as they are dealt out."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("most", [None, 0])
def test_silver_rows_are_not_dealt_out_by_entity(spark, large_inputs, monkeypatch, most):
    """Two entities of many rows take more than two tasks; a failing list beyond the limit gates the same rows."""
    if most is not None:
        monkeypatch.setattr(C, "BROADCAST_ENTITIES", most)
    good = [(e, ts(h % 24, h % 60), f"n{h}", None, float(h), "R") for e in "AB" for h in range(200)]
    bad = [("C", None, "n", None, 1.0, "R"), ("C", ts(1), "n", None, 1.0, "R"), (None, ts(2), "n", None, 1.0, "R")]
    out = S.silver_prices(prices(spark, good + good + bad).repartition(4))
    mix_rows = [(e, ts(h % 24, h % 60), float(h), 1.0, 50.0) for e in "AB" for h in range(200)]
    mixed = S.silver_mix(spark.createDataFrame([*mix_rows, ("C", None, 1.0, 1.0, 50.0)], MIX_SCHEMA), mix=MIX)
    assert sorted(tuple(r)[4] for r in out.collect()) == sorted(r[4] for r in good)
    assert {r.entity for r in out.collect()} == {r.entity for r in mixed.collect()} == {"A", "B"}
    assert mixed.count() == len({r[:3] for r in mix_rows})
    if most is None:
        assert all(df.select(F.spark_partition_id()).distinct().count() > 2 for df in (out, mixed))


def test_append_brings_a_date_together(spark, tmp_dir):
    rows = spark.range(0, 2000, 1, 8).select(
        "id", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, id % 2)").alias("t"))
    S.append(rows, tmp_dir, S.DATE_COL, "t")
    back = spark.read.parquet(tmp_dir)
    assert back.count() == 2000 and back.select("id").distinct().count() == 2000
    files = back.groupBy(S.DATE_COL).agg(F.count_distinct("_metadata.file_path").alias("n")).collect()
    assert len(files) == 2 and all(r.n < 8 for r in files)


def test_write_gold_partitions_by_window_date(spark, tmp_dir):
    mixdf = spark.createDataFrame([], MIX_SCHEMA)
    g = G.gold_summary(prices(spark, [("E", ts(0, 5), "n", None, 10.0, "R"),
                                      ("E", ts(0, 5, day=2), "n", None, 12.0, "R")]), mixdf, MIX, "2026-02-01")
    G.write_gold(g, tmp_dir)
    back = G.read_gold(spark, tmp_dir)
    assert back.count() == 2 and "window_date" in back.columns
    assert back.filter("window_date = DATE'2026-01-02'").count() == 1


def test_size_rule_carried_out_on_stored_feeds(spark, tmp_path):
    from tierline.operators.bronze import write_bronze
    from tierline.operators.retention import apply_size_retention

    feeds = {}
    for feed in ("prices", "mix"):
        rows = [(feed, f"2024-01-0{d} 12:00:00") for d in (1, 2, 3, 4)] + [(feed, None)]
        df = spark.createDataFrame(rows, "entity string, at string").select(
            "entity", F.col("at").cast("timestamp").alias("ingested_at"))
        feeds[feed] = str(tmp_path / feed)
        write_bronze(df, feeds[feed])
    size, action, cut = apply_size_retention(spark, feeds, str(tmp_path / "none"), by="prices")
    assert size > 0 and (action, cut) == ("none", None) and not (tmp_path / "none").exists()
    assert apply_size_retention(spark, feeds, str(tmp_path / "none"), by="prices", warning_gb=0.0)[1] == "warning"
    base = str(tmp_path / "cut")
    assert apply_size_retention(spark, feeds, base, by="prices", warning_gb=0.0, cap_gb=0.0)[1] == "aged off"
    for feed in feeds:      # rows without an arrival time stay
        assert spark.read.parquet(f"{base}/archive/{feed}").count() == 2
        kept = spark.read.parquet(f"{base}/kept/{feed}")
        assert kept.count() == 3 and kept.filter("ingested_at IS NULL").count() == 1


def test_range_reads_prune_partitions(spark, tmp_path):
    from tierline.operators.gold import write_gold
    from tierline.operators.retention import archive_split
    from tierline.operators.snapshot import filter_time_range
    from tierline.sources.landing import history_range

    rows = spark.range(10).select(
        F.lit("a").alias("entity"), F.expr("timestamp'2024-01-01 06:00:00' + make_interval(0, 0, 0, id)").alias("t"))
    write_gold(rows.withColumnRenamed("t", "window_start"), str(tmp_path / "gold"))
    gold = spark.read.parquet(str(tmp_path / "gold"))
    picked = filter_time_range(gold, "2024-01-02 06:00:00", "2024-01-04 05:00:00")
    assert picked.count() == 2
    dated = rows.withColumn("event_date", F.to_date("t"))
    dated.write.partitionBy("event_date").parquet(str(tmp_path / "silver"))
    silver = spark.read.parquet(str(tmp_path / "silver"))
    span = history_range(silver, "2024-01-05 06:00:00", 2, col="t")
    assert span.count() == 3
    bronze = silver.withColumnsRenamed({"t": "ingested_at", "event_date": "ingest_date"})
    old, keep = archive_split(bronze, F.lit("2024-01-04 06:00:00").cast("timestamp"))
    assert (old.count(), keep.count()) == (3, 7)
    for df, column in ((picked, "window_date"), (span, "event_date"), (old, "event_date"), (keep, "event_date")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        assert column in filters and ("<=" in filters or ">=" in filters), filters


def test_one_pass_gold_equals_two_feeds(spark):
    facts = [("E", ts(0), 10.0, "x", 4.0, True), ("E", ts(0), 20.0, "y", 6.0, True), ("E", ts(0), 30.0, "x", 2.0, True),
             ("E", ts(1), 5.0, None, 9.0, False), ("F", ts(0), None, "y", 3.0, True), ("F", ts(2), 1.0, None, 7.0, True)]
    df = spark.createDataFrame(
        facts, "entity string, interval_start timestamp, price double, category string, amount double, has_mix boolean")
    one = G.gold_one_pass(df, ("x", "y"), MIX, computed_at="2026-02-01 00:00:00")
    mix = [("E", ts(0), 6.0, 6.0, 50.0), ("F", ts(0), 0.0, 3.0, 0.0), ("F", ts(2), 0.0, 0.0, None)]
    two = gold_of(spark, [(e, t, None, None, p, "R") for e, t, p, *_ in facts], mix)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert one.columns == two.columns
