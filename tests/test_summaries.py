"""Daily summaries: merged moments and sketches, increments, plans; CDF ranks across tasks."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from tierline.operators import distribution as D
from tierline.operators import summaries as SU


def gold(spark, rows):
    return (spark.createDataFrame(rows, "entity string, at string, avg_price double")
            .select("entity", F.col("at").cast("timestamp").alias("window_start"), "avg_price"))


def history(days=9, seed=4):
    import random

    rng = random.Random(seed)
    rows = [("a", f"2026-01-{d:02d} {h:02d}:00:00", round(rng.gauss(30, 12), 3)) for d in range(1, days + 1) for h in range(24)]
    rows += [("flat", f"2026-01-{d:02d} {h:02d}:00:00", 0.1) for d in range(1, days + 1) for h in range(0, 24, 5)]
    rows += [("large", f"2026-01-{d:02d} 00:00:00", 1e9 + d) for d in range(1, days + 1)]
    return rows + [("one", "2026-01-02 01:00:00", 5.0), ("one", "2026-01-03 01:00:00", None), ("nan", "2026-01-02 01:00:00", float("nan"))]


def test_moments_match_the_whole_history(spark, tmp_dir):
    rows = history()
    g = gold(spark, rows)
    for part in ("window_start < '2026-01-05'", "window_start >= '2026-01-05'", "window_start >= '2026-01-08'"):
        SU.add_days(g.filter(part), f"{tmp_dir}/days")        # the last two days are loaded twice
    got = {r["entity"]: r for r in SU.merged_moments(SU.read_days(spark, f"{tmp_dir}/days")).collect()}
    assert set(got) == {"a", "flat", "large", "one"}
    for entity in ("a", "large"):
        values = [v for e, _, v in rows if e == entity]
        assert got[entity]["n"] == len(values)
        assert got[entity]["mean"] == pytest.approx(statistics.fmean(values), rel=1e-14)
        assert got[entity]["std"] == pytest.approx(statistics.stdev(values), rel=1e-9)
    assert got["flat"]["std"] == 0.0
    assert (got["one"]["n"], got["one"]["std"]) == (1, None)


def test_sketch_quantiles_stay_within_the_rank_error(spark):
    """More values than a sketch holds: the quartiles' ranks are off by less than the stated error."""
    n = 60_000
    rows = spark.range(n).select(F.lit("a").alias("entity"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("avg_price"),
                                 (F.timestamp_seconds(F.lit(1767225600) + F.col("id") * 60)).alias("window_start")).persist()
    days = SU.daily_summary(rows)
    assert days.count() > 40
    q = SU.box_from_days(days).first()
    exact = sorted(r[0] for r in rows.select("avg_price").collect())
    for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = sum(v <= q[c] for v in exact) / n
        assert abs(at - p) <= SU.RANK_ERROR + 1 / n
    rows.unpersist()


def test_scores_read_one_window_and_the_days(spark, tmp_dir):
    g = gold(spark, history())
    g.withColumn("window_date", F.to_date("window_start")).write.partitionBy("window_date").parquet(f"{tmp_dir}/gold")
    SU.add_days(g, f"{tmp_dir}/days")
    stored = spark.read.parquet(f"{tmp_dir}/gold").drop("window_date")
    scores = SU.scores_from_days(SU.read_days(spark, f"{tmp_dir}/days"), stored)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "sketch" not in plan                         # moments only: the sketches are not read
    assert {r["entity"]: r["status"] for r in scores.collect()}["a"] in ("green", "yellow", "red", "critical")
    assert SU.baseline_from_days(SU.daily_summary(g.limit(0))).collect() == []


def test_cdf_ranks_across_tasks(spark):
    rows = [("a", f"2026-01-01 {i % 24:02d}:{i // 24:02d}:00", float(i % 7)) for i in range(500)] + [("b", "2026-01-01 00:00:00", 1.0), ("b", "2026-01-01 01:00:00", None)]
    df = D.price_cdf(gold(spark, rows).repartition(6))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
    got = sorted((r["entity"], r["avg_price"], r["window_start"], r["cdf_pct"]) for r in df.collect())
    want = sorted(((r[0], r[2], r[1]) for r in rows if r[2] is not None))
    assert [(g[0], g[1], str(g[2])) for g in got] == want
    assert [g[3] for g in got if g[0] == "a"] == [i / 500 * 100.0 for i in range(1, 501)]
    assert D.price_cdf(gold(spark, rows).limit(0)).collect() == []
