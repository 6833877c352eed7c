"""Baselines and quartiles from daily summaries instead of the whole history.

A day of an entity is summarized once: count, exact total, spread about its own
mean (M2), extremes and a quantile sketch (KLL). Summaries merge: the total is
a sum, M2 follows from the days' means, sketches merge by Spark's aggregate.
A new day therefore costs one aggregate over that day's rows, and every
statistic of the history reads one row a day and entity.

Quantiles come from the sketch, so they are values of the history whose rank
may be off by the sketch's rank error: with ``SKETCH_K`` items at most about
``RANK_ERROR`` of all rows (99 % confidence). Below ``SKETCH_K`` values a
sketch holds every one and the quantile is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions.numeric import exact_sum, round_half_away
from tierline.operators.anomaly import STAT_DIGITS, anomaly_status, z_score
from tierline.operators.snapshot import latest_rows
from tierline.settings import DEFAULT_THRESHOLDS, MSG_Z_FLAT, MSG_Z_NO_VALUE, MSG_Z_SCORE, MSG_Z_SHORT, Thresholds

SKETCH_K = 1600
RANK_ERROR = 0.002      # of the merged sketch, for K = 1600
DAY_COL = "summary_date"


def daily_summary(gold: DataFrame, col: str = "avg_price", time_col: str = "window_start", k: int = SKETCH_K) -> DataFrame:
    """One row per entity and day with values: n, total, m2, low, high, sketch.

    Null values do not count; NaN takes no part either (a sketch has no place for it).
    """
    value = F.col(col).cast("double")
    rows = gold.filter(value.isNotNull() & ~F.isnan(value)).select("entity", F.to_date(time_col).alias(DAY_COL), value.alias("v"))
    return rows.groupBy("entity", DAY_COL).agg(
        F.count("v").alias("n"), exact_sum("v").alias("total"),
        (F.var_pop("v") * F.count("v")).alias("m2"),          # Spark merges centred moments: equal values give exactly 0
        F.min("v").alias("low"), F.max("v").alias("high"),
        F.kll_sketch_agg_double("v", k).alias("sketch"))


def add_days(gold: DataFrame, path: str, col: str = "avg_price", time_col: str = "window_start") -> None:
    """Summaries of the days in ``gold`` into the stored table, replacing those days and no other.

    ``gold`` must hold whole days. A repeated run writes the same days again.
    """
    (daily_summary(gold, col, time_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(DAY_COL).parquet(path))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_moments(days: DataFrame) -> DataFrame:
    """Per entity: n, mean, std (sample; null below two values) from the days' moments.

    mean = sum of totals / n; M2 = sum of the days' M2 + sum of n_day * (mean_day - mean)^2.
    A history of one value throughout has a standard deviation of exactly 0.
    """
    per = days.groupBy("entity").agg(F.sum("n").alias("n"), (exact_sum("total") / F.sum("n")).alias("mean"),
                                     F.min("low").alias("low"), F.max("high").alias("high"))
    joined = days.select("entity", F.col("n").alias("dn"), F.col("total").alias("dt"), "m2").join(per, "entity")
    spread = F.col("m2") + F.col("dn") * F.pow(F.col("dt") / F.col("dn") - F.col("mean"), F.lit(2.0))
    all_ = joined.groupBy("entity", "n", "mean", "low", "high").agg(F.sum(spread).alias("m2"))
    std = F.when(F.col("n") > 1, F.when(F.col("low") == F.col("high"), F.lit(0.0)).otherwise(F.sqrt(F.col("m2") / (F.col("n") - 1))))
    return all_.select("entity", "n", "mean", std.alias("std"))


def merged_sketch(days: DataFrame) -> DataFrame:
    """Per entity the merged quantile sketch and the number of values."""
    return days.groupBy("entity").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _at(rank: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(rank))


def baseline_from_days(days: DataFrame, th: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Per entity: n, mean, std, q25, q75, spread and whether n suffices, without reading the history.

    Moments to STAT_DIGITS decimals as ``anomaly_baseline`` gives them; the
    quartiles are values of the history within the sketch's rank error.
    """
    r = lambda c: round_half_away(c, STAT_DIGITS)
    q = merged_sketch(days).select("entity", _at(0.25).alias("q25"), _at(0.75).alias("q75"))
    return merged_moments(days).join(q, "entity").select(
        "entity", "n", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), "q25", "q75",
        r(F.col("q75") - F.col("q25")).alias("spread"), (F.col("n") >= th.min_points).alias("has_baseline"))


def box_from_days(days: DataFrame) -> DataFrame:
    """Per entity: n, q1, median, q3 and fences from the sketch, exact extremes, and whether any value lies outside the fences."""
    ends = days.groupBy("entity").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    q = merged_sketch(days).select("entity", "n", _at(0.25).alias("q1"), _at(0.5).alias("median"), _at(0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumns({"lower_fence": F.col("q1") - F.lit(1.5) * iqr, "upper_fence": F.col("q3") + F.lit(1.5) * iqr})
    r = lambda c: round_half_away(F.col(c), STAT_DIGITS).alias(c)
    return q.join(ends, "entity").select(
        "entity", "n", "q1", "median", "q3", r("lower_fence"), r("upper_fence"), "low", "high",
        ((F.col("low") < F.col("lower_fence")) | (F.col("high") > F.col("upper_fence"))).alias("has_outliers"))


def scores_from_days(days: DataFrame, gold: DataFrame, col: str = "avg_price", th: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Status of each entity at the latest window: of gold only that window is read, the baseline comes from the days."""
    cur = latest_rows(gold).select("entity", F.col(col).alias("current_price"))
    j = cur.join(merged_moments(days), "entity", "left")
    enough = F.coalesce(F.col("n"), F.lit(0)) >= th.min_points
    z = z_score(F.col("current_price"), F.col("mean"), F.col("std"))
    known = z.isNotNull() & ~F.isnan(z)
    reason = (F.when(~enough, F.lit(MSG_Z_SHORT % th.min_points)).when(known, F.format_string(MSG_Z_SCORE, z))
              .when(F.col("current_price").isNull() | F.isnan("current_price"), F.lit(MSG_Z_NO_VALUE)).otherwise(F.lit(MSG_Z_FLAT)))
    return j.select("entity", F.when(~enough, F.lit("grey")).otherwise(anomaly_status(z, th)).alias("status"), "current_price",
                    F.when(enough & known, round_half_away(z, 2)).alias("z_score"), reason.alias("reason"),
                    F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("n"))
