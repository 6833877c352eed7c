"""Z-score anomaly status per entity against its gold history.

The baseline for every entity comes from one ``groupBy(entity)``; the mean
and the sample standard deviation come from exact sums (partial aggregation,
so a hot entity is combined map-side). The quartiles use Spark's exact ``percentile`` (linear
interpolation), which buffers a value->count map per entity; over gold that
map is bounded by the number of hours of history. For raw-feed scale use
``approx=True`` (``percentile_approx``, a mergeable sketch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions.numeric import exact_mean, round_half_away, sample_stddev
from tierline.operators.snapshot import latest_rows
from tierline.settings import DEFAULT_THRESHOLDS, MSG_Z_FLAT, MSG_Z_NO_VALUE, MSG_Z_SCORE, MSG_Z_SHORT, Thresholds

STAT_DIGITS = 6   # published precision of the baseline statistics


def _quartiles(col: str, approx: bool) -> Column:
    if approx:
        return F.percentile_approx(col, F.array(F.lit(0.25), F.lit(0.75)), 100000)
    return F.percentile(col, F.array(F.lit(0.25), F.lit(0.75)))


def anomaly_baseline(gold: DataFrame, col: str = "avg_price", th: Thresholds = DEFAULT_THRESHOLDS,
                     approx: bool = False) -> DataFrame:
    """Per entity: n, mean, sample std, q25, q75, spread, and whether n suffices."""
    vals = gold.filter(F.col(col).isNotNull())
    agg = vals.groupBy("entity").agg(
        F.count(col).alias("n"),
        exact_mean(col).alias("mean"),
        sample_stddev(col).alias("std"),
        _quartiles(col, approx).alias("q"),
    )
    r = lambda c: round_half_away(c, STAT_DIGITS)
    return agg.select(
        "entity", "n",
        r(F.col("mean")).alias("mean"),
        r(F.col("std")).alias("std"),
        r(F.col("q")[0]).alias("q25"),
        r(F.col("q")[1]).alias("q75"),
        r(F.col("q")[1] - F.col("q")[0]).alias("spread"),
        (F.col("n") >= th.min_points).alias("has_baseline"),
    )


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """(value - mean) / std; null when std is 0 or unknown."""
    return (value - mean) / F.nullif(std, F.lit(0.0))


def anomaly_status(z: Column, th: Thresholds = DEFAULT_THRESHOLDS) -> Column:
    """null or NaN -> grey; |z| < 1 green, < 2 yellow, < 3 red, else critical."""
    a = F.abs(z)
    return (F.when(z.isNull() | F.isnan(z), F.lit("grey"))
            .when(a < th.z_elevated, F.lit("green"))
            .when(a < th.z_high, F.lit("yellow"))
            .when(a < th.z_critical, F.lit("red"))
            .otherwise(F.lit("critical")))


def anomaly_scores(gold: DataFrame, col: str = "avg_price", th: Thresholds = DEFAULT_THRESHOLDS,
                   current: DataFrame | None = None, approx: bool = False) -> DataFrame:
    """Status of each entity's current value against its whole gold history.

    ``current`` defaults to the rows at the global latest window. The history
    includes the current hour. Output: entity, status, current_price, z_score
    (2 decimals), reason, and the baseline: n, mean, std, q25, q75, spread.
    """
    cur = latest_rows(gold) if current is None else current
    vals = gold.filter(F.col(col).isNotNull())
    base = vals.groupBy("entity").agg(
        F.count(col).alias("n"),
        exact_mean(col).alias("mean"),
        sample_stddev(col).alias("std"),
        _quartiles(col, approx).alias("q"),
    )
    j = cur.select("entity", F.col(col).alias("current_price")).join(base, "entity", "left")
    enough = F.coalesce(F.col("n"), F.lit(0)) >= th.min_points
    z = z_score(F.col("current_price"), F.col("mean"), F.col("std"))
    z_ok = z.isNotNull() & ~F.isnan(z)
    status = F.when(~enough, F.lit("grey")).otherwise(anomaly_status(z, th))
    reason = (F.when(~enough, F.lit(MSG_Z_SHORT % th.min_points))
              .when(z_ok, F.format_string(MSG_Z_SCORE, z))
              .when(F.col("current_price").isNull() | F.isnan("current_price"), F.lit(MSG_Z_NO_VALUE))
              .otherwise(F.lit(MSG_Z_FLAT)))
    return j.select(
        "entity", status.alias("status"), "current_price",
        F.when(enough & z_ok, round_half_away(z, 2)).alias("z_score"),
        reason.alias("reason"),
        F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("n"),
        round_half_away(F.col("mean"), STAT_DIGITS).alias("mean"),
        round_half_away(F.col("std"), STAT_DIGITS).alias("std"),
        round_half_away(F.col("q")[0], STAT_DIGITS).alias("q25"),
        round_half_away(F.col("q")[1], STAT_DIGITS).alias("q75"),
        round_half_away(F.col("q")[1] - F.col("q")[0], STAT_DIGITS).alias("spread"),
    )
