"""Distributions of the hourly price and the mix series, over gold.

The CDF ranks rows across all tasks. Exact quartiles run per entity on gold,
which holds at most one row per (entity, hour): one entity's group is bounded
by the hours of history (87,600 for ten years) however large the raw feeds
grow; for raw-level inputs they take ``approx=True`` (a mergeable sketch), and
``summaries`` keeps such sketches by day. Everything that only counts or sums
(histogram, totals, summaries) is an ordinary aggregate with map-side
combining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierline.functions.numeric import exact_mean, exact_sum, round_half_away
from tierline.functions.ranking import ranked
from tierline.operators.snapshot import latest_rows
from tierline.settings import DEFAULT_MIX, HISTOGRAM_BINS, MIX_DISPLAY_MIN, MixSpec

STAT_DIGITS = 6


def price_cdf(gold: DataFrame, col: str = "avg_price") -> DataFrame:
    """Empirical CDF per entity: i / n * 100 for the i-th value in ascending order.

    Ties get distinct positions (ordered by window_start), unlike cume_dist.
    Ranks come from a sort over all tasks (``functions.ranking``): no task holds
    a whole entity, so the input may as well be raw prices.
    """
    vals = gold.filter(F.col(col).isNotNull()).select("entity", "window_start", F.col(col).alias("__v"))
    placed = ranked(vals, ["entity"], [F.col("__v").asc(), F.col("window_start").asc()], "__i", size="__n")
    return placed.select("entity", "window_start", F.col("__v").alias(col),
                         (F.col("__i") / F.col("__n") * F.lit(100.0)).alias("cdf_pct"))


def price_histogram(gold: DataFrame, col: str = "avg_price", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts per entity over shared equal-width bins spanning the global range.

    The range is one scalar subquery; binning is a projection, counting a
    partial aggregate. Only non-empty bins are reported.
    """
    vals = gold.filter(F.col(col).isNotNull())
    rng = vals.agg(F.struct(F.min(col).alias("lo"),
                            ((F.max(col) - F.min(col)) / F.lit(float(bins))).alias("w"))).scalar()
    lo, width = rng.getField("lo"), rng.getField("w")
    raw_bin = F.floor((F.col(col) - lo) / width)
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(raw_bin, F.lit(bins - 1))).cast("int")
    counted = vals.groupBy("entity", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "entity", "bin",
        (lo + F.col("bin") * width).alias("bin_lo"),
        (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
        "count",
    )


def _quantiles(col: str, ps: list[float], approx: bool):
    """Exact quantiles (linear interpolation) or, for raw-level inputs, the
    mergeable ``percentile_approx`` sketch."""
    arr = F.array(*[F.lit(p) for p in ps])
    return F.percentile_approx(col, arr, 100000) if approx else F.percentile(col, arr)


def _quartile_stats(gold: DataFrame, col: str, approx: bool = False) -> DataFrame:
    vals = gold.filter(F.col(col).isNotNull())
    return vals.groupBy("entity").agg(
        F.count(col).alias("n"),
        _quantiles(col, [0.25, 0.5, 0.75], approx).alias("q"),
        exact_mean(col).alias("mean"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    ).select("entity", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
             F.col("q")[2].alias("q3"), "mean", "min", "max")


def box_stats(gold: DataFrame, col: str = "avg_price", approx: bool = False) -> DataFrame:
    """Quartiles, mean, 1.5 IQR fences, whiskers (extreme values inside the
    fences) and the number of outliers per entity."""
    q = _quartile_stats(gold, col, approx)
    iqr = F.col("q3") - F.col("q1")
    fenced = q.select("entity", "n", "q1", "median", "q3", "mean",
                      (F.col("q1") - F.lit(1.5) * iqr).alias("lower_fence"),
                      (F.col("q3") + F.lit(1.5) * iqr).alias("upper_fence"))
    vals = gold.filter(F.col(col).isNotNull()).select("entity", F.col(col).alias("__v"))
    inside = (F.col("__v") >= F.col("lower_fence")) & (F.col("__v") <= F.col("upper_fence"))
    # the quartiles ride along as grouping columns, so they are computed once
    per = vals.join(fenced, "entity").groupBy(*fenced.columns).agg(
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    r = lambda c: round_half_away(F.col(c), STAT_DIGITS).alias(c)
    return per.select(
        "entity", "n", r("q1"), r("median"), r("q3"), r("mean"), r("lower_fence"), r("upper_fence"),
        "whisker_low", "whisker_high", "outliers")


def box_outliers(gold: DataFrame, col: str = "avg_price", approx: bool = False) -> DataFrame:
    """The rows outside the 1.5 IQR fences of their entity."""
    q = _quartile_stats(gold, col, approx)
    iqr = F.col("q3") - F.col("q1")
    fences = q.select("entity", (F.col("q1") - F.lit(1.5) * iqr).alias("lo"),
                      (F.col("q3") + F.lit(1.5) * iqr).alias("hi"))
    return (gold.filter(F.col(col).isNotNull()).select("entity", "window_start", col)
            .join(fences, "entity")
            .filter((F.col(col) < F.col("lo")) | (F.col(col) > F.col("hi")))
            .select("entity", "window_start", col))


def quantile_spread(gold: DataFrame, col: str = "avg_price", approx: bool = False) -> DataFrame:
    """Q0.25, Q0.75 and their difference per entity, 2 decimals."""
    q = (gold.filter(F.col(col).isNotNull()).groupBy("entity")
         .agg(_quantiles(col, [0.25, 0.75], approx).alias("q")))
    return q.select("entity",
                    round_half_away(F.col("q")[0], 2).alias("q25"),
                    round_half_away(F.col("q")[1], 2).alias("q75"),
                    round_half_away(F.col("q")[1] - F.col("q")[0], 2).alias("spread"))


def _long_mix(gold: DataFrame, mix: MixSpec) -> DataFrame:
    comps = [c for c in mix.components if c in gold.columns]
    wide = gold.select("entity", "window_start", *[F.col(c).cast("double").alias(c) for c in comps])
    return wide.unpivot(["entity", "window_start"], comps, "component", "value")


def mix_timeseries(gold: DataFrame, mix: MixSpec = DEFAULT_MIX) -> DataFrame:
    """Mix series in long form, nulls as 0, without components whose total for
    the entity is 0 (an all-zero series is not drawn)."""
    comps = [c for c in mix.components if c in gold.columns]
    wide = gold.select("entity", "window_start",
                       *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in comps])
    # one row of totals an entity is joined to the wide rows; only then they are made long
    totals = wide.groupBy("entity").agg(*[exact_sum(c).alias(f"__total_{c}") for c in comps])
    series = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value"),
                                F.col(f"__total_{c}").alias("__total")) for c in comps])
    return (wide.join(totals, "entity").select("entity", "window_start", F.inline(series))
            .filter(F.col("__total") != 0).drop("__total"))


def mix_share(gold: DataFrame, mix: MixSpec = DEFAULT_MIX, min_value: float = MIX_DISPLAY_MIN) -> DataFrame:
    """Composition of each entity's row at the latest window: components above
    ``min_value``, rounded to 1 decimal, as percent of the shown total."""
    long = _long_mix(latest_rows(gold), mix).filter(F.col("value") > min_value)
    shown = long.withColumn("value", round_half_away(F.col("value"), 1))
    total = exact_sum("value", over=Window.partitionBy("entity"))
    return shown.select("entity", "component", "value",
                        round_half_away(F.col("value") / total * F.lit(100.0), 2).alias("pct"))


def history_summary(gold: DataFrame, entities: int | None = None) -> DataFrame:
    """First and last window, rows, entities, and rows per entity (integer division)."""
    agg = gold.agg(F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"),
                   F.count(F.lit(1)).alias("rows"), F.count_distinct("entity").alias("entities"))
    per = F.lit(entities) if entities is not None else F.col("entities")
    return agg.withColumn("hours_per_entity", F.when(per > 0, F.floor(F.col("rows") / per)).cast("bigint"))
