"""Gold: the hourly summary per entity, incremental inserts, backfill, evolution.

Plan shape (checked with ``explain``): the price side and the mix side are
each aggregated by (entity, hour) with a partial (map-side) aggregate, and
only then left-joined. Both aggregates come out hash-partitioned on the join
key, so the join adds no exchange of its own. Joining raw rows first and
aggregating after (what a literal translation does) multiplies every price
row by every mix row of its hour; averages, max and min are unchanged by that
uniform repetition, so aggregating first gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions.numeric import exact_mean, exact_sum, round_half_away
from tierline.functions.time import hour_start, instant, plus_hours
from tierline.operators.normalize import coerce_numeric, renewable_share
from tierline.settings import DEFAULT_MIX, MixSpec

KEY = ["entity", "window_start"]


def _computed_at(value) -> Column:
    if value is None:
        return F.current_timestamp()
    return instant(value)


def hourly_prices(prices: DataFrame) -> DataFrame:
    """avg / max / min price per (entity, hour), rounded to 2 decimals."""
    return (prices
            .groupBy(F.col("entity"), hour_start("interval_start").alias("window_start"))
            .agg(round_half_away(exact_mean("price")).alias("avg_price"),
                 round_half_away(F.max("price")).alias("max_price"),
                 round_half_away(F.min("price")).alias("min_price")))


def hourly_mix(mix: DataFrame, spec: MixSpec = DEFAULT_MIX) -> DataFrame:
    """Average share and components per (entity, hour), rounded to 2 decimals."""
    return (mix
            .groupBy(F.col("entity"), hour_start(spec.time_col).alias("window_start"))
            .agg(round_half_away(exact_mean(spec.share_col)).alias(spec.share_col),
                 *[round_half_away(exact_mean(c)).alias(c) for c in spec.components]))


def _assemble(p: DataFrame, m: DataFrame, spec: MixSpec, computed_at) -> DataFrame:
    joined = p.join(m, KEY, "left")
    return joined.select(
        "entity", "window_start",
        plus_hours(F.col("window_start"), 1).alias("window_end"),
        "avg_price", "max_price", "min_price",
        spec.share_col, *spec.components,
        _computed_at(computed_at).alias("computed_at"),
    )


def gold_summary(prices: DataFrame, mix: DataFrame, spec: MixSpec = DEFAULT_MIX,
                 computed_at=None) -> DataFrame:
    """Hourly price statistics per entity, left-joined to the hourly mix averages.

    ``prices``: silver prices (entity, interval_start, price, ...).
    ``mix``: silver mix (entity, <time>, components..., share).
    Hours with prices but no mix keep null mix columns; mix-only hours are
    not reported.
    """
    return _assemble(hourly_prices(prices), hourly_mix(mix, spec), spec, computed_at)


def gold_one_pass(facts: DataFrame, categories, spec: MixSpec = DEFAULT_MIX, computed_at=None) -> DataFrame:
    """Gold from rows that carry both a price and a mix amount: one aggregate, no join of feeds.

    ``facts(entity, interval_start, price, category, amount, has_mix)``: the
    amounts of ``categories[i]`` in an hour make up component i. It equals
    ``gold_summary`` when each hour has at most one mix row, the sum of its
    amounts. Hours without a row that ``has_mix`` keep null mix columns.
    """
    comps = list(spec.components)
    rows = facts.groupBy("entity", hour_start("interval_start").alias("window_start")).agg(
        round_half_away(exact_mean("price")).alias("avg_price"),
        round_half_away(F.max("price")).alias("max_price"),
        round_half_away(F.min("price")).alias("min_price"),
        F.bool_or("has_mix").alias("__mixed"),
        *[exact_sum(F.when(F.col("category") == v, F.col("amount"))).alias(c) for v, c in zip(categories, comps)])
    rows = renewable_share(coerce_numeric(rows, comps), spec)
    return rows.select(
        "entity", "window_start", plus_hours(F.col("window_start"), 1).alias("window_end"),
        "avg_price", "max_price", "min_price",
        *[F.when(F.col("__mixed"), round_half_away(c)).alias(c) for c in [spec.share_col, *comps]],
        _computed_at(computed_at).alias("computed_at"))


def gold_incremental(prices: DataFrame, mix: DataFrame, existing_gold: DataFrame,
                     spec: MixSpec = DEFAULT_MIX, computed_at=None) -> DataFrame:
    """Gold rows for (entity, hour) pairs not yet in ``existing_gold``.

    First write wins: an hour already summarized is never recomputed, even if
    later rows for it arrive. Existing gold and the mix are pruned to the
    incoming time range, and to its dates when they are stored by date
    (``window_date``, ``event_date``).
    """
    # The NOT-IN predicate depends only on the group key, so filtering groups
    # after aggregating equals filtering rows before: the shuffle then moves
    # partial aggregates, and the anti-join sees one row per (entity, hour).
    b = prices.agg(F.struct(hour_start(F.min("interval_start")).alias("lo"),
                            plus_hours(hour_start(F.max("interval_start")), 1).alias("hi"))).scalar()
    lo, hi = b.getField("lo"), b.getField("hi")
    known = existing_gold.filter((F.col("window_start") >= lo) & (F.col("window_start") < hi))
    if "window_date" in existing_gold.columns:     # Spark derives no date range from a time range
        known = known.filter((F.col("window_date") >= F.to_date(lo)) & (F.col("window_date") <= F.to_date(hi)))
    agg = hourly_prices(prices).join(known.select(*KEY), KEY, "left_anti")
    m = mix.filter((F.col(spec.time_col) >= lo) & (F.col(spec.time_col) < hi))
    if "event_date" in mix.columns:
        m = m.filter((F.col("event_date") >= F.to_date(lo)) & (F.col("event_date") <= F.to_date(hi)))
    return _assemble(agg, hourly_mix(m, spec), spec, computed_at)


def append_gold(existing_gold: DataFrame, new_rows: DataFrame) -> DataFrame:
    """The gold table after an incremental insert."""
    return existing_gold.unionByName(new_rows.select(*existing_gold.columns))


def count_incomplete(gold: DataFrame, spec: MixSpec = DEFAULT_MIX, check: int = 3) -> DataFrame:
    """Rows where any of the first ``check`` components is null (one-row result)."""
    cond = None
    for c in spec.components[:check]:
        cond = F.col(c).isNull() if cond is None else (cond | F.col(c).isNull())
    return gold.agg(F.count_if(cond).alias("incomplete_rows"))


def evolve_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive schema evolution: rows of the old layout get nulls in new columns."""
    return new.unionByName(old, allowMissingColumns=True).select(*new.columns)


def gold_backfill(gold: DataFrame, mix: DataFrame, spec: MixSpec = DEFAULT_MIX) -> DataFrame:
    """Fill the mix columns of gold rows whose first component is null.

    Each such row gets every component and the share from the hourly averages
    of silver mix; rows whose hour has no mix stay null, so a rerun is safe and
    fills them once mix data arrives. Result is the whole new gold version
    (copy-on-write: write it to a new path, then switch).
    """
    filled = [spec.share_col, *spec.components]
    needs = F.col(spec.components[0]).isNull()
    # Only the hours of incomplete rows need mix averages: prune the mix scan
    # to their time range (one scalar subquery).
    b = gold.filter(needs).agg(F.struct(F.min("window_start").alias("lo"),
                                        plus_hours(F.max("window_start"), 1).alias("hi"))).scalar()
    m = mix.filter((F.col(spec.time_col) >= b.getField("lo")) & (F.col(spec.time_col) < b.getField("hi")))
    if "event_date" in mix.columns:       # stored by date: read those dates only
        m = m.filter(F.col("event_date").between(F.to_date(b.getField("lo")), F.to_date(b.getField("hi")))).drop("event_date")
    hourly = hourly_mix(m, spec).select(
        *KEY, *[F.col(c).alias(f"__new_{c}") for c in filled])
    joined = gold.join(hourly, KEY, "left")
    return joined.select(*[
        (F.when(needs, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in filled else F.col(c))
        for c in gold.columns
    ])


def write_gold(gold: DataFrame, path: str, mode: str = "append") -> None:
    """Write gold partitioned by window date (time filters prune partitions)."""
    (gold.withColumn("window_date", F.to_date("window_start"))
     .sortWithinPartitions("entity", "window_start")
     .write.mode(mode).partitionBy("window_date").parquet(path))


def read_gold(spark, path: str) -> DataFrame:
    """Read a gold dataset written in several layouts (``mergeSchema``)."""
    return spark.read.option("mergeSchema", "true").parquet(path)
