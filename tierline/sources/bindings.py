"""Bindings of the given tables to the entity / price / mix data model.

The given tables hold no market data, so each binding maps existing columns
onto the feeds by fixed rules. Every rule is a plain column expression, so the
same rule is written in the oracle SQL (see ``plans.oracle``), and all work
scales with the input tables.

* E (events): entity = event_type, price = value, one mix row per entity and
  15-minute bucket with six components c0..c5.
* X (dirty raw feeds): E dressed as raw source files, with API column names,
  text prices, broken values and repeated rows.
* S (star): lineitem -> supplier -> nation gives the entity, price per unit
  is the price, revenue by order priority per entity-day is the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions.numeric import exact_sum
from tierline.functions.time import instant
from tierline.settings import MixSpec
from tierline.sources.tables import read_table, session_memo

# --- fixed values: binding E ----------------------------------------------
E_MIX = MixSpec(components=("c0", "c1", "c2", "c3", "c4", "c5"), share_of=("c1", "c2"))
E_MIX_BUCKET_MINUTES = 15
E_MIX_LAG_HOURS = 1                     # the mix feed is an hour behind, so prices begin without a mix
E_SYNTHETIC_EVERY = 10                  # event_id % 10 = 0 -> market SYNTHETIC

# --- fixed values: binding S ----------------------------------------------
S_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
S_MIX = MixSpec(components=("p1", "p2", "p3", "p4", "p5"), share_of=("p1", "p2"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def _instant(c: str):
    return F.col(c).cast("timestamp")


def prices_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_memo(spark, ("prices_e", sf_dir), lambda: _prices_e(spark, sf_dir))


def _prices_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding E price feed, already in normalized (silver) shape."""
    ev = events(spark, sf_dir)
    start = _instant("ts")
    return ev.select(
        F.col("event_type").alias("entity"),
        start.alias("interval_start"),
        F.col("user_id").cast("string").alias("location"),
        F.when(F.col("user_id") % 2 == 0, F.lit("HUB")).otherwise(F.lit("NODE")).alias("location_type"),
        F.col("value").alias("price"),
        F.when(F.col("event_id") % E_SYNTHETIC_EVERY == 0, F.lit("SYNTHETIC"))
        .otherwise(F.lit("REAL")).alias("market"),
    )


def _bucket_start(ts, minutes: int):
    return F.date_trunc("hour", ts) + F.make_dt_interval(
        F.lit(0), F.lit(0), (F.floor(F.minute(ts) / minutes) * minutes).cast("int"), F.lit(0))


def raw_mix_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_memo(spark, ("raw_mix_e", sf_dir), lambda: _raw_mix_e(spark, sf_dir))


def _raw_mix_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding E mix feed before normalization: components may be null.

    One row per (event_type, 15-minute bucket); component i is the exact sum
    of ``value`` over the bucket's events with ``event_id % 6 = i``, stamped
    E_MIX_LAG_HOURS later, so gold has hours without a mix.
    """
    ev = events(spark, sf_dir)
    ts = _instant("ts")
    slot = F.col("event_id") % len(E_MIX.components)
    aggs = [
        exact_sum(F.when(slot == i, F.col("value"))).alias(name)
        for i, name in enumerate(E_MIX.components)
    ]
    lag = F.make_dt_interval(F.lit(0), F.lit(E_MIX_LAG_HOURS))
    return (ev
            .groupBy(F.col("event_type").alias("entity"),
                     (_bucket_start(ts, E_MIX_BUCKET_MINUTES) + lag).alias(E_MIX.time_col))
            .agg(*aggs))


def mix_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_memo(spark, ("mix_e", sf_dir), lambda: _mix_e(spark, sf_dir))


def _mix_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding E mix feed in silver shape (components filled, share derived)."""
    from tierline.operators.normalize import normalize_mix

    return normalize_mix(raw_mix_e(spark, sf_dir), mix=E_MIX, column_map={})


# --- binding X: raw, dirty feeds ---------------------------------------------

def _text_price(value, event_id):
    """Price as text, with broken values planted by fixed rules."""
    return (F.when(event_id % 97 == 0, F.lit("abc"))
            .when(event_id % 53 == 0, F.lit(""))
            .when(event_id % 59 == 0, F.lit("1e3"))
            .when(event_id % 61 == 0, F.lit("12.5f"))
            .when(event_id % 67 == 0, F.lit("1_000"))
            .when(event_id % 71 == 0, F.lit(None).cast("string"))
            .otherwise(F.format_string("%.2f", value)))


def _between(df: DataFrame, col: str, since, until) -> DataFrame:
    """Batch split by event time: since <= col < until (either bound optional)."""
    if since is not None:
        df = df.filter(F.col(col).cast("timestamp") >= instant(since))
    if until is not None:
        df = df.filter(F.col(col).cast("timestamp") < instant(until))
    return df


def _landed(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A raw feed batch as landed files: written once per session to the
    shared folder and read back, as the feed reaches the pipeline in production."""
    def land() -> DataFrame:
        from tierline.session import fresh_dir

        path = fresh_dir(spark, "landed-" + "-".join(str(k) for k in key[:1]))
        build().write.parquet(path)
        return spark.read.parquet(path)
    return session_memo(spark, key, land)


def raw_prices_x(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """Binding X raw price feed: API column names, text values, dirt, repeats.

    ``since``/``until`` cut the feed into arrival batches by event time; each
    batch is landed as files once per session and read from there.
    """
    return _landed(spark, ("raw_prices_x", sf_dir, since, until),
                   lambda: _raw_prices_x(spark, sf_dir, since, until))


def _raw_prices_x(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    ev = _between(events(spark, sf_dir), "ts", since, until)
    eid = F.col("event_id")
    ts = _instant("ts")
    rows = ev.select(
        F.when(eid % 89 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("entity"),
        F.when(eid % 7 == 0, F.lit(None).cast("string"))
        .when((eid % 101 == 0) & (F.col("event_type") == "error"), F.lit("not a time"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("Interval Start"),
        F.when(eid % 7 == 0, ts).alias("time"),
        F.when(eid % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("user_id").cast("string")).alias("Location"),
        F.when(F.col("user_id") % 2 == 0, F.lit("HUB")).otherwise(F.lit("NODE")).alias("Location Type"),
        _text_price(F.col("value"), eid).alias("LMP"),
        F.when(eid % 10 == 0, F.lit("SYNTHETIC"))
        .when(eid % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.lit("REAL")).alias("Market"),
        F.col("value").alias("energy"),
        F.lit(0.0).alias("congestion"),
        eid.alias("event_id"),
    )
    repeats = rows.filter(eid % 83 == 0)
    return rows.unionByName(repeats).drop("event_id")


_X_MIX_NAMES = ("Natural Gas", "Wind", "Solar", "Coal", "Nuclear", "Other")


def raw_mix_x(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """Binding X raw mix feed batch, landed as files once per session (see raw_prices_x)."""
    return _landed(spark, ("raw_mix_x", sf_dir, since, until),
                   lambda: _raw_mix_x(spark, sf_dir, since, until))


def _raw_mix_x(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """Binding X raw mix feed: E's buckets with API names and text values.

    Broken values are planted by bucket time: day-of-month % 5 = 0 at minute
    45 gives 'n/a' wind; day % 7 = 0 at minute 30 drops the Other column value.
    """
    raw = _between(raw_mix_e(spark, sf_dir), E_MIX.time_col, since, until)
    t = F.col(E_MIX.time_col)
    cols = [F.col("entity"), F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("Time")]
    for src, name in zip(E_MIX.components, _X_MIX_NAMES):
        text = F.format_string("%.2f", F.col(src))
        if name == "Wind":
            text = F.when((F.dayofmonth(t) % 5 == 0) & (F.minute(t) == 45), F.lit("n/a")).otherwise(text)
        if name == "Other":
            text = F.when((F.dayofmonth(t) % 7 == 0) & (F.minute(t) == 30), F.lit(None).cast("string")).otherwise(text)
        cols.append(F.when(F.col(src).isNotNull(), text).alias(name))
    return raw.select(*cols)


# --- binding S: star schema ----------------------------------------------------

def _supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> nation name; both sides are dimension tables (bounded size)."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return sup.join(nat, sup.s_nationkey == nat.n_nationkey).select("s_suppkey", "n_name")


def prices_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_memo(spark, ("prices_s", sf_dir), lambda: _prices_s(spark, sf_dir))


def _prices_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    sn = _supplier_nation(spark, sf_dir)
    return li.join(sn, li.l_suppkey == sn.s_suppkey).select(
        F.col("n_name").alias("entity"),
        _instant("l_shipdate").alias("interval_start"),
        F.col("l_suppkey").cast("string").alias("location"),
        F.lit("SUPPLIER").alias("location_type"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        F.lit("REAL").alias("market"),
    )


def facts_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with their unit price and their revenue by order priority (orders: one row a key).

    Both feeds of the star binding in one read of each table; a ship date is a
    day, so a day's prices and its mix fall in the same hour.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    sn = _supplier_nation(spark, sf_dir)
    rows = li.join(sn, li.l_suppkey == sn.s_suppkey).join(od, li.l_orderkey == od.o_orderkey, "left")
    return rows.select(
        F.col("n_name").alias("entity"),
        F.date_trunc("day", _instant("l_shipdate")).cast("timestamp").alias("interval_start"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        F.col("o_orderpriority").alias("category"),
        F.col("l_extendedprice").alias("amount"),
        F.col("o_orderkey").isNotNull().alias("has_mix"),
    )


def raw_mix_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_memo(spark, ("raw_mix_s", sf_dir), lambda: _raw_mix_s(spark, sf_dir))


def _raw_mix_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by order priority per entity-day (lineitem x orders x supplier x nation)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    sn = _supplier_nation(spark, sf_dir)
    joined = (li.join(od, li.l_orderkey == od.o_orderkey)
              .join(sn, li.l_suppkey == sn.s_suppkey))
    aggs = [
        exact_sum(F.when(F.col("o_orderpriority") == p, F.col("l_extendedprice"))).alias(name)
        for p, name in zip(S_PRIORITIES, S_MIX.components)
    ]
    return (joined.groupBy(F.col("n_name").alias("entity"),
                           F.date_trunc("day", _instant("l_shipdate")).cast("timestamp").alias(S_MIX.time_col))
            .agg(*aggs))


def mix_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_memo(spark, ("mix_s", sf_dir), lambda: _mix_s(spark, sf_dir))


def _mix_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tierline.operators.normalize import normalize_mix

    return normalize_mix(raw_mix_s(spark, sf_dir), mix=S_MIX, column_map={})
