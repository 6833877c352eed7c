"""Reads of gold for the live view: latest rows, lookback ranges, history.

Gold holds one row per entity and hour, so its size grows with the history
length and the number of entities, not with the raw feed volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tierline.functions.time import instant, zone_transitions
from tierline.settings import (
    DEFAULT_MIX,
    DEFAULT_ROW_LIMIT,
    ENTITY_TIME_ZONES,
    LOOKBACK_HOURS,
    PRICE_ELEVATED_MAX,
    PRICE_NORMAL_MAX,
    WINDOW_LABEL_PREFIX,
    ZONE_ABBREVIATIONS,
    MixSpec,
)


def latest_window(gold: DataFrame):
    """Scalar subquery: the global latest window_start."""
    return gold.select(F.max("window_start")).scalar()


def latest_rows(gold: DataFrame) -> DataFrame:
    """Rows at the global latest window (entities without a row there drop out)."""
    return gold.filter(F.col("window_start") == latest_window(gold))


def latest_per_entity(gold: DataFrame) -> DataFrame:
    """Each entity's own latest row.

    A max over a struct led by window_start is an ordinary aggregate, so it
    combines map-side and a hot entity costs one row per partition.
    """
    others = [c for c in gold.columns if c not in ("entity", "window_start")]
    best = F.max(F.struct("window_start", *others)).alias("r")
    return gold.groupBy("entity").agg(best).select("entity", "r.window_start", *[f"r.{c}" for c in others])


def snapshot_lookback(gold: DataFrame, hours: int = LOOKBACK_HOURS, mix: MixSpec = DEFAULT_MIX) -> DataFrame:
    """Latest row per entity with the min/max hourly average over the last ``hours``.

    Both the lookback filter and the latest-row filter use one scalar subquery
    (the global latest window), which Spark computes once and reuses.
    """
    latest = latest_window(gold)
    lookback = (gold.filter(F.col("window_start") >= latest - F.make_interval(hours=F.lit(hours)))
                .groupBy("entity")
                .agg(F.min("avg_price").alias("range_min"), F.max("avg_price").alias("range_max")))
    cur = gold.filter(F.col("window_start") == latest)
    extra = [c for c in (mix.share_col, *mix.components, "computed_at") if c in gold.columns]
    return (cur.join(lookback, "entity")
            .select("entity", "window_start", "window_end", "avg_price", "range_min", "range_max", *extra)
            .orderBy("entity"))


def price_history(gold: DataFrame) -> DataFrame:
    return gold.select("entity", "window_start", "avg_price").orderBy("entity", "window_start")


def mix_history(gold: DataFrame, mix: MixSpec = DEFAULT_MIX) -> DataFrame:
    extra = [c for c in (mix.share_col, *mix.components) if c in gold.columns]
    return gold.select("entity", "window_start", "window_end", "avg_price", *extra).orderBy("entity", "window_start")


def filter_entities(df: DataFrame, entities: list[str]) -> DataFrame:
    """Entity membership; on a scan this is pushed into the Parquet reader."""
    return df.filter(F.col("entity").isin(*entities))


def filter_time_range(df: DataFrame, start, end, col: str = "window_start",
                      partition_col: str = "window_date") -> DataFrame:
    """Inclusive time range; naive bounds are read as UTC (the session zone).

    On a table stored by ``partition_col`` (the date of ``col``) only the
    range's partitions are read.
    """
    lo, hi = instant(start), instant(end)
    rows = df.filter(F.col(col).between(lo, hi))
    if partition_col in df.columns:
        rows = rows.filter(F.col(partition_col).between(F.to_date(lo), F.to_date(hi)))
    return rows


def head_per_entity(df: DataFrame, n: int = DEFAULT_ROW_LIMIT,
                    order: tuple[str, ...] = ("interval_start", "location", "price")) -> DataFrame:
    """First ``n`` rows per entity in a fixed order (the fetch cap, made deterministic).

    ``row_number() <= n`` lets Spark insert a partial group limit before the
    shuffle, so at most ``n`` rows per entity and input partition move.
    """
    w = Window.partitionBy("entity").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def price_band(df: DataFrame, col: str = "avg_price", normal_max: float = PRICE_NORMAL_MAX,
               elevated_max: float = PRICE_ELEVATED_MAX) -> DataFrame:
    """Static display band of a price: normal / off / inverse."""
    band = (F.when(F.col(col) < normal_max, F.lit("normal"))
            .when(F.col(col) < elevated_max, F.lit("off"))
            .when(F.col(col).isNotNull(), F.lit("inverse")))
    return df.withColumn("band", band)


def zone_table(spark, zones: dict[str, str] | None = None) -> DataFrame:
    """Entity -> IANA zone with its standard offset and abbreviations: a fixed
    small table (safe to broadcast)."""
    zones = ENTITY_TIME_ZONES if zones is None else zones
    rows = [(e, z, *ZONE_ABBREVIATIONS.get(z, (None, None, None))) for e, z in sorted(zones.items())]
    schema = T.StructType([T.StructField("entity", T.StringType()), T.StructField("tz", T.StringType()),
                           T.StructField("std_offset", T.IntegerType()), T.StructField("std_abbr", T.StringType()),
                           T.StructField("dst_abbr", T.StringType())])
    return spark.createDataFrame(rows, schema)


def local_window(rows: DataFrame, zones: DataFrame, hours: int = LOOKBACK_HOURS) -> DataFrame:
    """Lookback window of each row in the entity's local time, with a label
    ending in the zone abbreviation at the window end.

    Spark formats instants in the session zone only, so the abbreviation is
    derived: the local UTC offset at the window end is compared with the
    zone's standard offset (daylight time when they differ). Zones without an
    abbreviation get ``UTC±hh:mm``; entities without a zone use UTC. Spark
    broadcasts the zone table by its size.
    """
    utc = ZONE_ABBREVIATIONS["UTC"]
    tz = F.coalesce(F.col("tz"), F.lit("UTC"))
    end = F.col("window_end")
    start = end - F.make_interval(hours=F.lit(hours))
    fmt = "MMM dd hh:mma"
    j = rows.join(zones, "entity", "left")
    local_start = F.from_utc_timestamp(start, tz)
    local_end = F.from_utc_timestamp(end, tz)
    offset = ((F.unix_micros(local_end) - F.unix_micros(end)) / F.lit(60_000_000)).cast("int")
    std = F.coalesce(F.col("std_offset"), F.when(F.col("tz").isNull(), F.lit(utc[0])))
    fallback = F.format_string("UTC%s%02d:%02d", F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")),
                               F.floor(F.abs(offset) / 60).cast("int"), F.abs(offset) % 60)
    abbr = (F.when(F.col("tz").isNull(), F.lit(utc[1]))
            .when(std.isNull(), fallback)
            .when(offset == std, F.col("std_abbr"))
            .otherwise(F.col("dst_abbr")))
    label = F.concat(F.lit(WINDOW_LABEL_PREFIX), F.date_format(local_start, fmt), F.lit(" to "),
                     F.date_format(local_end, fmt), F.lit(" "), abbr)
    return j.select(
        "entity", "window_end", tz.alias("tz"),
        local_start.alias("local_start"), local_end.alias("local_end"),
        abbr.alias("zone_abbr"), label.alias("label"),
    )


def zone_clock_table(spark, zones: dict[str, str], first_year: int = 1970, last_year: int = 2037) -> DataFrame:
    """Entity -> zone -> the intervals of its clock (see ``functions.time.zone_transitions``); zones may be any of the tz database."""
    clocks = spark.createDataFrame(zone_transitions(list(zones.values()), first_year, last_year),
                                   "tz string, from_s long, to_s long, offset int, abbr string")
    return spark.createDataFrame(sorted(zones.items()), "entity string, tz string").join(clocks, "tz")


def local_window_any_zone(rows: DataFrame, clocks: DataFrame, hours: int = LOOKBACK_HOURS) -> DataFrame:
    """Lookback window of each row in its entity's local time, labelled with the zone abbreviation in force at the window end.

    Joined on the entity, with the interval that holds the instant as a further
    condition: a row meets the few intervals of its own zone. Entities without a
    zone use UTC; instants outside the table's years have a null abbreviation.
    """
    end_s = F.floor(F.unix_micros("window_end") / 1_000_000)
    names = clocks.select("entity", "tz").distinct()
    zoned = rows.select("entity", "window_end").join(names, "entity", "left")
    c = clocks.drop("tz").withColumnRenamed("entity", "c_entity")
    j = zoned.join(c, (F.col("entity") == F.col("c_entity")) & (end_s >= F.col("from_s")) & (end_s < F.col("to_s")), "left")
    tz = F.coalesce(F.col("tz"), F.lit("UTC"))
    abbr = F.when(F.col("tz").isNull(), F.lit("UTC")).otherwise(F.col("abbr"))
    local_start = F.from_utc_timestamp(F.col("window_end") - F.make_interval(hours=F.lit(hours)), tz)
    local_end = F.from_utc_timestamp(F.col("window_end"), tz)
    fmt = "MMM dd hh:mma"
    label = F.concat(F.lit(WINDOW_LABEL_PREFIX), F.date_format(local_start, fmt), F.lit(" to "), F.date_format(local_end, fmt),
                     F.lit(" "), abbr)
    return j.select("entity", "window_end", tz.alias("tz"), local_start.alias("local_start"), local_end.alias("local_end"),
                    abbr.alias("zone_abbr"), label.alias("label"))


def status_board(rows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Latest rows with their anomaly status; entities without a result are grey."""
    a = anomalies.select("entity", "status", "z_score")
    return (rows.join(a, "entity", "left")
            .select("entity", "window_start", "avg_price",
                    F.coalesce(F.col("status"), F.lit("grey")).alias("status"), "z_score"))

