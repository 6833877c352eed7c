"""Data health checks as one-row (or one-row-per-entity) DataFrames.

Every check is an aggregate over the dataset it judges; "now" is a parameter
(``as_of``) so results are reproducible, defaulting to the current time.
A check row is (check, status, message, value) with status ok/warning/error.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.functions.numeric import round_half_away
from tierline.functions.time import instant, minutes_between
from tierline.settings import (
    CHECK_DOMAINS,
    MSG_FRESH_NONE,
    MSG_FRESH_OK,
    MSG_FRESH_STALE,
    MSG_GAP_FOUND,
    MSG_GAP_NONE,
    MSG_GAP_OK,
    MSG_LAYERS_EMPTY,
    MSG_LAYERS_OK,
    MSG_SCHEMA_MISSING,
    MSG_SCHEMA_OK,
    MSG_SIZE_ERROR,
    MSG_SIZE_OK,
    MSG_SIZE_WARNING,
    MSG_SPACING_FOUND,
    MSG_SPACING_NONE,
    MSG_SPACING_OK,
    FRESHNESS_ERROR_MINUTES,
    FRESHNESS_WARNING_MINUTES,
    POLL_INTERVAL_MINUTES,
    SIZE_ERROR_GB,
    SIZE_WARNING_GB,
)

CHECK_COLUMNS = ["check", "status", "message", "value"]


def _as_of(value) -> Column:
    if value is None:
        return F.current_timestamp()
    return instant(value)


def last_ingest(bronze: DataFrame, table: str, col: str = "ingested_at") -> DataFrame:
    """The latest arrival instant of a table (null when empty)."""
    return bronze.agg(F.max(col).cast("timestamp").alias("last_ingested_at")).select(
        F.lit(table).alias("table"), "last_ingested_at")


def freshness_status(bronze: DataFrame, as_of=None, warning: float = FRESHNESS_WARNING_MINUTES,
                     error: float = FRESHNESS_ERROR_MINUTES, col: str = "ingested_at") -> DataFrame:
    """Minutes since the last arrival: >= error -> error, >= warning -> warning."""
    last = bronze.agg(F.max(col).cast("timestamp").alias("last"))
    gap = round_half_away(minutes_between(_as_of(as_of), F.col("last")), 1)
    stale = F.format_string(MSG_FRESH_STALE, gap)
    status = (F.when(F.col("last").isNull(), F.lit("warning"))
              .when(gap >= error, F.lit("error")).when(gap >= warning, F.lit("warning")).otherwise(F.lit("ok")))
    message = (F.when(F.col("last").isNull(), F.lit(MSG_FRESH_NONE))
               .when(gap >= warning, stale)
               .otherwise(F.format_string(MSG_FRESH_OK, gap)))
    return last.select(F.lit("last_ingest").alias("check"), status.alias("status"), message.alias("message"),
                       gap.alias("value"), F.col("last").alias("last_ingested_at"))


def missed_intervals(bronze: DataFrame, table: str, as_of=None, poll_minutes: float = POLL_INTERVAL_MINUTES,
                     col: str = "ingested_at") -> DataFrame:
    """Polls missed since the last arrival: int(gap / poll) - 1 when above 1."""
    last = bronze.agg(F.max(col).cast("timestamp").alias("last"))
    gap = minutes_between(_as_of(as_of), F.col("last"))
    ratio = gap / F.lit(float(poll_minutes))
    expected = F.when(ratio >= 0, F.floor(ratio)).otherwise(F.ceil(ratio))
    has_gap = F.coalesce(expected > 1, F.lit(False))
    g1 = round_half_away(gap, 1)
    message = (F.when(F.col("last").isNull(), F.lit(MSG_GAP_NONE))
               .when(has_gap, F.format_string(MSG_GAP_FOUND, expected - 1, g1))
               .otherwise(F.format_string(MSG_GAP_OK, g1)))
    return last.select(
        F.lit(table).alias("table"), F.col("last").alias("last_ingested_at"), g1.alias("gap_minutes"),
        F.when(F.col("last").isNotNull(), F.greatest(expected - 1, F.lit(0))).cast("bigint").alias("missed_intervals"),
        has_gap.alias("has_gap"), message.alias("message"))


def layer_row_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """(position, layer, rows) for each named dataset: one count aggregate each."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("position"),
                                                             F.lit(name).alias("layer"), "rows")
             for i, (name, df) in enumerate(layers.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def layer_totals(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """(layer, table, rows) per table, per layer (table null) and over all (both null), tables as (layer, name).

    One count aggregate a table, then one ROLLUP over the few counts.
    """
    counts = None
    for (layer, name), df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(layer).alias("layer"), F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts.rollup("layer", "table").agg(F.sum("rows").alias("rows"))


def layer_status(totals: DataFrame, order: list[str], summary_layer: str = "gold") -> DataFrame:
    """Row check of whole layers: a warning naming the layers without a row in any table, else ok with the summary layer's rows."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("layer"))
    layers = totals.filter(F.col("layer").isNotNull() & F.col("table").isNull()).select(
        rank.cast("int").alias("position"), "layer", "rows")
    return row_count_status(layers, summary_layer)


def row_count_status(counts: DataFrame, summary_layer: str = "gold") -> DataFrame:
    """Warning naming the empty layers, else ok with the summary layer's rows."""
    agg = counts.agg(
        F.sort_array(F.collect_list(F.when(F.col("rows") == 0, F.struct("position", "layer")))).alias("empty"),
        F.max(F.when(F.col("layer") == summary_layer, F.col("rows"))).alias("summary_rows"),
    )
    names = F.array_join(F.transform("empty", lambda s: s["layer"]), ", ")
    any_empty = F.size("empty") > 0
    return agg.select(
        F.lit("row_counts").alias("check"),
        F.when(any_empty, F.lit("warning")).otherwise(F.lit("ok")).alias("status"),
        F.when(any_empty, F.concat(F.lit(MSG_LAYERS_EMPTY), names))
        .otherwise(F.format_string(MSG_LAYERS_OK, F.lit(summary_layer),
                                   F.col("summary_rows"))).alias("message"),
        F.col("summary_rows").cast("double").alias("value"),
    )


def gap_by_entity(gold: DataFrame, expected_minutes: float = POLL_INTERVAL_MINUTES) -> DataFrame:
    """Average spacing of gold rows per entity; a gap when above 2x expected."""
    agg = gold.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"),
                                     F.min("window_start").alias("earliest"),
                                     F.max("window_start").alias("latest"))
    spacing = round_half_away(minutes_between(F.col("latest"), F.col("earliest"))
                              / F.nullif(F.col("rows") - 1, F.lit(0)), 1)
    return agg.select("entity", "rows", "earliest", "latest", spacing.alias("avg_interval_minutes"),
                      F.coalesce((spacing > 0) & (spacing > 2 * expected_minutes), F.lit(False)).alias("has_gap"))


def data_gap_status(gaps: DataFrame) -> DataFrame:
    agg = gaps.agg(F.count(F.lit(1)).alias("n"), F.count_if("has_gap").alias("gaps"))
    status = (F.when(F.col("n") == 0, F.lit("warning")).when(F.col("gaps") > 0, F.lit("warning"))
              .otherwise(F.lit("ok")))
    message = (F.when(F.col("n") == 0, F.lit(MSG_SPACING_NONE))
               .when(F.col("gaps") > 0, F.format_string(MSG_SPACING_FOUND, F.col("gaps")))
               .otherwise(F.lit(MSG_SPACING_OK)))
    return agg.select(F.lit("data_gap").alias("check"), status.alias("status"), message.alias("message"),
                      F.col("gaps").cast("double").alias("value"))


def date_ranges_by_category(silver_prices: DataFrame, synthetic: str = "SYNTHETIC") -> DataFrame:
    """Rows and time range per entity and market, labelled synthetic / real."""
    return (silver_prices.groupBy("entity", "market")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("interval_start").alias("earliest"),
                 F.max("interval_start").alias("latest"))
            .withColumn("data_type", F.when(F.col("market") == synthetic, F.lit("synthetic")).otherwise(F.lit("real")))
            .orderBy("entity", "market"))


def gold_date_ranges(gold: DataFrame) -> DataFrame:
    return (gold.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), F.min("window_start").alias("earliest"),
                                       F.max("window_start").alias("latest"))
            .orderBy("entity"))


def dataset_size(spark, path: str, glob: str = "*.parquet") -> DataFrame:
    """Stored bytes and file count of a dataset folder (one row).

    The files are listed by the binary-file source without reading their
    content, so the work grows with the number of files, not of rows.
    """
    from tierline.operators.retention import list_files

    return list_files(spark, path, glob).agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.count(F.lit(1)).alias("files"))


def logical_size(df: DataFrame) -> DataFrame:
    """Bytes of a table's values (one row): the octets of text, 8 for any other value, 0 for null."""
    width = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if isinstance(f.dataType, T.StringType)
             else F.when(F.col(f.name).isNotNull(), F.lit(8)).otherwise(F.lit(0)) for f in df.schema.fields]
    return df.agg(F.coalesce(F.sum(reduce(add, width)), F.lit(0)).cast("bigint").alias("size_bytes"))


def dataset_size_status(sizes: DataFrame, warning_gb: float = SIZE_WARNING_GB,
                        error_gb: float = SIZE_ERROR_GB) -> DataFrame:
    gb = round_half_away(F.col("size_bytes") / F.lit(1024.0 ** 3), 2)
    mb = round_half_away(F.col("size_bytes") / F.lit(1024.0 ** 2), 1)
    status = F.when(gb >= error_gb, F.lit("error")).when(gb >= warning_gb, F.lit("warning")).otherwise(F.lit("ok"))
    message = (F.when(gb >= error_gb, F.format_string(MSG_SIZE_ERROR, gb))
               .when(gb >= warning_gb, F.format_string(MSG_SIZE_WARNING, gb))
               .otherwise(F.format_string(MSG_SIZE_OK, mb)))
    return sizes.select(F.lit("dataset_size").alias("check"), status.alias("status"), message.alias("message"),
                        mb.alias("value"), *sizes.columns)


def schema_check(df: DataFrame, expected: list[str], name: str = "schema") -> DataFrame:
    """Expected columns present? (the guard a reader runs before using a table)."""
    missing = [c for c in expected if c not in df.columns]
    status = "warning" if missing else "ok"
    message = (MSG_SCHEMA_MISSING + ", ".join(missing)) if missing else MSG_SCHEMA_OK
    return df.sparkSession.range(1).select(     # the schema alone decides: no row is read
        F.lit(name).alias("check"), F.lit(status).alias("status"), F.lit(message).alias("message"),
        F.lit(float(len(expected) - len(missing))).alias("value"))


def health_report(*checks: DataFrame) -> DataFrame:
    """Stack check rows into (check, status, message, value)."""
    rows = [c.select("check", "status", "message", F.col("value").cast("double").alias("value")) for c in checks]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def domain_table(spark, domains: dict[str, str] | None = None) -> DataFrame:
    domains = CHECK_DOMAINS if domains is None else domains
    schema = T.StructType([T.StructField("check", T.StringType()), T.StructField("domain", T.StringType())])
    return spark.createDataFrame(sorted(domains.items()), schema)


def health_rollup(report: DataFrame, domains: DataFrame) -> DataFrame:
    """Severity counts, overall status and the domains at that severity.

    Both sides are small; Spark broadcasts the domains by their size.
    """
    j = report.join(domains, "check", "left").withColumn(
        "domain", F.coalesce(F.col("domain"), F.col("check")))
    agg = j.agg(F.count(F.lit(1)).alias("checks"),
                F.count_if(F.col("status") == "error").alias("errors"),
                F.count_if(F.col("status") == "warning").alias("warnings"),
                F.collect_set(F.when(F.col("status") == "error", F.col("domain"))).alias("err_domains"),
                F.collect_set(F.when(F.col("status") == "warning", F.col("domain"))).alias("warn_domains"))
    overall = (F.when(F.col("errors") > 0, F.lit("error")).when(F.col("warnings") > 0, F.lit("warning"))
               .otherwise(F.lit("ok")))
    affected = (F.when(F.col("errors") > 0, F.array_join(F.array_sort("err_domains"), ", "))
                .when(F.col("warnings") > 0, F.array_join(F.array_sort("warn_domains"), ", "))
                .otherwise(F.lit("")))
    return agg.select("checks", "errors", "warnings", overall.alias("overall"), affected.alias("domains"))


def entity_coverage(observed: DataFrame, configured: list[str]) -> DataFrame:
    """Configured entities against the entities seen in the data."""
    spark = observed.sparkSession
    conf = spark.createDataFrame([(e,) for e in configured], "entity string").withColumn("configured", F.lit(True))
    seen = observed.select("entity").filter(F.col("entity").isNotNull()).distinct().withColumn("observed", F.lit(True))
    j = conf.join(seen, "entity", "full_outer")
    c, o = F.coalesce(F.col("configured"), F.lit(False)), F.coalesce(F.col("observed"), F.lit(False))
    status = F.when(c & o, F.lit("active")).when(c, F.lit("not observed")).otherwise(F.lit("not configured"))
    return j.select("entity", c.alias("configured"), o.alias("observed"), status.alias("status"))
