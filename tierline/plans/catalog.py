"""The query registry: each entry binds an operator to the given tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables. ``plans.oracle.ORACLE`` holds the DuckDB statement of the
same query under the same name.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions.time import instant, plus_minutes
from tierline.operators import anomaly as Z
from tierline.operators import bronze as BR
from tierline.operators import contracts as CT
from tierline.operators import distribution as D
from tierline.operators import gold as G
from tierline.operators import health as H
from tierline.operators import normalize as N
from tierline.operators import retention as R
from tierline.operators import silver as SV
from tierline.operators import snapshot as SN
from tierline.operators import summaries as SU
from tierline.session import ensure_session, fresh_dir
from tierline.settings import DEFAULT_MIX, MIX_CONTRACT, PRICE_COLUMN_MAP, PRICE_CONTRACT, PRICE_SILVER_COLUMNS
from tierline.sources import bindings as B
from tierline.sources import landing as L
from tierline.sources.tables import session_memo
from tierline.streaming import feeds as ST

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

# Load time pinned for reproducible results (production passes None -> now()).
COMPUTED_AT = dt.datetime(2024, 2, 1, 0, 0, 0)


def as_wall_clock(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock TIMESTAMP_NTZ at the result boundary.

    Operators work on TIMESTAMP instants; a result handed to another engine or
    to Python is given as naive UTC time (the SQL TIMESTAMP type), so it reads
    the same whatever the reader's local time zone.
    """
    from pyspark.sql import types as T

    cols = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz")
            for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.withColumns(cols) if cols else df


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_session(spark)
            return as_wall_clock(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run
    return deco


def compute_gold_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gold_summary(B.prices_e(spark, sf_dir), B.mix_e(spark, sf_dir), B.E_MIX, computed_at=COMPUTED_AT)


def mix_table_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding-E silver mix as a stored table (written once per session, read back),
    for the jobs that maintain gold from silver."""
    def build() -> DataFrame:
        path = fresh_dir(spark, "silver-mix-e")
        B.mix_e(spark, sf_dir).write.parquet(path)
        return spark.read.parquet(path)
    return session_memo(spark, ("mix_table_e", sf_dir), build)


def gold_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding-E gold as a stored table: the input of every analytics query.

    Written once per session to the shared folder (sorted by entity and time
    inside each file, so row-group statistics prune entity and time filters)
    and read back, as the analytics read the gold layer in production.
    """
    def build() -> DataFrame:
        path = fresh_dir(spark, "gold-e")
        compute_gold_e(spark, sf_dir).sortWithinPartitions("entity", "window_start").write.parquet(path)
        return spark.read.parquet(path)
    return session_memo(spark, ("gold_e", sf_dir), build)


def gold_by_date_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding-E gold stored by ``window_date``: the input of range reads."""
    def build() -> DataFrame:
        path = fresh_dir(spark, "gold-by-date-e")
        G.write_gold(gold_e(spark, sf_dir), path)
        return spark.read.parquet(path)
    return session_memo(spark, ("gold_by_date_e", sf_dir), build)


def prices_by_date_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding-E silver prices stored by ``event_date``."""
    def build() -> DataFrame:
        path = fresh_dir(spark, "silver-prices-e")
        SV.append(B.prices_e(spark, sf_dir), path, SV.DATE_COL, "interval_start")
        return spark.read.parquet(path)
    return session_memo(spark, ("prices_by_date_e", sf_dir), build)


@query("gold_summary")
def q_gold_summary(spark, sf_dir):
    """Hourly price avg/max/min per entity left-joined to hourly mix averages."""
    return compute_gold_e(spark, sf_dir)


@query("gold_summary_star")
def q_gold_summary_star(spark, sf_dir):
    """Gold over the star binding (unit prices, revenue by order priority) in one aggregate."""
    return G.gold_one_pass(B.facts_s(spark, sf_dir), B.S_PRIORITIES, B.S_MIX, computed_at=COMPUTED_AT)


@query("gold_summary_star_feeds")
def q_gold_summary_star_feeds(spark, sf_dir):
    """The same gold from the star binding's two separate feeds."""
    return G.gold_summary(B.prices_s(spark, sf_dir), B.mix_s(spark, sf_dir), B.S_MIX,
                          computed_at=COMPUTED_AT)


@query("land_prices")
def q_land_prices(spark, sf_dir):
    """The landed price feed (binding E), one schema."""
    return B.prices_e(spark, sf_dir)


@query("land_mix")
def q_land_mix(spark, sf_dir):
    """The landed mix feed (binding E) before normalization."""
    return B.raw_mix_e(spark, sf_dir)


# --- snapshot and history (gold E) ---------------------------------------------

SELECTED_ENTITIES = ["click", "purchase", "view"]
RANGE_START = "2024-01-10 00:00:00"
RANGE_END = "2024-01-20 23:00:00"
# fixed values: zones of the binding-E entities; 'error' has none (UTC)
E_ZONES = {"click": "America/Chicago", "purchase": "America/New_York",
           "signup": "America/Los_Angeles", "view": "Europe/Berlin"}


@query("latest_rows")
def q_latest_rows(spark, sf_dir):
    """Gold rows at the global latest window."""
    return SN.latest_rows(gold_e(spark, sf_dir))


@query("latest_per_entity")
def q_latest_per_entity(spark, sf_dir):
    """Each entity's own latest gold row."""
    return SN.latest_per_entity(gold_e(spark, sf_dir))


@query("snapshot_lookback")
def q_snapshot_lookback(spark, sf_dir):
    """Latest row per entity with the 48 h min/max of the hourly average."""
    return SN.snapshot_lookback(gold_e(spark, sf_dir), 48, B.E_MIX)


@query("price_history")
def q_price_history(spark, sf_dir):
    return SN.price_history(gold_e(spark, sf_dir))


@query("mix_history")
def q_mix_history(spark, sf_dir):
    return SN.mix_history(gold_e(spark, sf_dir), B.E_MIX)


@query("filter_entities")
def q_filter_entities(spark, sf_dir):
    return SN.filter_entities(gold_e(spark, sf_dir), SELECTED_ENTITIES)


@query("filter_time_range")
def q_filter_time_range(spark, sf_dir):
    """Gold rows of a time range, read from gold stored by window date."""
    return SN.filter_time_range(gold_by_date_e(spark, sf_dir), RANGE_START, RANGE_END).drop("window_date")


@query("head_per_entity")
def q_head_per_entity(spark, sf_dir):
    """First 10 price rows per entity in time order (the per-fetch cap)."""
    return SN.head_per_entity(B.prices_e(spark, sf_dir), 10)


@query("price_band")
def q_price_band(spark, sf_dir):
    g = gold_e(spark, sf_dir)
    return SN.price_band(g).select("entity", "window_start", "avg_price", "band")


@query("local_window")
def q_local_window(spark, sf_dir):
    """Latest rows' 48 h window in each entity's local time."""
    rows = SN.latest_rows(gold_e(spark, sf_dir))
    return SN.local_window(rows, SN.zone_table(spark, E_ZONES), 48)


@query("status_board")
def q_status_board(spark, sf_dir):
    g = gold_e(spark, sf_dir)
    return SN.status_board(SN.latest_rows(g), Z.anomaly_scores(g))


# --- anomaly (gold E) -----------------------------------------------------------
@query("anomaly_baseline")
def q_anomaly_baseline(spark, sf_dir):
    return Z.anomaly_baseline(gold_e(spark, sf_dir))


@query("anomaly_scores")
def q_anomaly_scores(spark, sf_dir):
    return Z.anomaly_scores(gold_e(spark, sf_dir))


# --- distributions (gold E) -----------------------------------------------------
@query("price_cdf")
def q_price_cdf(spark, sf_dir):
    return D.price_cdf(gold_e(spark, sf_dir))


@query("price_histogram")
def q_price_histogram(spark, sf_dir):
    return D.price_histogram(gold_e(spark, sf_dir), bins=20)


@query("box_stats")
def q_box_stats(spark, sf_dir):
    return D.box_stats(gold_e(spark, sf_dir))


@query("box_outliers")
def q_box_outliers(spark, sf_dir):
    return D.box_outliers(gold_e(spark, sf_dir))


@query("quantile_spread")
def q_quantile_spread(spark, sf_dir):
    return D.quantile_spread(gold_e(spark, sf_dir))


@query("mix_timeseries")
def q_mix_timeseries(spark, sf_dir):
    return D.mix_timeseries(gold_e(spark, sf_dir), B.E_MIX)


@query("mix_share")
def q_mix_share(spark, sf_dir):
    return D.mix_share(gold_e(spark, sf_dir), B.E_MIX)


@query("history_summary")
def q_history_summary(spark, sf_dir):
    """Date range, rows, entities and hours per entity of the whole history."""
    return D.history_summary(gold_e(spark, sf_dir))


@query("hours_per_selected")
def q_hours_per_selected(spark, sf_dir):
    """Rows and hours per entity of the selected entities."""
    g = SN.filter_entities(gold_e(spark, sf_dir), SELECTED_ENTITIES)
    return D.history_summary(g, entities=len(SELECTED_ENTITIES)).select("rows", "hours_per_entity")


# --- normalization, contracts, silver (binding X) -------------------------------

# Arrival batches: the first covers event time before SPLIT_LATE, the second
# starts at SPLIT_EARLY, so a day of rows arrives twice.
SPLIT_EARLY = "2024-01-15 00:00:00"
SPLIT_LATE = "2024-01-16 00:00:00"
GOLD_SPLIT = "2024-01-16 12:30:00"     # existing gold ends inside an hour
EVOLVE_SPLIT = "2024-01-10 00:00:00"   # gold rows before it have the old layout


def norm_x(spark, sf_dir, since=None, until=None):
    return session_memo(spark, ("norm_x", sf_dir, since, until),
                        lambda: N.normalize_prices(B.raw_prices_x(spark, sf_dir, since, until)))


def norm_mix_x(spark, sf_dir, since=None, until=None):
    return session_memo(spark, ("norm_mix_x", sf_dir, since, until),
                        lambda: N.normalize_mix(B.raw_mix_x(spark, sf_dir, since, until)))


@query("first_present_column")
def q_first_present_column(spark, sf_dir):
    """Start time from the first non-null of two source columns of different type."""
    raw = B.raw_prices_x(spark, sf_dir)
    return raw.select("entity",
                      N.first_present(raw, "Interval Start", "time").try_cast("timestamp").alias("interval_start"),
                      N.first_present(raw, "Location", "location").alias("location"))


@query("rename_by_contract")
def q_rename_by_contract(spark, sf_dir):
    renamed = N.rename_by_contract(B.raw_prices_x(spark, sf_dir), PRICE_COLUMN_MAP)
    return N.normalize_timestamps(renamed, ["interval_start"])


@query("normalize_timestamps")
def q_normalize_timestamps(spark, sf_dir):
    raw = B.raw_prices_x(spark, sf_dir).select("entity", F.col("`Interval Start`").alias("start_text"),
                                                F.col("`Interval Start`").alias("interval_start"))
    return N.normalize_timestamps(raw, ["interval_start"])


@query("coerce_numeric")
def q_coerce_numeric(spark, sf_dir):
    raw = B.raw_prices_x(spark, sf_dir).select("entity", F.col("LMP").alias("price_text"),
                                                F.col("LMP").alias("price"))
    return N.coerce_numeric(raw, ["price"], fill=0.0)


@query("project_to_contract")
def q_project_to_contract(spark, sf_dir):
    renamed = N.rename_by_contract(B.raw_prices_x(spark, sf_dir), PRICE_COLUMN_MAP)
    return N.project_to_contract(N.normalize_timestamps(renamed, ["interval_start"]), PRICE_SILVER_COLUMNS)


@query("normalize_prices")
def q_normalize_prices(spark, sf_dir):
    return norm_x(spark, sf_dir)


@query("normalize_mix")
def q_normalize_mix(spark, sf_dir):
    return norm_mix_x(spark, sf_dir)


@query("renewable_share")
def q_renewable_share(spark, sf_dir):
    return norm_mix_x(spark, sf_dir).select("entity", "time", "wind", "solar", "share_pct")


@query("union_feeds")
def q_union_feeds(spark, sf_dir):
    """A normalized raw feed stacked with a feed that lacks location_type."""
    return N.union_feeds(norm_x(spark, sf_dir), B.prices_e(spark, sf_dir).drop("location_type"))


@query("contract_presence")
def q_contract_presence(spark, sf_dir):
    """Presence check of a feed that lacks the optional location column."""
    return CT.contract_presence(norm_x(spark, sf_dir).drop("location"), PRICE_CONTRACT)


@query("contract_null_counts")
def q_contract_null_counts(spark, sf_dir):
    return CT.contract_null_counts(norm_x(spark, sf_dir), PRICE_CONTRACT)


@query("contract_type_failures")
def q_contract_type_failures(spark, sf_dir):
    """Type conformance of the renamed, still textual feed."""
    renamed = N.rename_by_contract(B.raw_prices_x(spark, sf_dir), PRICE_COLUMN_MAP)
    return CT.contract_type_failures(renamed, PRICE_CONTRACT)


@query("contract_report")
def q_contract_report(spark, sf_dir):
    return CT.contract_report(norm_x(spark, sf_dir), PRICE_CONTRACT)


@query("gate_by_entity")
def q_gate_by_entity(spark, sf_dir):
    n = norm_x(spark, sf_dir)
    return CT.gate_by_entity(n, CT.contract_report(n, PRICE_CONTRACT))


@query("contract_quarantine")
def q_contract_quarantine(spark, sf_dir):
    """Rows the gate holds back: failing entities and rows without an entity."""
    n = norm_x(spark, sf_dir)
    return CT.quarantine(n, CT.contract_report(n, PRICE_CONTRACT))


def first_prices_x(spark, sf_dir):
    """Silver prices after the first arrival batch, stored by ``event_date``."""
    def build() -> DataFrame:
        path = fresh_dir(spark, "silver-prices-x")
        SV.append(SV.silver_prices(norm_x(spark, sf_dir, until=SPLIT_LATE)), path, SV.DATE_COL, "interval_start")
        return spark.read.parquet(path)
    return session_memo(spark, ("first_prices_x", sf_dir), build)


def first_mix_x(spark, sf_dir):
    """Silver mix after the first arrival batch, stored by ``event_date``."""
    def build() -> DataFrame:
        path = fresh_dir(spark, "silver-mix-x")
        first = SV.silver_mix(norm_mix_x(spark, sf_dir, until=SPLIT_LATE), None, contract=MIX_CONTRACT)
        SV.append(first, path, SV.DATE_COL, "time")
        return spark.read.parquet(path)
    return session_memo(spark, ("first_mix_x", sf_dir), build)


@query("silver_prices")
def q_silver_prices(spark, sf_dir):
    """Rows the second batch adds to silver after the first batch was loaded and stored."""
    existing = first_prices_x(spark, sf_dir)
    return SV.silver_prices(norm_x(spark, sf_dir, since=SPLIT_EARLY), existing)


@query("silver_insert_counts")
def q_silver_insert_counts(spark, sf_dir):
    """Rows the second batch inserts into silver prices, and the table total after it."""
    existing = first_prices_x(spark, sf_dir)
    new = SV.silver_prices(norm_x(spark, sf_dir, since=SPLIT_EARLY), existing)
    return SV.insert_counts(existing, new)


@query("silver_mix")
def q_silver_mix(spark, sf_dir):
    existing = first_mix_x(spark, sf_dir)
    return SV.silver_mix(norm_mix_x(spark, sf_dir, since=SPLIT_EARLY), existing, contract=MIX_CONTRACT)


# --- bronze (binding E) ------------------------------------------------------------
@query("bronze_prices")
def q_bronze_prices(spark, sf_dir):
    """Bronze landing of the price feed (arrival time = event time); audit text aside."""
    p = B.prices_e(spark, sf_dir)
    return BR.bronze_prices(p, ingested_at=F.col("interval_start")).drop("raw_json")


@query("bronze_mix")
def q_bronze_mix(spark, sf_dir):
    m = B.raw_mix_e(spark, sf_dir)
    srcs = {c: (c,) for c in ("time", *B.E_MIX.components)}
    return BR.bronze_mix(m, ingested_at=F.col("time"), sources=srcs, mix=B.E_MIX).drop("raw_json")


@query("raw_json_audit")
def q_raw_json_audit(spark, sf_dir):
    """The source rows read back from the bronze JSON audit copy."""
    p = B.prices_e(spark, sf_dir)
    return BR.parse_audit(BR.bronze_prices(p, ingested_at=COMPUTED_AT), p.schema)


# --- gold maintenance (binding E) ----------------------------------------------------
def _old_layout_gold(spark, sf_dir):
    g = gold_e(spark, sf_dir)
    old = g.filter(F.col("window_start") < instant(EVOLVE_SPLIT)).drop(*B.E_MIX.components)
    new = g.filter(F.col("window_start") >= instant(EVOLVE_SPLIT))
    return G.evolve_schema(old, new)


def mix_by_date_e(spark, sf_dir):
    """Binding-E silver mix stored by ``event_date``."""
    def build() -> DataFrame:
        path = fresh_dir(spark, "silver-mix-by-date-e")
        SV.append(mix_table_e(spark, sf_dir), path, SV.DATE_COL, B.E_MIX.time_col)
        return spark.read.parquet(path)
    return session_memo(spark, ("mix_by_date_e", sf_dir), build)


def existing_gold_e(spark, sf_dir):
    """Gold of the prices before GOLD_SPLIT, stored by ``window_date``."""
    def build() -> DataFrame:
        path = fresh_dir(spark, "gold-existing-e")
        first = B.prices_e(spark, sf_dir).filter(F.col("interval_start") < instant(GOLD_SPLIT))
        G.write_gold(G.gold_summary(first, mix_table_e(spark, sf_dir), B.E_MIX, computed_at=COMPUTED_AT), path)
        return spark.read.parquet(path)
    return session_memo(spark, ("existing_gold_e", sf_dir), build)


@query("gold_incremental")
def q_gold_incremental(spark, sf_dir):
    """Gold after an incremental run: hours already present are kept as first written."""
    existing = existing_gold_e(spark, sf_dir)
    incoming = prices_by_date_e(spark, sf_dir).filter(
        (F.col("interval_start") >= instant(SPLIT_EARLY)) & (F.col(SV.DATE_COL) >= F.to_date(instant(SPLIT_EARLY))))
    new = G.gold_incremental(incoming, mix_by_date_e(spark, sf_dir), existing, B.E_MIX, computed_at=COMPUTED_AT)
    return G.append_gold(existing.drop("window_date"), new)


@query("evolve_schema")
def q_evolve_schema(spark, sf_dir):
    return _old_layout_gold(spark, sf_dir)


@query("count_incomplete")
def q_count_incomplete(spark, sf_dir):
    return G.count_incomplete(_old_layout_gold(spark, sf_dir), B.E_MIX)


@query("gold_backfill")
def q_gold_backfill(spark, sf_dir):
    return G.gold_backfill(_old_layout_gold(spark, sf_dir), mix_by_date_e(spark, sf_dir), B.E_MIX)


# --- data health (binding E; now = last arrival + 20 minutes) -------------------------

CONFIGURED_ENTITIES = ["click", "error", "purchase", "refund", "signup"]
AS_OF_LAG_MINUTES = 20
AGE_DAYS = 10
SIZE_GB = 5.5


def _stored_bronze(spark, key, build_rows):
    """(path, table) of a bronze table written once per session (partitioned by
    ingest date) and read back."""
    def build():
        path = fresh_dir(spark, key)
        BR.write_bronze(build_rows(), path)
        return path, spark.read.parquet(path)
    return session_memo(spark, (key, "table"), build)


def bronze_stored_e(spark, sf_dir):
    """(path, table) of the stored bronze prices of binding E (arrival time = event
    time, audit text aside), with its ``ingest_date`` partition column."""
    return _stored_bronze(spark, f"bronze-e-{sf_dir}".replace("/", "_"), lambda: BR.bronze_prices(
        B.prices_e(spark, sf_dir), ingested_at=F.col("interval_start")).drop("raw_json"))


def bronze_table_e(spark, sf_dir):
    return bronze_stored_e(spark, sf_dir)[1]


def bronze_e(spark, sf_dir):
    return bronze_table_e(spark, sf_dir).drop("ingest_date")


def bronze_mix_stored_e(spark, sf_dir):
    """(path, table) of the stored bronze mix of binding E, with ``ingest_date``."""
    srcs = {c: (c,) for c in ("time", *B.E_MIX.components)}
    return _stored_bronze(spark, f"bronze-mix-e-{sf_dir}".replace("/", "_"), lambda: BR.bronze_mix(
        B.raw_mix_e(spark, sf_dir), ingested_at=F.col("time"), sources=srcs, mix=B.E_MIX).drop("raw_json"))


def bronze_mix_e(spark, sf_dir):
    return bronze_mix_stored_e(spark, sf_dir)[1].drop("ingest_date")


def as_of_e(spark, sf_dir):
    """'Now' for the health queries: the last arrival plus 20 minutes (scalar subquery)."""
    return (bronze_e(spark, sf_dir).select(plus_minutes(F.max("ingested_at"), AS_OF_LAG_MINUTES))
            .scalar())


@query("last_ingest")
def q_last_ingest(spark, sf_dir):
    return H.last_ingest(bronze_e(spark, sf_dir), "prices").unionByName(
        H.last_ingest(bronze_mix_e(spark, sf_dir), "mix"))


@query("freshness_status")
def q_freshness_status(spark, sf_dir):
    return H.freshness_status(bronze_e(spark, sf_dir), as_of_e(spark, sf_dir))


@query("missed_intervals")
def q_missed_intervals(spark, sf_dir):
    now = as_of_e(spark, sf_dir)
    return H.missed_intervals(bronze_e(spark, sf_dir), "prices", now).unionByName(
        H.missed_intervals(bronze_mix_e(spark, sf_dir), "mix", now))


def _layers(spark, sf_dir):
    return {"bronze_prices": bronze_e(spark, sf_dir), "bronze_mix": bronze_mix_e(spark, sf_dir),
            "silver_prices": prices_by_date_e(spark, sf_dir), "silver_mix": mix_table_e(spark, sf_dir),
            "gold": gold_e(spark, sf_dir)}


@query("layer_row_counts")
def q_layer_row_counts(spark, sf_dir):
    return H.layer_row_counts(_layers(spark, sf_dir))


@query("row_count_status")
def q_row_count_status(spark, sf_dir):
    return H.row_count_status(H.layer_row_counts(_layers(spark, sf_dir)))


@query("gap_by_entity")
def q_gap_by_entity(spark, sf_dir):
    return H.gap_by_entity(gold_e(spark, sf_dir), expected_minutes=5)


@query("date_ranges_by_category")
def q_date_ranges_by_category(spark, sf_dir):
    return H.date_ranges_by_category(B.prices_e(spark, sf_dir))


@query("gold_date_ranges")
def q_gold_date_ranges(spark, sf_dir):
    return H.gold_date_ranges(gold_e(spark, sf_dir))


@query("dataset_size_status")
def q_dataset_size_status(spark, sf_dir):
    """Stored size of the events table's files (file metadata only; no oracle)."""
    from tierline.sources.tables import table_path

    return H.dataset_size_status(H.dataset_size(spark, table_path(sf_dir, "events")))


@query("logical_size_status")
def q_logical_size_status(spark, sf_dir):
    """Size status of the bronze prices by the bytes of their values."""
    return H.dataset_size_status(H.logical_size(bronze_e(spark, sf_dir)))


def _health_checks(spark, sf_dir):
    g = gold_e(spark, sf_dir)
    return H.health_report(
        H.freshness_status(bronze_e(spark, sf_dir), as_of_e(spark, sf_dir)),
        H.row_count_status(H.layer_row_counts(_layers(spark, sf_dir))),
        H.data_gap_status(H.gap_by_entity(g, expected_minutes=5)),
        H.schema_check(g, ["avg_price", "window_end", *B.E_MIX.components]),
        H.dataset_size_status(H.logical_size(bronze_e(spark, sf_dir))),
    )


@query("health_report")
def q_health_report(spark, sf_dir):
    return _health_checks(spark, sf_dir)


@query("health_rollup")
def q_health_rollup(spark, sf_dir):
    return H.health_rollup(_health_checks(spark, sf_dir), H.domain_table(spark))


@query("entity_coverage")
def q_entity_coverage(spark, sf_dir):
    return H.entity_coverage(bronze_e(spark, sf_dir), CONFIGURED_ENTITIES)


# --- retention (binding E) ---------------------------------------------------------------
@query("retention_by_age")
def q_retention_by_age(spark, sf_dir):
    """Bronze rows kept by a 10-day age rule."""
    kept = R.retention_by_age(bronze_table_e(spark, sf_dir), R.age_cutoff(as_of_e(spark, sf_dir), AGE_DAYS))
    return kept.drop("ingest_date")


@query("median_cutoff")
def q_median_cutoff(spark, sf_dir):
    return R.median_cutoff(bronze_table_e(spark, sf_dir))


@query("archive_split")
def q_archive_split(spark, sf_dir):
    """Archive and keep counts at the median cutoff; they add up to the input."""
    b = bronze_table_e(spark, sf_dir)
    old, keep = R.archive_split(b, R.median_cutoff_instant(b))
    both = old.select(F.lit(True).alias("old")).unionByName(keep.select(F.lit(False).alias("old")))
    return both.agg(F.count_if("old").alias("archived"), F.count_if(~F.col("old")).alias("kept"),
                    F.count(F.lit(1)).alias("total"))


@query("retention_by_size")
def q_retention_by_size(spark, sf_dir):
    """Size rule at 5.5 GB (over the cap): both feeds cut at the prices' median arrival."""
    return R.retention_by_size(bronze_table_e(spark, sf_dir), bronze_mix_e(spark, sf_dir), SIZE_GB)


@query("retention_by_size_stored")
def q_retention_by_size_stored(spark, sf_dir):
    """The size rule carried out at a cap of 0 GB (any stored size is over it): both
    feeds archived and rewritten at the prices' median arrival, counted as read back."""
    feeds = {"prices": bronze_stored_e(spark, sf_dir)[0], "mix": bronze_mix_stored_e(spark, sf_dir)[0]}
    base = fresh_dir(spark, "bronze-by-size")
    _, action, _ = R.apply_size_retention(spark, feeds, base, by="prices", warning_gb=0.0, cap_gb=0.0)
    if action != "aged off":        # no row has an arrival time: the tables stay as they are
        return R.retention_by_size(bronze_e(spark, sf_dir), bronze_mix_e(spark, sf_dir), 0.0).drop("size_gb", "cutoff")
    parts = {f"{state}_{feed}": spark.read.parquet(f"{base}/{folder}/{feed}")
             for feed in feeds for state, folder in (("archived", "archive"), ("kept", "kept"))}
    rows = H.layer_row_counts(parts)
    return rows.agg(F.lit(action).alias("action"),
                    *[F.sum(F.when(F.col("layer") == c, F.col("rows"))).alias(c) for c in parts])


@query("medallion_stored")
def q_medallion_stored(spark, sf_dir):
    """Bronze -> silver -> gold over stored layers: both bronze tables are normalized,
    gated and loaded to silver stored by event date; gold is built from what was stored."""
    base = fresh_dir(spark, "medallion")
    prices = N.normalize_prices(bronze_e(spark, sf_dir).drop("interval_end", "ingested_at"))
    SV.append(SV.silver_prices(prices), f"{base}/prices", SV.DATE_COL, "interval_start")
    mix = N.normalize_mix(bronze_mix_e(spark, sf_dir), mix=B.E_MIX, column_map={})
    SV.append(SV.silver_mix(mix, mix=B.E_MIX), f"{base}/mix", SV.DATE_COL, B.E_MIX.time_col)
    return G.gold_summary(spark.read.parquet(f"{base}/prices"), spark.read.parquet(f"{base}/mix"), B.E_MIX,
                          computed_at=COMPUTED_AT)


@query("archive_export")
def q_archive_export(spark, sf_dir):
    """Rows older than the median cutoff written to a new archive, read back."""
    b = bronze_table_e(spark, sf_dir)
    path = fresh_dir(spark, "archive")
    R.archive_export(b, R.median_cutoff_instant(b), path)
    return spark.read.parquet(path).drop("ingest_date")


@query("archive_listing")
def q_archive_listing(spark, sf_dir):
    """Newest files of an archive written from the bronze feed."""
    b = bronze_table_e(spark, sf_dir)
    path = fresh_dir(spark, "archive")
    R.archive_export(b, R.median_cutoff_instant(b), path)
    return R.archive_listing(spark, path).select("file_name", "size_bytes", "size_mb")


@query("archive_contents")
def q_archive_contents(spark, sf_dir):
    """Rows per arrival date of an archive written from the bronze feed, newest first."""
    b = bronze_table_e(spark, sf_dir)
    path = fresh_dir(spark, "archive")
    R.archive_export(b, R.median_cutoff_instant(b), path)
    return R.archive_contents(spark.read.parquet(path))


# --- streaming (binding E / X landed as files) ------------------------------------------------

STREAM_SPLIT = "2024-01-16 12:30:00"    # first landing batch ends inside an hour
NO_DELAY = "0 seconds"                  # these feeds land in time order
RESEND_DELAY = "60 days"                # a re-sent row may be as old as the whole feed


def _stream_dirs(spark, label):
    base = fresh_dir(spark, label)
    return f"{base}/landing", f"{base}/sink", f"{base}/checkpoint"


@query("stream_gold")
def q_stream_gold(spark, sf_dir):
    """Hourly price statistics from a file stream; closed hours only."""
    landing, sink, ckpt = _stream_dirs(spark, "stream-gold")
    p = B.prices_e(spark, sf_dir)
    ST.land(p, landing)
    stream = ST.file_stream(spark, landing, p.schema)
    ST.run_available(ST.to_parquet(ST.hourly_price_stream(stream, NO_DELAY), sink, ckpt))
    return spark.read.parquet(sink)


@query("stream_late_rows")
def q_stream_late_rows(spark, sf_dir):
    """Two landings; the second repeats a closed day. Closed hours are emitted once
    and the late repeats are dropped."""
    landing, sink, ckpt = _stream_dirs(spark, "stream-late")
    p = B.prices_e(spark, sf_dir)
    t = F.col("interval_start")
    split = instant(STREAM_SPLIT)
    ST.land(p.filter(t < split), landing)
    stream = ST.file_stream(spark, landing, p.schema)
    ST.run_available(ST.to_parquet(ST.hourly_price_stream(stream, NO_DELAY), sink, ckpt))
    late = p.filter((t >= instant(SPLIT_EARLY)) & (t < instant(SPLIT_LATE)))
    ST.land(p.filter(t >= split).unionByName(late), landing)
    ST.run_available(ST.to_parquet(ST.hourly_price_stream(ST.file_stream(spark, landing, p.schema), NO_DELAY), sink, ckpt))
    return spark.read.parquet(sink)


@query("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    """Normalized raw feed, landed in two overlapping batches, each distinct row once.

    The first batch also holds corrected copies (same key, another market name),
    which are rows of their own.
    """
    landing, sink, ckpt = _stream_dirs(spark, "stream-dedup")
    first = B.raw_prices_x(spark, sf_dir, until=SPLIT_LATE)
    ST.land(first.unionByName(first.withColumn("Market", F.lit("CORRECTED"))), landing)
    for _ in range(2):
        stream = N.normalize_prices(ST.file_stream(spark, landing, first.schema))
        ST.run_available(ST.to_parquet(ST.dedup_stream(stream, RESEND_DELAY), sink, ckpt))
        ST.land(B.raw_prices_x(spark, sf_dir, since=SPLIT_EARLY), landing)
    return spark.read.parquet(sink)


@query("stream_gold_join")
def q_stream_gold_join(spark, sf_dir):
    """Hourly prices left-joined to the hourly mix, both as streams; closed hours only."""
    base = fresh_dir(spark, "stream-join")
    p, m = B.prices_e(spark, sf_dir), B.mix_e(spark, sf_dir)
    ST.land(p, f"{base}/prices")
    ST.land(m, f"{base}/mix")
    ps = ST.file_stream(spark, f"{base}/prices", p.schema)
    ms = ST.file_stream(spark, f"{base}/mix", m.schema)
    ST.run_available(ST.to_parquet(ST.gold_join_stream(ps, ms, NO_DELAY, B.E_MIX), f"{base}/sink", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/sink")


@query("stream_medallion")
def q_stream_medallion(spark, sf_dir):
    """Raw files -> normalize -> contract gate -> silver -> incremental gold, per micro-batch."""
    base = fresh_dir(spark, "stream-medallion")
    landing = f"{base}/landing"
    first = B.raw_prices_x(spark, sf_dir, until=SPLIT_LATE)
    ST.land(first, landing)
    mix = mix_table_e(spark, sf_dir)
    for _ in range(2):
        ST.run_medallion(ST.file_stream(spark, landing, first.schema), f"{base}/silver", f"{base}/gold",
                        f"{base}/checkpoint", mix, B.E_MIX, COMPUTED_AT,
                        bronze_path=f"{base}/bronze", quarantine_path=f"{base}/quarantine")
        ST.land(B.raw_prices_x(spark, sf_dir, since=SPLIT_EARLY), landing)
    return spark.read.parquet(f"{base}/gold").drop("batch_id", "window_date")


# --- landed-file sources (binding E written as files, read back) ---------------------------

HISTORY_END = "2024-01-30 00:00:00"
HISTORY_DAYS = 7


@query("history_range_scan")
def q_history_range_scan(spark, sf_dir):
    """The 7 days of prices before the end date."""
    return L.history_range(prices_by_date_e(spark, sf_dir), HISTORY_END, HISTORY_DAYS).drop(SV.DATE_COL)


@query("land_prices_json")
def q_land_prices_json(spark, sf_dir):
    """Prices landed as JSON lines, read back with the explicit schema."""
    p = B.prices_e(spark, sf_dir)
    path = fresh_dir(spark, "landing-json")
    L.write_landed(p, path, "json")
    good, _ = L.split_quarantine(L.read_landed(spark, path, p.schema, "json"))
    return good


@query("land_mix_csv")
def q_land_mix_csv(spark, sf_dir):
    """The raw mix landed as CSV, read back with the explicit schema."""
    m = B.raw_mix_e(spark, sf_dir)
    path = fresh_dir(spark, "landing-csv")
    L.write_landed(m, path, "csv")
    good, _ = L.split_quarantine(L.read_landed(spark, path, m.schema, "csv"))
    return good


@query("gold_summary_sql")
def q_gold_summary_sql(spark, sf_dir):
    """The gold summary through temp views and spark.sql (same plan as the DataFrame form)."""
    from tierline.sources.views import gold_sql, register_views

    register_views(spark, sf_dir, prefix="e_")
    return spark.sql(gold_sql("e_silver_prices", "e_silver_mix", list(B.E_MIX.components),
                              computed_at=COMPUTED_AT.isoformat(sep=" ")))


@query("stream_two_feeds")
def q_stream_two_feeds(spark, sf_dir):
    """Both raw feeds landed in two rounds; per round the mix stream loads silver
    mix, then the price stream loads silver prices and gold against that table."""
    base = fresh_dir(spark, "stream-two-feeds")
    first_p = B.raw_prices_x(spark, sf_dir, until=SPLIT_LATE)
    first_m = B.raw_mix_x(spark, sf_dir, until=SPLIT_LATE)
    ST.land(first_p, f"{base}/landing-prices")
    ST.land(first_m, f"{base}/landing-mix")
    for _ in range(2):
        ST.run_mix_silver(ST.file_stream(spark, f"{base}/landing-mix", first_m.schema),
                          f"{base}/silver-mix", f"{base}/checkpoint-mix")
        ST.run_medallion(ST.file_stream(spark, f"{base}/landing-prices", first_p.schema),
                         f"{base}/silver", f"{base}/gold", f"{base}/checkpoint-prices",
                         f"{base}/silver-mix", computed_at=COMPUTED_AT)
        ST.land(B.raw_prices_x(spark, sf_dir, since=SPLIT_EARLY), f"{base}/landing-prices")
        ST.land(B.raw_mix_x(spark, sf_dir, since=SPLIT_EARLY), f"{base}/landing-mix")
    return spark.read.parquet(f"{base}/gold").drop("batch_id", "window_date")


@query("evolve_schema_files")
def q_evolve_schema_files(spark, sf_dir):
    """Gold written in two layouts into one date-partitioned folder, read back with mergeSchema."""
    path = fresh_dir(spark, "gold-evolve")
    g = gold_e(spark, sf_dir)
    split = instant(EVOLVE_SPLIT)
    G.write_gold(g.filter(F.col("window_start") < split).drop(*B.E_MIX.components), path)
    G.write_gold(g.filter(F.col("window_start") >= split), path)
    return G.read_gold(spark, path).drop("window_date").select(*g.columns)


@query("retention_rewrite")
def q_retention_rewrite(spark, sf_dir):
    """Copy-on-write age retention of the stored bronze table into a new version, read back."""
    src_path, _ = bronze_stored_e(spark, sf_dir)
    path = fresh_dir(spark, "bronze-retained")
    R.retain_table(spark, src_path, path, R.age_cutoff(as_of_e(spark, sf_dir), AGE_DAYS))
    return spark.read.parquet(path).drop("ingest_date")


# --- retention in place, archive manifest (binding E with some arrival times unknown) ------------

def _undated_copy(spark, sf_dir):
    """Fresh copies of both bronze feeds, by ingest date; rows of second 7 and mix rows of hour 5 carry no arrival time."""
    base = fresh_dir(spark, "bronze-undated")
    known = {"prices": (bronze_e(spark, sf_dir), F.second("interval_start") != 7),
             "mix": (bronze_mix_e(spark, sf_dir), F.hour("time") != 5)}
    for feed, (table, dated) in known.items():
        BR.write_bronze(table.withColumn("ingested_at", F.when(dated, F.col("ingested_at"))), f"{base}/{feed}")
    return {feed: f"{base}/{feed}" for feed in known}


@query("retention_by_age_both")
def q_retention_by_age_both(spark, sf_dir):
    """A 10-day age rule carried out in place on both feeds: rows removed, kept and kept without an arrival time."""
    feeds = _undated_copy(spark, sf_dir)
    last = spark.read.parquet(feeds["prices"]).select(plus_minutes(F.max("ingested_at"), AS_OF_LAG_MINUTES)).scalar()
    done = R.age_off(spark, feeds, R.age_cutoff(last, AGE_DAYS))
    left = None
    for feed, path in feeds.items():
        part = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("ingested_at").isNull()).alias("undated"),
                                            F.min("ingested_at").alias("earliest")).withColumn("feed", F.lit(feed))
        left = part if left is None else left.unionByName(part)
    return done.join(left, "feed").select("feed", "removed", "kept", "undated", "earliest", "rewritten_partitions")


@query("archive_manifest")
def q_archive_manifest(spark, sf_dir):
    """The archive of the rows before the median arrival, exported in two steps, as its manifest lists it."""
    b = bronze_table_e(spark, sf_dir)
    path = fresh_dir(spark, "archive-manifest")
    early = instant(SPLIT_ARCHIVE)
    R.export_archive(R.archive_split(b, early)[0], early, path, instant("2024-02-01 00:00:00"))
    R.export_archive(R.archive_split(b, early)[1], R.median_cutoff_instant(b), path, instant("2024-02-02 00:00:00"))
    return R.archive_manifest(spark, path, limit=1000).drop("file_name")


SPLIT_ARCHIVE = "2024-01-05 00:00:00"


# --- statistics of gold from daily summaries (binding E) ------------------------------------------

SUMMARY_SPLIT = "2024-01-20 00:00:00"       # the second load brings the days from here on


def gold_days_e(spark, sf_dir):
    """The stored daily summaries of gold, loaded in two increments of whole days; the later one is loaded twice."""
    def build():
        path = fresh_dir(spark, "gold-days-e")
        g, t = gold_e(spark, sf_dir), F.col("window_start")
        SU.add_days(g.filter(t < instant(SUMMARY_SPLIT)), path)
        for _ in range(2):
            SU.add_days(g.filter(t >= instant(SUMMARY_SPLIT)), path)
        return SU.read_days(spark, path)
    return session_memo(spark, ("gold_days_e", sf_dir), build)


@query("anomaly_baseline_incremental")
def q_anomaly_baseline_incremental(spark, sf_dir):
    """Mean, deviation and quartiles per entity from merged daily moments and sketches."""
    return SU.baseline_from_days(gold_days_e(spark, sf_dir))


@query("box_stats_incremental")
def q_box_stats_incremental(spark, sf_dir):
    """Quartiles, fences and extremes per entity from merged daily sketches."""
    return SU.box_from_days(gold_days_e(spark, sf_dir))


@query("anomaly_scores_incremental")
def q_anomaly_scores_incremental(spark, sf_dir):
    """Status of each entity's latest price against the merged daily moments."""
    return SU.scores_from_days(gold_days_e(spark, sf_dir), gold_by_date_e(spark, sf_dir).drop("window_date"))


# --- streams with every row accounted for -----------------------------------------------------------

LATE_DELAY = "2 HOURS"
NEAR_SINCE = "2024-01-16 11:45:00"      # re-sent in the second landing, inside the delay


def _late_ledger(spark, sf_dir):
    """Two landings into the late-row ledger: the second re-sends a closed day (late), the rows just before the first
    landing's end (inside the delay), and rows without a time."""
    def build():
        base = fresh_dir(spark, "stream-ledger")
        p, t = B.prices_e(spark, sf_dir), F.col("interval_start")
        split, landing = instant(STREAM_SPLIT), f"{base}/landing"
        ST.land(p.filter(t < split), landing)
        ST.run_late_ledger(ST.file_stream(spark, landing, p.schema), base, f"{base}/checkpoint", LATE_DELAY)
        closed = p.filter((t >= instant(SPLIT_EARLY)) & (t < instant(SPLIT_LATE)))
        near = p.filter((t >= instant(NEAR_SINCE)) & (t < split))
        untimed = closed.withColumn("interval_start", F.lit(None).cast("timestamp"))
        ST.land(p.filter(t >= split).unionByName(closed).unionByName(near).unionByName(untimed), landing)
        ST.run_late_ledger(ST.file_stream(spark, landing, p.schema), base, f"{base}/checkpoint", LATE_DELAY)
        return base, p.schema
    return session_memo(spark, ("late_ledger", sf_dir), build)


@query("stream_row_accounts")
def q_stream_row_accounts(spark, sf_dir):
    """Rows landed, emitted, late and still open per entity of the late-row ledger (emitted + late + open = landed)."""
    base, schema = _late_ledger(spark, sf_dir)
    return ST.row_accounts(spark, spark.read.schema(schema).parquet(f"{base}/landing"), base)


@query("stream_ledger_gold")
def q_stream_ledger_gold(spark, sf_dir):
    """The closed hours the ledger emitted, each once, with the rows inside the delay counted."""
    return spark.read.parquet(f"{_late_ledger(spark, sf_dir)[0]}/gold").drop("batch_id", "window_date")


@query("stream_late_table")
def q_stream_late_table(spark, sf_dir):
    """The late rows of the ledger with their reasons."""
    return spark.read.parquet(f"{_late_ledger(spark, sf_dir)[0]}/late").drop("batch_id")


@query("stream_feed_accounts")
def q_stream_feed_accounts(spark, sf_dir):
    """Both raw feeds in two landings, the price stream's last batch replayed: rows landed, kept as they came,
    held back by the contract gate, and entered into silver, per feed."""
    base = fresh_dir(spark, "stream-accounts")
    raws = {"prices": B.raw_prices_x, "mix": B.raw_mix_x}
    first = {feed: raw(spark, sf_dir, until=SPLIT_LATE) for feed, raw in raws.items()}
    second = {feed: raw(spark, sf_dir, since=SPLIT_EARLY) for feed, raw in raws.items()}
    for batch in (first, second):
        for feed, rows in batch.items():
            ST.land(rows, f"{base}/landing-{feed}")
        ST.run_mix_silver(ST.file_stream(spark, f"{base}/landing-mix", first["mix"].schema), f"{base}/silver-mix",
                          f"{base}/checkpoint-mix", bronze_path=f"{base}/bronze-mix", quarantine_path=f"{base}/quarantine-mix")
        ST.run_medallion(ST.file_stream(spark, f"{base}/landing-prices", first["prices"].schema), f"{base}/silver-prices",
                         f"{base}/gold", f"{base}/checkpoint-prices", f"{base}/silver-mix", computed_at=COMPUTED_AT,
                         bronze_path=f"{base}/bronze-prices", quarantine_path=f"{base}/quarantine-prices")
    replay = ST.MedallionBatch(f"{base}/silver-prices", f"{base}/gold", f"{base}/silver-mix", computed_at=COMPUTED_AT,
                               bronze_path=f"{base}/bronze-prices", quarantine_path=f"{base}/quarantine-prices")
    replay(second["prices"], 1)
    tables = {(feed, part): spark.read.parquet(f"{base}/{part}-{feed}")
              for feed in raws for part in ("landing", "bronze", "quarantine", "silver")}
    totals = H.layer_totals(tables).filter(F.col("table").isNotNull())
    return totals.groupBy(F.col("layer").alias("feed")).agg(
        *[F.sum(F.when(F.col("table") == part, F.col("rows"))).alias(part) for part in ("landing", "bronze", "quarantine", "silver")])


# --- landing with a bad source, layers as a whole, any time zone, counted failures ------------------

@query("land_isolated")
def q_land_isolated(spark, sf_dir):
    """Prices landed one folder a source, beside a source whose file is no Parquet: the ledger names exactly that file."""
    path = fresh_dir(spark, "landing-isolated")
    p = B.prices_e(spark, sf_dir)
    p.withColumn("source", F.col("entity")).repartition("source").write.partitionBy("source").parquet(path)
    spark.range(1).select(F.lit("this is no Parquet file").alias("value")).coalesce(1).write.text(f"{path}/source=broken")
    rows, ledger = L.read_isolated(spark, path, p.schema)
    spans = rows.groupBy("source").agg(F.min("interval_start").alias("earliest"), F.max("interval_start").alias("latest"))
    return ledger.join(spans, "source", "left").select("source", "files", "files_read", F.size("skipped").alias("files_skipped"),
                                                       "rows", "earliest", "latest")


def _layer_tables(spark, sf_dir):
    named = _layers(spark, sf_dir)
    return {(name.split("_")[0], name.split("_")[-1] if "_" in name else "summary"): df for name, df in named.items()}


@query("layer_row_totals")
def q_layer_row_totals(spark, sf_dir):
    """Rows per table, per layer (table null) and over all layers (both null)."""
    return H.layer_totals(_layer_tables(spark, sf_dir))


@query("layer_status")
def q_layer_status(spark, sf_dir):
    """Row check per layer, with a layer none of whose tables has a row (named by the warning)."""
    tables = _layer_tables(spark, sf_dir)
    empty = gold_e(spark, sf_dir).filter(F.col("window_end") < F.col("window_start"))
    totals = H.layer_totals({**tables, ("platinum", "a"): empty, ("platinum", "b"): empty})
    return H.layer_status(totals, ["bronze", "silver", "gold", "platinum"])


ANY_ZONES = {"click": "Australia/Adelaide", "purchase": "America/St_Johns", "signup": "Asia/Kolkata", "view": "Europe/Lisbon"}


@query("local_window_any_zone")
def q_local_window_any_zone(spark, sf_dir):
    """Local windows of each entity's latest hour, moved through a year across the clock changes of zones of any kind."""
    g = SN.latest_rows(gold_e(spark, sf_dir)).select("entity", "window_end", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    moved = g.select("entity", (F.col("window_end") + F.make_dt_interval(days=F.col("k") * 30)).alias("window_end"))
    return SN.local_window_any_zone(moved, SN.zone_clock_table(spark, ANY_ZONES, 2020, 2030))


@query("normalize_failures")
def q_normalize_failures(spark, sf_dir):
    """Values per column that normalization could not read, counted while both raw feeds are normalized and stored."""
    base = fresh_dir(spark, "normalize-counted")
    out = None
    for feed, raw, mix in (("prices", B.raw_prices_x(spark, sf_dir), None), ("mix", B.raw_mix_x(spark, sf_dir), DEFAULT_MIX)):
        one = N.normalize_counted(raw, feed, lambda df, feed=feed: df.write.parquet(f"{base}/{feed}"), mix=mix).withColumn("feed", F.lit(feed))
        out = one if out is None else out.unionByName(one)
    return out
