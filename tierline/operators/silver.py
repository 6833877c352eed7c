"""Silver: contract-gated, deduplicated, append-only-new-keys inserts.

Semantics: within a batch every distinct row is kept (two rows sharing a key
but differing in price both enter); a row whose key is already in silver is
refused. For prices the key is (entity, interval_start, location) with a null
location treated as the empty string; for the mix it is (entity, time).

Plan shape: the distinct over all silver columns is a partial aggregate
(copies collapse inside each input partition, so a hot group of copies never
reaches one task), then the anti-join against existing silver is a sort-merge
join on the key (or a broadcast join when Spark measures the existing side
small); AQE splits skewed anti-join partitions.
Existing silver is first pruned to the batch's time range by scalar
subqueries, which become partition filters on a date-partitioned table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.operators.contracts import contract_report, gate_by_entity
from tierline.settings import DEFAULT_MIX, MIX_CONTRACT, PRICE_CONTRACT, PRICE_SILVER_COLUMNS, MixSpec

PRICE_KEY = ["entity", "interval_start", "__loc"]
DATE_COL = "event_date"     # partition column of a stored silver table


def _time_pruned(existing: DataFrame, incoming: DataFrame, time_col: str) -> DataFrame:
    """Existing rows inside the incoming batch's time range (one scalar subquery).

    The bounds come from a plain scan of the batch (min/max, combined
    map-side), a superset of the range of the rows that survive the gate.
    """
    b = incoming.agg(F.struct(F.min(time_col).alias("lo"), F.max(time_col).alias("hi"))).scalar()
    rows = existing.filter((F.col(time_col) >= b.getField("lo")) & (F.col(time_col) <= b.getField("hi")))
    if DATE_COL in existing.columns:     # Spark derives no date range from a time range
        rows = rows.filter((F.col(DATE_COL) >= F.to_date(b.getField("lo"))) & (F.col(DATE_COL) <= F.to_date(b.getField("hi"))))
    return rows


def new_price_rows(batch: DataFrame, existing: DataFrame | None, bounds_from: DataFrame | None = None) -> DataFrame:
    """Distinct, complete rows of a normalized price batch whose key is new.

    ``bounds_from`` (default: the batch) supplies the time range that prunes
    the existing side; pass the ungated batch so the range is a plain scan.
    """
    raw = batch if bounds_from is None else bounds_from
    rows = (batch.select(*PRICE_SILVER_COLUMNS)
            .filter(F.col("price").isNotNull() & F.col("interval_start").isNotNull())
            .withColumn("__loc", F.coalesce(F.col("location"), F.lit(""))))
    # The distinct runs as a partial aggregate first: copies of one row are
    # collapsed inside each input partition before anything is shuffled, so a
    # feed that re-sends one row millions of times costs one row per
    # partition. (__loc is a function of location; keeping it in the distinct
    # changes nothing.) The anti-join then shuffles the deduplicated rows by
    # key, or broadcasts the existing side when Spark measures it small.
    rows = rows.dropDuplicates([*PRICE_KEY, "location", "location_type", "price", "market"])
    if existing is not None:
        old = (_time_pruned(existing, raw, "interval_start")
               .select("entity", "interval_start", F.coalesce(F.col("location"), F.lit("")).alias("__loc")))
        rows = rows.join(old, PRICE_KEY, "left_anti")
    return rows.select(*PRICE_SILVER_COLUMNS)


def new_mix_rows(batch: DataFrame, existing: DataFrame | None, mix: MixSpec = DEFAULT_MIX,
                 bounds_from: DataFrame | None = None) -> DataFrame:
    key = ["entity", mix.time_col]
    cols = mix.silver_columns()
    rows = batch.select(*cols).filter(F.col(mix.time_col).isNotNull())
    rows = rows.dropDuplicates([*key, *[c for c in cols if c not in key]])
    if existing is not None:
        old = _time_pruned(existing, batch if bounds_from is None else bounds_from, mix.time_col).select(*key)
        rows = rows.join(old, key, "left_anti")
    return rows.select(*cols)


def silver_prices(normalized: DataFrame, existing: DataFrame | None = None,
                  contract=PRICE_CONTRACT) -> DataFrame:
    """The new distinct rows of the entities that pass the contract gate (what gets appended).

    The gate goes by entity alone, so it may follow the distinct: rows are then
    dealt out by the whole row. Spark moves a broadcast gate below the distinct.
    """
    report = contract_report(normalized, contract)
    return gate_by_entity(new_price_rows(normalized, existing), report).select(*PRICE_SILVER_COLUMNS)


def silver_mix(normalized: DataFrame, existing: DataFrame | None = None,
               mix: MixSpec = DEFAULT_MIX, contract=MIX_CONTRACT) -> DataFrame:
    report = contract_report(normalized, contract)
    return gate_by_entity(new_mix_rows(normalized, existing, mix), report).select(*mix.silver_columns())


def append(df: DataFrame, path: str, partition_col: str | None = None,
           time_col: str | None = None) -> None:
    """Append rows to a Parquet table, partitioned by event date when asked.

    Rows are brought together by date first, in partitions of the advisory size
    (a larger date is split): the sort by date starts in tasks of its own, and
    a date is a few files instead of one a task.
    """
    out = df
    if partition_col and time_col:
        out = out.withColumn(partition_col, F.to_date(F.col(time_col))).hint("rebalance", partition_col)
        out.write.mode("append").partitionBy(partition_col).parquet(path)
    else:
        out.write.mode("append").parquet(path)


def insert_counts(existing: DataFrame | None, inserted: DataFrame) -> DataFrame:
    """One row: rows inserted by a load and the table total after it.

    One aggregate over both sides, tagged and stacked (no join).
    """
    new = inserted.select(F.lit(1).alias("__new"))
    both = new if existing is None else new.unionByName(existing.select(F.lit(0).alias("__new")))
    return both.agg(F.count_if(F.col("__new") == 1).alias("inserted"), F.count(F.lit(1)).alias("total"))
