"""Bronze: raw rows as landed, typed, with a whole-row JSON audit copy.

Landing is one bulk append per batch, partitioned by ingest date so that
retention drops whole partitions. Source column names vary by feed; each
bronze column takes the first non-null of its known source names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.functions.time import instant
from tierline.operators.normalize import first_present
from tierline.settings import DEFAULT_MIX, MixSpec

# Microsecond instants in the audit copy (the default format keeps only ms).
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

# fixed values: source names per bronze column, in lookup order
PRICE_SOURCES = {
    "interval_start": ("Interval Start", "time", "interval_start"),
    "interval_end": ("Interval End", "interval_end"),
    "location": ("Location", "location"),
    "location_type": ("Location Type", "location_type"),
    "price": ("LMP", "lmp", "price"),
    "market": ("Market", "market"),
}
MIX_SOURCES = {
    "time": ("Time", "time"),
    "natural_gas": ("Natural Gas", "natural_gas"),
    "wind": ("Wind", "wind"),
    "solar": ("Solar", "solar"),
    "coal": ("Coal", "coal"),
    "nuclear": ("Nuclear", "nuclear"),
    "other": ("Other", "other"),
}


def _ingested(value) -> Column:
    if value is None:
        return F.current_timestamp()
    return instant(value)


def raw_json(df: DataFrame) -> Column:
    """The whole source row as JSON text (nulls kept, microsecond instants)."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON_OPTIONS)


def _entity(df: DataFrame, entity: str | None) -> Column:
    if "entity" in df.columns:
        return F.col("entity")
    return F.lit(entity).cast("string")


def bronze_prices(raw: DataFrame, entity: str | None = None, ingested_at=None) -> DataFrame:
    """Typed bronze price rows plus ``raw_json`` and ``ingested_at``."""
    cols = [_entity(raw, entity).alias("entity")]
    for name, sources in PRICE_SOURCES.items():
        c = first_present(raw, *sources)
        if name in ("interval_start", "interval_end"):
            c = c.cast("timestamp")
        elif name == "price":
            c = c.cast("double")
        else:
            c = c.cast("string")
        cols.append(c.alias(name))
    return raw.select(*cols, raw_json(raw).alias("raw_json"), _ingested(ingested_at).alias("ingested_at"))


def bronze_mix(raw: DataFrame, entity: str | None = None, ingested_at=None,
               sources: dict[str, tuple[str, ...]] | None = None, mix: MixSpec = DEFAULT_MIX) -> DataFrame:
    """Typed bronze mix rows; missing components land as 0.0."""
    srcs = MIX_SOURCES if sources is None else sources
    cols = [_entity(raw, entity).alias("entity"),
            first_present(raw, *srcs.get(mix.time_col, (mix.time_col,))).cast("timestamp").alias(mix.time_col)]
    for comp in mix.components:
        c = first_present(raw, *srcs.get(comp, (comp,))).cast("double")
        cols.append(F.coalesce(c, F.lit(0.0)).alias(comp))
    return raw.select(*cols, raw_json(raw).alias("raw_json"), _ingested(ingested_at).alias("ingested_at"))


def parse_audit(bronze: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows read back from ``raw_json`` with the source schema."""
    return bronze.select(F.from_json("raw_json", schema, JSON_OPTIONS).alias("j")).select("j.*")


def write_bronze(df: DataFrame, path: str) -> None:
    """Append a batch, partitioned by ingest date."""
    (df.withColumn("ingest_date", F.to_date("ingested_at"))
     .write.mode("append").partitionBy("ingest_date").parquet(path))
