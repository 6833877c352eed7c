"""Normalization of raw feeds into the silver shape (narrow, no shuffle).

Each step is a projection, so the whole chain fuses into one codegen stage
right after the scan. Steps tolerate absent columns the way raw feeds need:
missing optional columns are skipped, unknown columns are dropped at the end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.functions.numeric import coerce_numeric as _coerce
from tierline.functions.numeric import share_pct
from tierline.settings import (
    DEFAULT_MIX,
    MIX_COLUMN_MAP,
    PRICE_COLUMN_MAP,
    PRICE_SILVER_COLUMNS,
    UNKNOWN_MARKET,
    MixSpec,
)


def first_present(df: DataFrame, *candidates: str) -> Column:
    """First non-null value among the candidate columns that exist (zero kept).

    Candidates of different types are compared as text, so a typed column and
    a text column of the same meaning can stand in for each other.
    """
    names = [c for c in candidates if c in df.columns]
    if not names:
        return F.lit(None)
    types = {df.schema[c].dataType.simpleString() for c in names}
    cols = [F.col(f"`{c}`") for c in names]
    if len(types) > 1:
        cols = [c.cast("string") for c in cols]
    return F.coalesce(*cols) if len(cols) > 1 else cols[0]


def rename_by_contract(df: DataFrame, column_map: dict[str, str]) -> DataFrame:
    """Rename source columns to contract names.

    Several sources may map to one target (e.g. two time columns); the target
    is then the first non-null of them in map order (a column already named
    like the target comes last), instead of two columns of one name.
    """
    sources_of: dict[str, list[str]] = {}
    for src, dst in column_map.items():
        if src in df.columns and src != dst:
            sources_of.setdefault(dst, []).append(src)
    if not sources_of:
        return df
    consumed = {s for srcs in sources_of.values() for s in srcs}
    out: list[Column] = []
    done: set[str] = set()
    for c in df.columns:
        if c in consumed and c not in sources_of:
            # A source column: emit its target at the first source's position.
            dst = column_map[c]
            if dst in done:
                continue
            cands = sources_of[dst] + ([dst] if dst in df.columns else [])
            out.append(first_present(df, *cands).alias(dst))
            done.add(dst)
        elif c in sources_of:
            if c in done:
                continue
            out.append(first_present(df, *sources_of[c], c).alias(c))
            done.add(c)
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def add_entity(df: DataFrame, entity: str | None) -> DataFrame:
    """Add a constant entity column if the feed has none."""
    if "entity" in df.columns or entity is None:
        return df
    return df.withColumn("entity", F.lit(entity))


def normalize_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Timestamp-like columns to TIMESTAMP in UTC; unparsable text becomes null."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    repl = {}
    for c in columns:
        if c not in types:
            continue
        t = types[c]
        if isinstance(t, T.TimestampType):
            continue
        if isinstance(t, (T.TimestampNTZType, T.DateType)):
            repl[c] = F.col(c).cast("timestamp")
        else:
            repl[c] = F.col(c).cast("string").try_cast("timestamp")
    return df.withColumns(repl) if repl else df


def coerce_numeric(df: DataFrame, columns: list[str], fill: float | None = 0.0) -> DataFrame:
    """Columns to DOUBLE; text that is not a plain number becomes ``fill``.

    Numeric columns skip the text round trip: only null, NaN and infinities
    are replaced.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    repl = {}
    for c in columns:
        if c not in types:
            continue
        if isinstance(types[c], T.NumericType):
            v = F.col(c).cast("double")
            ok = F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
            repl[c] = F.coalesce(ok, F.lit(fill).cast("double")) if fill is not None else ok
        else:
            repl[c] = _coerce(F.col(c), fill)
    return df.withColumns(repl) if repl else df


def default_category(df: DataFrame, column: str = "market", default: str = UNKNOWN_MARKET) -> DataFrame:
    if column in df.columns:
        return df.withColumn(column, F.coalesce(F.col(column), F.lit(default)))
    return df.withColumn(column, F.lit(default))


def project_to_contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the contract columns that exist, in contract order."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def renewable_share(df: DataFrame, mix: MixSpec = DEFAULT_MIX) -> DataFrame:
    """Share of the chosen components in the row total, percent, 2 decimals."""
    available = [c for c in mix.components if c in df.columns]
    return df.withColumn(mix.share_col, share_pct(list(mix.share_of), available))


def normalize_prices(df: DataFrame, entity: str | None = None,
                     column_map: dict[str, str] | None = None,
                     fill: float | None = 0.0) -> DataFrame:
    """Raw price feed -> silver shape: rename, entity, UTC, numeric, market, project."""
    cmap = PRICE_COLUMN_MAP if column_map is None else column_map
    out = rename_by_contract(df, cmap)
    out = add_entity(out, entity)
    out = normalize_timestamps(out, ["interval_start", "interval_end"])
    out = coerce_numeric(out, ["price"], fill=fill)
    out = default_category(out, "market", UNKNOWN_MARKET)
    return project_to_contract(out, PRICE_SILVER_COLUMNS)


def normalize_mix(df: DataFrame, entity: str | None = None, mix: MixSpec = DEFAULT_MIX,
                  column_map: dict[str, str] | None = None,
                  fill: float | None = 0.0) -> DataFrame:
    """Raw mix feed -> silver shape: rename, entity, UTC, numeric, share, project."""
    cmap = MIX_COLUMN_MAP if column_map is None else column_map
    out = rename_by_contract(df, cmap)
    out = add_entity(out, entity)
    out = normalize_timestamps(out, [mix.time_col])
    out = coerce_numeric(out, list(mix.components), fill=fill)
    out = renewable_share(out, mix)
    return project_to_contract(out, mix.silver_columns())


def failure_metrics(df: DataFrame, times: list[str], numbers: list[str]) -> list[Column]:
    """Per column, the values that normalization cannot read: text that is no time, or no plain number (null is no failure)."""
    out = []
    for c in [c for c in times if c in df.columns]:
        out.append(F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("timestamp").isNull()).alias(c))
    for c in [c for c in numbers if c in df.columns]:
        out.append(F.count_if(F.col(c).isNotNull() & _coerce(F.col(c), None).isNull()).alias(c))
    return out


def normalize_counted(df: DataFrame, name: str, write, mix: MixSpec | None = None, **options) -> DataFrame:
    """Normalize a raw feed, hand the result to ``write`` once, and return its failures: (column, failures, rows).

    The failures are counted by metrics observed on the renamed rows while they
    pass (``DataFrame.observe``), so the raw feed is read once. ``mix`` makes it
    a mix feed; ``options`` go to ``normalize_prices`` or ``normalize_mix``.
    """
    from pyspark.sql import Observation

    spark = df.sparkSession
    cmap = options.pop("column_map", None)
    if mix is None:
        renamed = rename_by_contract(df, PRICE_COLUMN_MAP if cmap is None else cmap)
        metrics = failure_metrics(renamed, ["interval_start", "interval_end"], ["price"])
    else:
        renamed = rename_by_contract(df, MIX_COLUMN_MAP if cmap is None else cmap)
        metrics = failure_metrics(renamed, [mix.time_col], list(mix.components))
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    observed = renamed.observe(seen, F.count(F.lit(1)).alias("__rows"), *metrics)
    write(normalize_prices(observed, column_map={}, **options) if mix is None
          else normalize_mix(observed, mix=mix, column_map={}, **options))
    counts = dict(seen.get)
    rows = counts.pop("__rows")
    return spark.createDataFrame([(c, int(n), int(rows)) for c, n in counts.items()], "column string, failures long, rows long")


def union_feeds(*frames: DataFrame) -> DataFrame:
    """Stack feeds by column name; columns missing in one feed become null."""
    if not frames:
        raise ValueError("union_feeds needs at least one DataFrame")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
