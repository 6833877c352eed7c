"""Reading the given Parquet tables."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_HANDLES: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def session_memo(spark: SparkSession, key, build):
    """One DataFrame handle per session and key.

    A DataFrame is an immutable plan, so reusing the handle of a read-only
    input saves the file listing, footer reads and analysis on every use.
    Only for inputs that do not change while the session lives.
    """
    cache = _HANDLES.setdefault(spark, {})
    if key not in cache:
        cache[key] = build()
    return cache[key]


def read_table(spark: SparkSession, sf_dir: str, name: str, refresh: bool = False) -> DataFrame:
    """A lazy scan of a given (read-only) table; Catalyst prunes it to the
    columns and rows a query uses."""
    path = table_path(sf_dir, name)
    if refresh:
        return spark.read.parquet(path)
    return session_memo(spark, ("table", path), lambda: spark.read.parquet(path))
