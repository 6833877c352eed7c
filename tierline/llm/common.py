"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.session import ensure_session, fresh_dir
from tierline.sources.tables import table_path

# Word separators of every word count here: space, tab and the line breaks U+000A to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

# Rows per Arrow batch for whole texts. Texts vary from a word to megabytes, so
# a batch of Spark's default 10,000 rows could fill a Python worker.
TEXT_BATCH_ROWS = 500
TEXT_BATCH_BYTES = 16 << 20

# A side is broadcast only after its rows have been counted against this bound.
BROADCAST_ROWS = 10_000


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once per context (as --py-files would)."""
    sc = spark.sparkContext
    if getattr(sc, "_tierline_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    base = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tierline-py-")), "tierline")
    sc.addPyFile(shutil.make_archive(base, "zip", top, "tierline"))  # Spark's file server takes it to each executor
    sc._tierline_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """What the operators rely on: UTC, Arrow batches bounded in rows and bytes, our package on the executors."""
    ensure_session(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(table_path(sf_dir, name))


# What encoding tasks remember in a Python worker; tasks of other kinds drop it.
MEMOS: dict = {}


def _give_back() -> None:
    """Hand a Python worker's freed memory back to the system (allocators keep it otherwise)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable, memos: bool = False) -> Callable:
    """A ``mapInArrow`` function that gives memory back at the end of a task.

    Workers live on between tasks and stages; what one stage needed for a moment
    must not add to the next one's need. Only tasks with ``memos`` leave MEMOS to the next.
    """
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if not memos:
                MEMOS.clear()
            _give_back()
    return tidied


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder (with the session's codec, or ``codec``) and read it back.

    Cuts the lineage: lost executors cost a re-read, not the work before.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, f"llm-{label}")
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a counted table within the bound; otherwise a shuffle join."""
    return F.broadcast(df) if rows <= bound else df


def eq_null_safe(left: DataFrame, right: DataFrame, columns: list[tuple[str, str]]):
    """Equality on pairs of columns that also pairs null with null."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in columns])


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                    F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
    return row["n"], row["x"], row["y"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: ``(node, root)``, root the least node.

    Alternating large-star and small-star rounds (min aggregates and joins; no
    neighbourhood is ever gathered), each round written to the shared folder,
    until the edge set no longer changes. Loops and edges with a null end are
    ignored; nodes without an edge are not listed.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    e = stored(e, "edges")
    seen = _fingerprint(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        e = stored(small, "small-star")
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
