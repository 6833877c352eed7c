"""Ranks over tables of any size: a range-partitioned sort and offsets, no window over a whole group.

A window ranks a group inside one task, however large the group is. Here the
rows are sorted across all tasks; each row's place in its partition is known
from the sort itself, and the rows of earlier partitions are one count per
(group, partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierline.session import fresh_dir

_PLACE_BITS = 33        # monotonically_increasing_id(): partition above, place in it below


def ranked(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], rank: str = "rank",
           size: str | None = None) -> DataFrame:
    """``rows`` with their 1-based rank by ``order`` inside ``groups`` (and, if named, the group's size).

    The sorted rows are written once to the shared folder, so ranks do not
    change when a lost task is run again; rows equal in every order column get
    different ranks, in any order. One group may span all partitions. The
    offsets hold one row per group and partition it reaches. Null groups form a
    group; an empty table gives an empty result. ``rows`` must have no columns
    named ``_place`` or ``_part``.
    """
    spark = rows.sparkSession
    keys = [F.col(f"`{g}`") for g in groups]
    path = fresh_dir(spark, "ranked")
    sort = [*[k.asc() for k in keys], *order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    table = spark.read.parquet(path).withColumn("_part", F.shiftright("_place", _PLACE_BITS))

    parts = table.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_from"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if size:
        parts = parts.withColumn(size, F.sum("_n").over(Window.partitionBy(*groups)))
    left, right = table.alias("l"), parts.alias("r")
    same = F.col("l._part") == F.col("r._part")
    for g in groups:
        same = same & F.col(f"l.`{g}`").eqNullSafe(F.col(f"r.`{g}`"))
    out = [F.col(f"l.`{c}`") for c in rows.columns]
    out.append((F.col("l._place") - F.col("r._from") + F.col("r._before") + 1).alias(rank))
    if size:
        out.append(F.col(f"r.`{size}`"))
    return left.join(right, same).select(*out)
