"""Retention by age and by size, with a Parquet archive of what is removed.

Plain Parquet has no DELETE. ``retain_table`` is copy-on-write: the kept rows
are written to a new version of the table, and the removed rows to the archive.
``age_off`` works in place on tables partitioned by ingest date: whole
partitions older than the cutoff are dropped unread, and only the boundary
partition is rewritten, by a dynamic partition overwrite.

A row without an arrival time is of unknown age: every rule keeps it (it is
not older than any cutoff).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierline.functions.numeric import round_half_away
from tierline.functions.time import instant, instant_micros
from tierline.settings import ARCHIVE_LISTING_LIMIT, BRONZE_CAP_GB, BRONZE_WARNING_GB, RETENTION_DAYS

PARTITION_COL = "ingest_date"     # the arrival date a stored bronze table is partitioned by


def age_cutoff(as_of: Column, days: int = RETENTION_DAYS) -> Column:
    return as_of.cast("timestamp") - F.make_interval(days=F.lit(days))


def retention_by_age(bronze: DataFrame, cutoff: Column, col: str = "ingested_at",
                     partition_col: str = PARTITION_COL) -> DataFrame:
    """The rows that stay: arrival at or after the cutoff, or unknown.

    On a table partitioned by ingest date the implied date predicate reaches
    the scan as a partition filter, so older partitions are never read.
    """
    keep = _not_before(F.col(col), cutoff)
    if partition_col in bronze.columns:
        keep = _not_before(F.col(partition_col), F.to_date(cutoff)) & keep
    return bronze.filter(keep)


def _not_before(c: Column, cutoff: Column) -> Column:
    return c.isNull() | (c >= cutoff)


def archive_split(df: DataFrame, cutoff: Column, col: str = "ingested_at") -> tuple[DataFrame, DataFrame]:
    """(archive, keep) by one predicate; every row is in exactly one (one without an instant is kept).

    Without a cutoff (null: nothing to cut) every row is kept. On a table
    partitioned by ingest date each side reads its own dates only.
    """
    old, keep = df.filter(F.col(col) < cutoff), df.filter(_not_before(F.col(col), cutoff) | cutoff.isNull())
    if PARTITION_COL in df.columns:
        day = F.to_date(cutoff)
        old = old.filter(F.col(PARTITION_COL) <= day)
        keep = keep.filter(_not_before(F.col(PARTITION_COL), day) | day.isNull())
    return old, keep


def _pick(counts: DataFrame, k: int):
    """(bucket, rows before it) of the bucket holding 0-based rank ``k``.

    ``counts`` is a small (b, cnt) table; its running sum is a window without
    partitioning, i.e. one task, which is why callers only pass tables bounded
    by construction (days of history, seconds of a day, instants of a second).
    Returns None when k is out of range.
    """
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counts.withColumn("cum", F.sum("cnt").over(w)).withColumn("prev", F.col("cum") - F.col("cnt"))
    row = (c.filter((F.col("prev") <= k) & (F.lit(k) < F.col("cum")))
           .select(F.unix_micros("b").alias("b"), "prev").first())
    return None if row is None else (row["b"], row["prev"])


def kth_instant(df: DataFrame, col: str, k: int):
    """Exact k-th smallest instant (0-based, duplicates counted) as epoch
    microseconds, or None.

    Selection in three rounds: count per day over the whole input, per second
    inside the chosen day, per instant inside the chosen second. Each round is
    one aggregate (combined map-side) whose result is bounded, and only the
    chosen bucket and its offset (two values) come back to the driver. No task
    ever holds all instants, even when one day or one second holds a third of
    the rows.
    """
    t = F.col(col).cast("timestamp")
    vals = df.filter(F.col(col).isNotNull())
    cnt = F.count(F.lit(1)).alias("cnt")
    day = _pick(vals.groupBy(F.date_trunc("day", t).alias("b")).agg(cnt), k)
    if day is None:
        return None
    return _kth_in_day(vals, t, day, k)


def _kth_in_day(vals: DataFrame, t: Column, day: tuple, k: int):
    """Rounds two and three of ``kth_instant`` inside the chosen day."""
    cnt = F.count(F.lit(1)).alias("cnt")
    r1 = k - day[1]
    d0 = instant_micros(day[0])
    in_day = vals.filter((t >= d0) & (t < d0 + F.expr("INTERVAL 1 DAY")))
    if PARTITION_COL in vals.columns:
        in_day = in_day.filter(F.col(PARTITION_COL) == F.to_date(d0))
    sec = _pick(in_day.groupBy(F.date_trunc("second", t).alias("b")).agg(cnt), r1)
    r2 = r1 - sec[1]
    s0 = instant_micros(sec[0])
    in_sec = in_day.filter((t >= s0) & (t < s0 + F.expr("INTERVAL 1 SECOND")))
    return _pick(in_sec.groupBy(t.alias("b")).agg(cnt), r2)[0]


def median_cutoff_value(df: DataFrame, col: str = "ingested_at"):
    """(n, k, cutoff as epoch microseconds) of the older-half cut.

    The first selection round also yields n (the total of the per-day counts),
    so n, k = rint(n / 2) and the chosen day come from one job.
    """
    t = F.col(col).cast("timestamp")
    vals = df.filter(F.col(col).isNotNull())
    days = vals.groupBy(F.date_trunc("day", t).alias("b")).agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = (days.withColumn("n", F.sum("cnt").over(Window.partitionBy()))
         .withColumn("k", F.rint(F.col("n") / F.lit(2.0)).cast("bigint"))
         .withColumn("cum", F.sum("cnt").over(w))
         .withColumn("prev", F.col("cum") - F.col("cnt")))
    row = (c.filter((F.col("prev") <= F.col("k")) & (F.col("k") < F.col("cum")))
           .select(F.unix_micros("b").alias("b"), "prev", "n", "k").first())
    if row is None:
        return 0, 0, None
    n, k = row["n"], row["k"]
    return n, k, _kth_in_day(vals, t, (row["b"], row["prev"]), k)


def median_cutoff_instant(df: DataFrame, col: str = "ingested_at") -> Column:
    """The older-half cutoff as a TIMESTAMP literal (null for empty input)."""
    return instant_micros(median_cutoff_value(df, col)[2])


def median_cutoff(df: DataFrame, col: str = "ingested_at") -> DataFrame:
    """The instant at 0-based position rint(n / 2) in arrival order (one row: n, k, cutoff).

    Rows before it are the older half that size-based retention removes.
    """
    n, k, cut = median_cutoff_value(df, col)
    return df.agg(F.count(col).alias("n")).select(
        "n", F.lit(k).cast("bigint").alias("k"), instant_micros(cut).alias("cutoff"))


def retention_by_size(prices: DataFrame, mix: DataFrame, size_gb: float,
                      warning_gb: float = BRONZE_WARNING_GB, cap_gb: float = BRONZE_CAP_GB,
                      col: str = "ingested_at") -> DataFrame:
    """Size rule: >= cap -> cut both feeds at the prices' median arrival; >= warning -> warn.

    One row: size, action, cutoff, and archived/kept row counts per feed, from
    one aggregate over both feeds (tagged and stacked, so no join is needed).
    """
    cut_micros = median_cutoff_value(prices, col)[2] if size_gb >= cap_gb else None
    over_cap = cut_micros is not None          # nothing to cut without a cutoff
    cut = instant_micros(cut_micros)
    action = "aged off" if over_cap else ("warning" if warning_gb <= size_gb < cap_gb else "none")
    both = (prices.select(F.col(col).alias("t"), F.lit("prices").alias("feed"))
            .unionByName(mix.select(F.col(col).alias("t"), F.lit("mix").alias("feed"))))
    # a row without an arrival time is kept
    old = F.coalesce(F.col("t") < cut, F.lit(False)) if over_cap else F.lit(False)

    def counts(feed: str) -> list[Column]:
        mine = F.col("feed") == feed
        return [F.count_if(mine & old).alias(f"archived_{feed}"), F.count_if(mine & ~old).alias(f"kept_{feed}")]

    return both.agg(*counts("prices"), *counts("mix")).select(
        F.lit(size_gb).alias("size_gb"), F.lit(action).alias("action"), cut.alias("cutoff"),
        "archived_prices", "kept_prices", "archived_mix", "kept_mix")


def apply_size_retention(spark, feeds: dict[str, str], base: str, by: str,
                         warning_gb: float = BRONZE_WARNING_GB, cap_gb: float = BRONZE_CAP_GB,
                         col: str = "ingested_at"):
    """Size rule carried out on stored bronze tables (``feeds``: name -> path).

    The stored size of all feeds is measured from their files. At the cap,
    every feed is cut at the median arrival of feed ``by``: its older rows go
    to ``base/archive/<feed>`` and the others, with rows that carry no arrival
    time, to the new table version ``base/kept/<feed>``. Below the cap nothing
    is written. Returns (size in GB, action, cutoff in epoch microseconds or
    None); action is ``aged off``, ``warning`` or ``none``.
    """
    sizes = [list_files(spark, p).agg(F.sum("size_bytes").alias("b")) for p in feeds.values()]
    total = sizes[0]
    for s in sizes[1:]:
        total = total.unionByName(s)
    size_gb = (total.agg(F.sum("b")).first()[0] or 0) / 1024.0 ** 3
    if size_gb < cap_gb:
        return size_gb, "warning" if size_gb >= warning_gb else "none", None
    cut_micros = median_cutoff_value(spark.read.parquet(feeds[by]), col)[2]
    if cut_micros is None:
        return size_gb, "none", None
    cut = instant_micros(cut_micros)
    for name, path in feeds.items():
        table = spark.read.parquet(path)
        old, keep = archive_split(table, cut, col)
        old.drop(PARTITION_COL).write.parquet(f"{base}/archive/{name}")
        keep.write.partitionBy(PARTITION_COL).parquet(f"{base}/kept/{name}")
    return size_gb, "aged off", cut_micros


def archive_export(df: DataFrame, cutoff: Column, path: str, col: str = "ingested_at") -> int:
    """Write rows older than the cutoff to a Parquet archive; returns the row count.

    The count is taken from the write itself (an observed metric), not from a
    second pass over the data.
    """
    from pyspark.sql import Observation

    obs = Observation("archive")
    old = archive_split(df, cutoff, col)[0].observe(obs, F.count(F.lit(1)).alias("rows"))
    old.write.mode("errorifexists").parquet(path)
    return int(obs.get.get("rows", 0))


def list_files(spark, path: str, glob: str = "*.parquet") -> DataFrame:
    """Files under a folder with size and modification time.

    The binary-file source lists in parallel and, with ``content`` unselected,
    reads no file bodies.
    """
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path)
            .select(F.col("path").alias("file_path"), F.col("length").alias("size_bytes"),
                    F.col("modificationTime").alias("modified")))


def archive_listing(spark, path: str, limit: int = ARCHIVE_LISTING_LIMIT) -> DataFrame:
    """Newest archive files first (by modification time, then name), size in MB."""
    files = list_files(spark, path).withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))
    return (files.withColumn("size_mb", round_half_away(F.col("size_bytes") / F.lit(1024.0 ** 2), 1))
            .orderBy(F.col("modified").desc(), F.col("file_path").desc()).limit(limit))


def archive_contents(archive: DataFrame, col: str = "ingested_at") -> DataFrame:
    """Rows and time range of an archive per arrival date, newest first."""
    return (archive.groupBy(F.to_date(col).alias("archived_date"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min(col).alias("earliest"), F.max(col).alias("latest"))
            .orderBy(F.col("archived_date").desc()))


def _delete_folder(spark, path: str) -> None:
    """Remove a folder of the table's own file system (a metadata call of the driver)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def age_off(spark, feeds: dict[str, str], cutoff, col: str = "ingested_at",
            partition_col: str = PARTITION_COL) -> DataFrame:
    """Age rule carried out in place on stored bronze tables (``feeds``: name -> path).

    Each table is partitioned by ``partition_col``, the date of ``col``. Its
    partitions before the cutoff's date go as a whole: their rows are counted
    from the file footers (no column is read) and the folders removed. The
    boundary partition is read alone; if it holds older rows its others replace
    it by a dynamic partition overwrite, which leaves every other partition
    untouched. Rows without an arrival time lie in the null partition and stay.

    One row a feed: feed, removed, dropped_partitions, rewritten_partitions.
    The steps can be repeated: a run that was cut short is finished by the next
    (its ``removed`` then counts what was left).
    """
    cut_micros = spark.range(1).select(F.unix_micros(instant(cutoff))).first()[0]
    done = []
    for name, path in feeds.items():
        if cut_micros is None:                                  # nothing has an arrival time
            done.append((name, 0, 0, 0))
            continue
        cut = instant_micros(cut_micros)
        table, day = spark.read.parquet(path), F.to_date(cut)
        # at most one row a day of history
        old = table.filter(F.col(partition_col) < day).groupBy(partition_col).count().collect()
        here = table.filter(F.col(partition_col) == day)
        before = here.agg(F.count_if(F.col(col) < cut).alias("old"), F.count(F.lit(1)).alias("n")).first()
        gone = {str(r[partition_col]) for r in old}
        removed, rewritten = sum(r["count"] for r in old) + before["old"], 0
        if 0 < before["old"] < before["n"]:
            kept = here.filter(_not_before(F.col(col), cut))
            (kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(partition_col).parquet(path))
            rewritten = 1
        elif before["old"]:
            gone.add(str(spark.range(1).select(day).first()[0]))
        for d in sorted(gone):
            _delete_folder(spark, f"{path}/{partition_col}={d}")
        done.append((name, removed, len(gone), rewritten))
    return spark.createDataFrame(done, "feed string, removed long, dropped_partitions long, rewritten_partitions long")


# --- archive with a manifest -----------------------------------------------------------------

ARCHIVE_DATE = "archived_date"


def export_archive(df: DataFrame, cutoff: Column, path: str, exported_at: Column | None = None,
                   col: str = "ingested_at") -> None:
    """Rows older than the cutoff to ``path/data`` by export and arrival date, and a manifest of the files to ``path/manifest``.

    Several exports may share a path: each adds a folder of files and its own
    manifest rows. The manifest is made by one aggregate over the files just
    written (their arrival column only): file name, date, rows, first and last
    arrival, and when the export ran.
    """
    spark = df.sparkSession
    export = f"{path}/data/export={uuid.uuid4().hex[:12]}"
    old = archive_split(df, cutoff, col)[0].withColumn(ARCHIVE_DATE, F.to_date(col)).drop(PARTITION_COL)
    old.repartition(ARCHIVE_DATE).write.partitionBy(ARCHIVE_DATE).parquet(export)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    at = F.current_timestamp() if exported_at is None else exported_at.cast("timestamp")
    files = (spark.read.schema(old.schema).parquet(export).select(name.alias("file_name"), ARCHIVE_DATE, col)
             .groupBy("file_name", ARCHIVE_DATE)
             .agg(F.count(F.lit(1)).alias("rows"), F.min(col).alias("earliest"), F.max(col).alias("latest")))
    files.withColumn("exported_at", at).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _archive_files(spark, path: str) -> DataFrame | None:
    """The manifest rows written so far (None before the first export)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def archive_manifest(spark, path: str, limit: int = ARCHIVE_LISTING_LIMIT) -> DataFrame:
    """The archive's newest files first (by export, date and name), read from the manifest alone."""
    files = _archive_files(spark, path)
    if files is None:
        raise FileNotFoundError(f"no archive at {path}")
    return files.orderBy(F.col("exported_at").desc(), F.col(ARCHIVE_DATE).desc(), F.col("file_name").desc()).limit(limit)


def retain_table(spark, src: str, dst: str, cutoff, col: str = "ingested_at",
                 partition_col: str = PARTITION_COL) -> None:
    """Copy-on-write retention of a date-partitioned table into a new version.

    The partition predicate lets the scan skip every partition older than the
    cutoff's date; rows of the boundary date are filtered exactly.
    """
    cut = instant(cutoff)
    src_df = spark.read.parquet(src)
    kept = retention_by_age(src_df, cut, col, partition_col)
    kept.write.mode("errorifexists").partitionBy(partition_col).parquet(dst)
