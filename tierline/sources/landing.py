"""Reading landed feed files: one explicit schema, any of Parquet / JSON / CSV.

Feeds arrive as files in a landing folder. Reads never infer a schema (that
would scan the data twice and drift between batches). Malformed JSON/CSV
records are kept in a quarantine column instead of failing the batch, and
unreadable files can be skipped, so one bad source does not stop the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.functions.time import instant

CORRUPT_COLUMN = "_corrupt_record"


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                quarantine: bool = True, skip_bad_files: bool = False) -> DataFrame:
    """Landed files with the given schema.

    For text formats with ``quarantine``, a malformed record yields a row whose
    fields are null and whose ``_corrupt_record`` holds the raw text.
    """
    reader = spark.read.schema(schema)
    if skip_bad_files:
        reader = reader.option("ignoreCorruptFiles", "true")
    if fmt in ("json", "csv") and quarantine:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])
        reader = (spark.read.schema(schema).option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", CORRUPT_COLUMN))
        if skip_bad_files:
            reader = reader.option("ignoreCorruptFiles", "true")
    if fmt == "csv":
        reader = reader.option("header", "true")
    if fmt in ("json", "csv"):
        reader = reader.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return reader.format(fmt).load(path)


def _same_form(path) -> Column:
    """A file's path in one spelling (``file:/x`` and ``file:///x`` name one file; %-escapes undone)."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^([a-z][a-z0-9]*):/+", "$1:/")


def read_isolated(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, ledger) of landed files, one folder ``source_col=<name>`` a source; a bad file stops nothing else.

    Files that cannot be read are skipped. The ledger, one row a source, holds the
    number of files landed and read, the rows, and the names of the files of
    which no row was read (unreadable, or empty): the listed files less those
    that the rows name as their origin. Listing reads no file body.
    """
    from tierline.operators.retention import list_files

    whole = T.StructType([*[f for f in schema.fields if f.name != source_col], T.StructField(source_col, T.StringType())])
    rows = read_landed(spark, path, whole, fmt, quarantine=False, skip_bad_files=True)
    source = F.regexp_extract(F.col("file"), f"/{source_col}=([^/]*)/", 1)
    listed = list_files(spark, path, "*").select(_same_form(F.col("file_path")).alias("file"))
    read = rows.groupBy(_same_form(F.col("_metadata.file_path")).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    ledger = (listed.join(read, "file", "left").groupBy(source.alias(source_col))
              .agg(F.count(F.lit(1)).alias("files"), F.count("rows").alias("files_read"),
                   F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                   F.sort_array(F.collect_list(F.when(F.col("rows").isNull(), F.element_at(F.split("file", "/"), -1)))).alias("skipped")))
    return rows, ledger


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the quarantine column, quarantined records).

    Quarantined rows keep every column (the fields are null where the record
    did not parse); Spark does not allow a query on the raw-text column alone.
    """
    if CORRUPT_COLUMN not in df.columns:
        return df, df.limit(0)
    # A 32-bit hash is always >= its minimum, so this is always true, but the
    # optimizer cannot fold it away: the scan keeps the data columns, and
    # Spark allows the query even when the caller only counts.
    data = [F.col(f"`{c}`") for c in df.columns if c != CORRUPT_COLUMN]
    parsed = (F.hash(*data) >= F.lit(-(2 ** 31))) if data else F.lit(True)
    bad = F.col(CORRUPT_COLUMN).isNotNull()
    return df.filter(~bad & parsed).drop(CORRUPT_COLUMN), df.filter(bad & parsed)


def write_landed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Land a batch of rows as new files (append)."""
    writer = df.write.mode("append")
    if fmt == "csv":
        writer = writer.option("header", "true")
    if fmt in ("json", "csv"):
        writer = writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    writer.format(fmt).save(path)


def history_range(df: DataFrame, end, days: int = 30, col: str = "interval_start",
                  partition_col: str = "event_date") -> DataFrame:
    """Rows of the ``days`` before ``end`` (inclusive bounds, naive bounds in UTC).

    When the table is stored by ``partition_col`` (the UTC date of ``col``) the
    implied dates are stated too, since Spark derives none from a time range.
    """
    end_c = instant(end)
    start_c = end_c - F.make_interval(days=F.lit(days))
    rows = df.filter(F.col(col).between(start_c, end_c))
    if partition_col in df.columns:
        rows = rows.filter(F.col(partition_col).between(F.to_date(start_c), F.to_date(end_c)))
    return rows
