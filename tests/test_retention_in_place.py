"""Age rule in place, rows without an arrival time, archive manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import ts
from tierline.operators import retention as R
from tierline.operators.bronze import write_bronze

SCHEMA = "id int, ingested_at timestamp"


def table(spark, rows):
    return spark.createDataFrame(rows, "id int, at string").select("id", F.col("at").cast("timestamp").alias("ingested_at"))


ROWS = [(1, "2026-01-01 03:00:00"), (2, "2026-01-02 23:59:59"), (3, "2026-01-03 05:59:59"), (4, "2026-01-03 06:00:00"),
        (5, "2026-01-03 07:00:00"), (6, "2026-01-04 00:00:00"), (7, None), (8, None)]
CUT = ts(6, day=3)


def stored(spark, path, rows=ROWS):
    write_bronze(table(spark, rows), path)
    return path


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_age_off_drops_rewrites_and_keeps(spark, tmp_dir):
    feeds = {"prices": stored(spark, f"{tmp_dir}/prices"), "mix": stored(spark, f"{tmp_dir}/mix", ROWS[5:])}
    other = spark.read.parquet(feeds["prices"]).filter("ingest_date = '2026-01-04'").select("_metadata.file_path").distinct()
    untouched = {r[0] for r in other.collect()}
    done = {r["feed"]: r for r in R.age_off(spark, feeds, CUT).collect()}
    assert tuple(done["prices"])[1:] == (3, 2, 1)
    assert tuple(done["mix"])[1:] == (0, 0, 0)
    assert ids(spark.read.parquet(feeds["prices"])) == [4, 5, 6, 7, 8]
    assert ids(spark.read.parquet(feeds["mix"])) == [6, 7, 8]
    assert {r[0] for r in spark.read.parquet(feeds["prices"]).filter("ingest_date = '2026-01-04'")
            .select("_metadata.file_path").distinct().collect()} == untouched
    again = R.age_off(spark, feeds, CUT).filter("removed > 0 or rewritten_partitions > 0")
    assert again.count() == 0


def test_age_off_whole_boundary_and_no_cutoff(spark, tmp_dir):
    path = stored(spark, f"{tmp_dir}/t")
    assert tuple(R.age_off(spark, {"t": path}, None).first())[1:] == (0, 0, 0)
    assert tuple(R.age_off(spark, {"t": path}, ts(23, day=3)).first())[1:] == (5, 3, 0)     # the boundary goes as a whole
    assert ids(spark.read.parquet(path)) == [6, 7, 8]
    assert tuple(R.age_off(spark, {"t": path}, ts(0, day=9)).first())[1:] == (1, 1, 0)
    assert ids(spark.read.parquet(path)) == [7, 8]


def test_age_off_reads_one_partition(spark, tmp_dir):
    """The rewrite's scan is limited to the boundary date; dropped dates are counted without columns."""
    path = stored(spark, f"{tmp_dir}/t")
    day = F.to_date(F.lit("2026-01-03"))
    t = spark.read.parquet(path)
    plan = t.filter(F.col("ingest_date") == day).filter(F.col("ingested_at") >= F.lit("2026-01-03 06:00:00").cast("timestamp"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in text
    counted = t.filter(F.col("ingest_date") < day).groupBy("ingest_date").count()
    assert "ReadSchema: struct<>" in counted._jdf.queryExecution().executedPlan().toString()


def test_unknown_arrivals_are_kept_by_every_rule(spark, tmp_dir):
    rows = table(spark, ROWS)
    cut = F.lit("2026-01-03 06:00:00").cast("timestamp")
    assert ids(R.retention_by_age(rows, cut)) == [4, 5, 6, 7, 8]
    old, keep = R.archive_split(rows, cut)
    assert (ids(old), ids(keep)) == ([1, 2, 3], [4, 5, 6, 7, 8])
    part = spark.read.parquet(stored(spark, f"{tmp_dir}/t"))
    assert ids(R.retention_by_age(part, cut)) == [4, 5, 6, 7, 8]
    old, keep = R.archive_split(part, cut)
    assert (ids(old), ids(keep)) == ([1, 2, 3], [4, 5, 6, 7, 8])
    R.retain_table(spark, f"{tmp_dir}/t", f"{tmp_dir}/v2", CUT)
    assert ids(spark.read.parquet(f"{tmp_dir}/v2")) == [4, 5, 6, 7, 8]
    row = R.retention_by_size(rows, rows, 5.5).first()
    assert (row["archived_prices"], row["kept_prices"], row["archived_mix"], row["kept_mix"]) == (3, 5, 3, 5)
    none = F.lit(None).cast("timestamp")
    assert [ids(side) for side in R.archive_split(rows, none)] == [[], [1, 2, 3, 4, 5, 6, 7, 8]]


def test_archive_manifest_of_two_exports(spark, tmp_dir):
    rows = table(spark, ROWS)
    first = F.lit("2026-01-03 00:00:00").cast("timestamp")
    R.export_archive(rows, first, f"{tmp_dir}/a", F.lit("2026-02-01 00:00:00"))
    R.export_archive(R.archive_split(rows, first)[1], F.lit("2026-01-03 06:00:00").cast("timestamp"), f"{tmp_dir}/a",
                     F.lit("2026-02-02 00:00:00"))
    got = R.archive_manifest(spark, f"{tmp_dir}/a").collect()
    assert [(str(r["archived_date"]), r["rows"], str(r["exported_at"])[:10]) for r in got] == [
        ("2026-01-03", 1, "2026-02-02"), ("2026-01-02", 1, "2026-02-01"), ("2026-01-01", 1, "2026-02-01")]
    assert all(r["file_name"].endswith(".parquet") and r["earliest"] == r["latest"] for r in got)
    assert len(R.archive_manifest(spark, f"{tmp_dir}/a", limit=1).collect()) == 1
    assert ids(spark.read.parquet(f"{tmp_dir}/a/data")) == [1, 2, 3]
