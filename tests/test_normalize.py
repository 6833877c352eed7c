"""Normalization: the reference's transformer cases, plus our edge rows."""

from __future__ import annotations

from pyspark.sql import types as T

from tests.conftest import ts
from tierline.operators import normalize as N

RAW_PRICES = T.StructType([
    T.StructField("time", T.TimestampNTZType()), T.StructField("entity", T.StringType()),
    T.StructField("lmp", T.DoubleType()), T.StructField("energy", T.DoubleType()),
    T.StructField("congestion", T.DoubleType()),
])
RAW_MIX = T.StructType([
    T.StructField("time", T.TimestampNTZType()), T.StructField("entity", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("natural_gas", "wind", "solar", "coal", "nuclear")],
])


def raw_prices(spark):
    rows = [(ts(0), "ERCOT", 25.1, 24.0, 1.1), (ts(1), "ERCOT", 30.4, 29.0, 1.4), (ts(2), "ERCOT", 28.9, 27.5, 1.4)]
    return spark.createDataFrame(rows, RAW_PRICES)


def raw_mix(spark, with_other=False):
    rows = [(ts(0), "ERCOT", 45.0, 25.0, 10.0, 15.0, 5.0), (ts(1), "ERCOT", 42.0, 28.0, 12.0, 13.0, 5.0),
            (ts(2), "ERCOT", 40.0, 30.0, 15.0, 10.0, 5.0)]
    df = spark.createDataFrame(rows, RAW_MIX)
    if with_other:
        from pyspark.sql import functions as F
        df = df.withColumn("other", F.lit(0.0))
    return df


PRICE_MAP = {"time": "interval_start", "lmp": "price", "energy": "energy", "congestion": "congestion"}


def test_prices_timestamps_are_utc_instants(spark):
    out = N.normalize_prices(raw_prices(spark), column_map=PRICE_MAP)
    assert isinstance(out.schema["interval_start"].dataType, T.TimestampType)
    assert [r.interval_start for r in out.orderBy("interval_start").collect()] == [ts(0), ts(1), ts(2)]


def test_prices_price_is_double_and_market_defaults(spark):
    out = N.normalize_prices(raw_prices(spark), column_map=PRICE_MAP)
    assert isinstance(out.schema["price"].dataType, T.DoubleType)
    assert {r.market for r in out.collect()} == {"UNKNOWN"}


def test_prices_drop_columns_outside_contract(spark):
    out = N.normalize_prices(raw_prices(spark), column_map=PRICE_MAP)
    assert "energy" not in out.columns and "congestion" not in out.columns
    assert out.columns == ["entity", "interval_start", "price", "market"]


def test_entity_added_when_absent(spark):
    out = N.normalize_prices(raw_prices(spark).drop("entity"), entity="CAISO", column_map=PRICE_MAP)
    assert {r.entity for r in out.collect()} == {"CAISO"}


def test_mix_share_values(spark):
    out = N.normalize_mix(raw_mix(spark), column_map={})
    assert [r.share_pct for r in out.orderBy("time").collect()] == [35.0, 40.0, 45.0]


def test_mix_share_with_other_column(spark):
    out = N.normalize_mix(raw_mix(spark, with_other=True), column_map={})
    vals = [r.share_pct for r in out.collect()]
    assert all(0 <= v <= 100 for v in vals)
    assert "other" in out.columns


def test_all_zero_components_share_is_null(spark):
    df = spark.createDataFrame([(ts(0), "X", 0.0, 0.0, 0.0, 0.0, 0.0)], RAW_MIX)
    assert N.normalize_mix(df, column_map={}).collect()[0].share_pct is None


def test_coerce_numeric_edge_values(spark):
    rows = [(None,), ("abc",), ("",), ("1e3",), ("12.5f",), ("1_000",), (" 7.25 ",), ("nan",), ("inf",)]
    df = spark.createDataFrame(rows, "v string")
    out = [r.v for r in N.coerce_numeric(df, ["v"], fill=-1.0).collect()]
    assert out == [-1.0, -1.0, -1.0, 1000.0, -1.0, -1.0, 7.25, -1.0, -1.0]


def test_coerce_numeric_without_fill_keeps_null(spark):
    df = spark.createDataFrame([("x",), ("2",)], "v string")
    assert [r.v for r in N.coerce_numeric(df, ["v"], fill=None).collect()] == [None, 2.0]


def test_rename_two_sources_to_one_target(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", None), (None, "2026-01-01 01:00:00")],
                               "`Interval Start` string, time string")
    out = N.rename_by_contract(df, {"Interval Start": "interval_start", "time": "interval_start"})
    assert out.columns == ["interval_start"]
    assert [r.interval_start for r in out.collect()] == ["2026-01-01 00:00:00", "2026-01-01 01:00:00"]


def test_first_present_keeps_zero(spark):
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0)], "a double, b double")
    assert [r.x for r in df.select(N.first_present(df, "a", "b").alias("x")).collect()] == [0.0, 5.0]


def test_unparsable_timestamp_becomes_null(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00",), ("not a time",)], "t string")
    assert [r.t for r in N.normalize_timestamps(df, ["t"]).collect()] == [ts(0), None]


def test_union_feeds_fills_missing_columns(spark):
    a = spark.createDataFrame([("A", 1.0)], "entity string, price double")
    b = spark.createDataFrame([("B", "x")], "entity string, market string")
    out = N.union_feeds(a, b).orderBy("entity").collect()
    assert out[0].market is None and out[1].price is None


def test_empty_input_gives_empty_output(spark):
    out = N.normalize_prices(raw_prices(spark).limit(0), column_map=PRICE_MAP)
    assert out.count() == 0
