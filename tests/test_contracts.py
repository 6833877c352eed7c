"""Contract checks: the reference's validation cases as DataFrame tests."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tests.conftest import ts
from tierline.operators import contracts as C
from tierline.settings import PRICE_CONTRACT, load_contract

SCHEMA = T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("interval_start", T.TimestampType()),
    T.StructField("price", T.DoubleType()), T.StructField("location", T.StringType()),
    T.StructField("location_type", T.StringType()), T.StructField("market", T.StringType()),
])


def valid(spark):
    rows = [("ERCOT", ts(h), p, None, None, "REAL") for h, p in ((0, 25.1), (1, 30.4), (2, 28.9))]
    return spark.createDataFrame(rows, SCHEMA)


def report(df):
    return {r.entity: r for r in C.contract_report(df, PRICE_CONTRACT).collect()}


def test_valid_batch_passes(spark):
    r = report(valid(spark))["ERCOT"]
    assert r.valid and r.n_errors == 0 and r.rows_checked == 3 and r.rows_failed == 0


def test_missing_required_field_is_error(spark):
    r = report(valid(spark).drop("interval_start"))["ERCOT"]
    assert not r.valid and "Required field 'interval_start' is missing" in r.errors
    assert r.rows_failed == 3


def test_null_in_required_field_is_error(spark):
    df = valid(spark).union(spark.createDataFrame([("ERCOT", None, 1.0, None, None, "REAL")], SCHEMA))
    r = report(df)["ERCOT"]
    assert not r.valid and "'interval_start' has 1 null values" in r.errors


def test_missing_optional_field_is_warning(spark):
    r = report(valid(spark).drop("location"))["ERCOT"]
    assert r.valid and r.n_warnings == 1 and "location" in r.warnings


def test_text_column_for_float_is_type_error(spark):
    df = valid(spark)
    df = df.withColumn("price", df.price.cast("string"))
    r = report(df)["ERCOT"]
    assert not r.valid and "expected type 'float'" in r.errors


def test_all_null_column_skips_type_check(spark):
    rows = C.contract_type_failures(valid(spark), PRICE_CONTRACT).filter("field = 'location'").collect()
    assert rows[0].type_ok and rows[0].type_failures == 0


def test_presence_rows(spark):
    got = {r.field: r.status for r in C.contract_presence(valid(spark).drop("location"), PRICE_CONTRACT).collect()}
    assert got["location"] == "warning" and got["price"] == "ok"


def test_gate_drops_failing_and_null_entities(spark):
    bad = spark.createDataFrame([("PJM", None, 1.0, None, None, "R"), (None, ts(0), 2.0, None, None, "R")], SCHEMA)
    df = valid(spark).union(bad)
    kept = C.gate_by_entity(df, C.contract_report(df, PRICE_CONTRACT))
    assert {r.entity for r in kept.collect()} == {"ERCOT"}
    assert C.quarantine(df, C.contract_report(df, PRICE_CONTRACT)).count() == 2


def test_unknown_source_and_dataset():
    with pytest.raises(FileNotFoundError):
        load_contract("nope", "prices")
    with pytest.raises(KeyError):
        load_contract("feeds", "nope")
    assert load_contract("feeds", "prices") is PRICE_CONTRACT


def test_unknown_contract_type_is_error(spark):
    from tierline.settings import Contract, Field

    odd = Contract("odd", (Field("entity", "string", False), Field("price", "money", True)))
    r = C.contract_report(valid(spark), odd).collect()[0]
    assert not r.valid and "Unknown type 'money' in contract for field 'price'" in r.errors


def test_missing_entity_column_is_reported_and_gated(spark):
    df = valid(spark).drop("entity")
    r = C.contract_report(df, PRICE_CONTRACT).collect()
    assert len(r) == 1 and not r[0].valid and "Required field 'entity' is missing" in r[0].errors
    assert C.gate_by_entity(df, C.contract_report(df, PRICE_CONTRACT)).count() == 0
    assert C.quarantine(df, C.contract_report(df, PRICE_CONTRACT)).count() == 3
