"""Data contract checks, run as aggregates per entity.

A normalized batch is checked per entity: presence of the contract's fields
(schema metadata), null counts on required fields, and type conformance. An
entity with any error contributes no rows to silver (``gate_by_entity``);
rows without an entity are quarantined, never silently lost.

All counting is one ``groupBy(entity)`` with a partial aggregate, so a
batch of any size is checked in one pass; the report has one row per entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.functions.numeric import NUMBER_PATTERN
from tierline.session import shared_dir
from tierline.settings import (
    MSG_BAD_VALUES,
    MSG_FIELD_PRESENT,
    MSG_OPTIONAL_MISSING,
    MSG_REQUIRED_MISSING,
    MSG_REQUIRED_NULLS,
    MSG_UNKNOWN_TYPE,
    MSG_WRONG_TYPE,
    Contract,
)

# Up to so many failing entities go to every task; more meet the rows in a shuffle join.
BROADCAST_ENTITIES = 100_000

_TYPE_OK = {
    "string": (T.StringType,),
    "float": (T.DoubleType, T.FloatType, T.DecimalType, T.IntegerType, T.LongType, T.ShortType, T.ByteType),
    "int": (T.IntegerType, T.LongType, T.ShortType, T.ByteType),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType),
    "bool": (T.BooleanType,),
}


def presence(df: DataFrame, contract: Contract) -> list[tuple[str, str, str]]:
    """(field, status, message) for each contract field, from the schema alone."""
    out = []
    for f in contract.fields:
        if f.name in df.columns:
            out.append((f.name, "ok", MSG_FIELD_PRESENT % f.name))
        elif f.nullable:
            out.append((f.name, "warning", MSG_OPTIONAL_MISSING % f.name))
        else:
            out.append((f.name, "error", MSG_REQUIRED_MISSING % f.name))
    return out


def contract_presence(df: DataFrame, contract: Contract) -> DataFrame:
    """Presence check as rows (field, status, message, non_null).

    Presence comes from the schema; ``non_null`` counts the values each
    present field holds (one aggregate over the data; null when absent).
    """
    rows = presence(df, contract)
    base = df.sparkSession.createDataFrame(rows, "field string, status string, message string")
    present = [f.name for f in contract.fields if f.name in df.columns]
    if not present:
        return base.withColumn("non_null", F.lit(None).cast("bigint"))
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in present]).unpivot(
        [], present, "field", "non_null")
    return base.join(F.broadcast(counts), "field", "left").select("field", "status", "message", "non_null")


def _type_failure(df: DataFrame, name: str, expected: str) -> Column | None:
    """Per-row failure flag for one field, or None when the column type settles it."""
    dtype = df.schema[name].dataType
    if expected not in _TYPE_OK:
        return None
    if isinstance(dtype, T.StringType) and expected in ("float", "int"):
        return F.col(name).isNotNull() & ~F.col(name).rlike(NUMBER_PATTERN)
    if isinstance(dtype, T.StringType) and expected == "datetime":
        return F.col(name).isNotNull() & F.col(name).try_cast("timestamp").isNull()
    return None


def _type_ok(df: DataFrame, name: str, expected: str) -> bool:
    return expected in _TYPE_OK and isinstance(df.schema[name].dataType, _TYPE_OK[expected])


def contract_counts(df: DataFrame, contract: Contract, by: str = "entity") -> DataFrame:
    """One row per entity: rows checked, null count per required field,
    value-level type failures per present field (long form: entity, field, nulls, type_failures)."""
    present = [f for f in contract.fields if f.name in df.columns]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for f in present:
        aggs.append(F.count_if(F.col(f.name).isNull()).alias(f"n__{f.name}"))
        flag = _type_failure(df, f.name, f.type)
        aggs.append((F.count_if(flag) if flag is not None else F.lit(0).cast("bigint")).alias(f"t__{f.name}"))
        aggs.append(F.count(F.col(f.name)).alias(f"v__{f.name}"))
    key = F.col(by) if by in df.columns else F.lit(None).cast("string")   # one group when absent
    wide = df.groupBy(key.alias("entity")).agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("field"),
                 F.lit(f.nullable).alias("nullable"),
                 F.lit(_type_ok(df, f.name, f.type)).alias("type_ok"),
                 F.lit(f.type).alias("expected"),
                 F.col(f"n__{f.name}").alias("nulls"),
                 F.col(f"t__{f.name}").alias("type_failures"),
                 F.col(f"v__{f.name}").alias("non_null"))
        for f in present
    ])) if present else None
    if stacked is None:
        return wide.select("entity", F.col("__rows").alias("rows_checked"))
    return wide.select("entity", F.col("__rows").alias("rows_checked"), stacked.alias("c")).select(
        "entity", "rows_checked", "c.*")


def contract_null_counts(df: DataFrame, contract: Contract, by: str = "entity") -> DataFrame:
    """Null counts of the required fields per entity."""
    required = set(contract.required())
    return (contract_counts(df, contract, by)
            .filter(F.col("field").isin(*required) if required else F.lit(False))
            .select("entity", "field", "rows_checked", "nulls"))


def contract_type_failures(df: DataFrame, contract: Contract, by: str = "entity") -> DataFrame:
    """Per entity and field: whether the column type conforms, and how many
    values fail the expected type (for text columns holding typed data).
    A field that is null throughout is not type-checked."""
    c = contract_counts(df, contract, by)
    checked = F.col("non_null") > 0
    return c.select(
        "entity", "field", "expected",
        F.when(checked, F.col("type_ok")).otherwise(F.lit(True)).alias("type_ok"),
        F.when(checked, F.col("type_failures")).otherwise(F.lit(0).cast("bigint")).alias("type_failures"),
    )


def contract_report(df: DataFrame, contract: Contract, by: str = "entity") -> DataFrame:
    """Per entity: valid, n_errors, n_warnings, errors, warnings, rows_checked, rows_failed.

    Errors: missing required field, nulls in a required field, wrong column
    type or values failing the type. Warnings: missing optional field.
    ``rows_failed`` is all rows of an invalid entity, else 0. Messages are
    joined with '; ' in contract order.
    """
    missing = [(f.name, f.nullable) for f in contract.fields if f.name not in df.columns]
    missing_errors = [MSG_REQUIRED_MISSING % n for n, nullable in missing if not nullable]
    missing_warnings = [MSG_OPTIONAL_MISSING % n for n, nullable in missing if nullable]
    c = contract_counts(df, contract, by)
    null_msg = F.when(
        (~F.col("nullable")) & (F.col("nulls") > 0),
        F.format_string(MSG_REQUIRED_NULLS, F.col("field"), F.col("nulls")))
    checked = F.col("non_null") > 0
    known = F.col("expected").isin(*_TYPE_OK.keys())
    type_msg = F.when(
        checked & ~known,
        F.format_string(MSG_UNKNOWN_TYPE, F.col("expected"), F.col("field"))
    ).when(
        checked & ~F.col("type_ok"),
        F.format_string(MSG_WRONG_TYPE, F.col("field"), F.col("expected"))
    ).when(
        checked & (F.col("type_failures") > 0),
        F.format_string(MSG_BAD_VALUES, F.col("field"),
                        F.col("type_failures"), F.col("expected")))
    order = {f.name: i for i, f in enumerate(contract.fields)}
    pos = F.coalesce(*[F.when(F.col("field") == n, F.lit(i)) for n, i in order.items()], F.lit(999))
    per_field = c.select("entity", "rows_checked", pos.alias("pos"),
                         F.concat_ws("; ", null_msg, type_msg).alias("msg"))
    grouped = per_field.groupBy("entity").agg(
        F.max("rows_checked").alias("rows_checked"),
        F.sort_array(F.collect_list(F.when(F.col("msg") != "", F.struct("pos", "msg")))).alias("msgs"),
    )
    errors = F.concat(F.array(*[F.lit(m) for m in missing_errors]) if missing_errors else F.array().cast("array<string>"),
                      F.transform(F.col("msgs"), lambda s: s["msg"]))
    warnings = F.array(*[F.lit(m) for m in missing_warnings]) if missing_warnings else F.array().cast("array<string>")
    n_err = F.size(errors)
    return grouped.select(
        "entity",
        (n_err == 0).alias("valid"),
        n_err.alias("n_errors"),
        F.size(warnings).alias("n_warnings"),
        F.array_join(errors, "; ").alias("errors"),
        F.array_join(warnings, "; ").alias("warnings"),
        F.col("rows_checked"),
        F.when(n_err > 0, F.col("rows_checked")).otherwise(F.lit(0).cast("bigint")).alias("rows_failed"),
    )


def _failing_entities(report: DataFrame) -> DataFrame:
    """The entities whose report is invalid, checked before the rows are planned.

    Spark guesses the list's size by that of the whole batch, and so would deal
    out every row of the batch by entity before it learns that the list is
    short: a few entities then mean a few tasks, each as large as its entity.
    The list is settled first (the report's one pass, checkpointed) and
    broadcast by its count of rows.
    """
    shared_dir(report.sparkSession)      # names the checkpoint folder
    failing = report.filter(~F.col("valid") & F.col("entity").isNotNull()).select("entity").checkpoint()
    return F.broadcast(failing) if failing.count() <= BROADCAST_ENTITIES else failing


def gate_by_entity(df: DataFrame, report: DataFrame) -> DataFrame:
    """Rows of entities whose report is valid. Rows with a null entity never pass.

    Rows stay in the partitions they are in unless more than
    ``BROADCAST_ENTITIES`` entities fail; then it is a shuffle join.
    """
    if "entity" not in df.columns:        # no entity, nothing can pass the gate
        return df.limit(0)
    return df.filter(F.col("entity").isNotNull()).join(_failing_entities(report), "entity", "left_anti")


def quarantine(df: DataFrame, report: DataFrame) -> DataFrame:
    """The complement of ``gate_by_entity``: rows of failing or null entities."""
    if "entity" not in df.columns:
        return df
    return df.filter(F.col("entity").isNull()).unionByName(df.join(_failing_entities(report), "entity", "left_semi"))
