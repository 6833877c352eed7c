"""Temp views over the bound feeds, for users who prefer ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierline.sources import bindings as B


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> dict[str, DataFrame]:
    """Register the binding-E feeds as temp views; returns them by name."""
    views = {
        f"{prefix}silver_prices": B.prices_e(spark, sf_dir),
        f"{prefix}silver_mix": B.mix_e(spark, sf_dir),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def gold_sql(prices_view: str, mix_view: str, components: list[str], share_col: str = "share_pct",
             computed_at: str | None = None) -> str:
    """The gold summary as Spark SQL text over two views (aggregate, then join)."""
    def mean(c: str) -> str:
        scaled = f"CAST(signum({c}) * floor(abs({c}) * 10000.0 + 0.5) AS BIGINT)"
        return f"CAST(SUM({scaled}) AS DOUBLE) / 10000.0 / COUNT({c})"

    def r2(x: str) -> str:
        return f"(signum({x}) * floor(abs({x}) * 100.0 + 0.5) / 100.0)"

    comps = ",\n           ".join(f"{r2(mean(c))} AS {c}" for c in components)
    at = f"CAST('{computed_at}' AS TIMESTAMP)" if computed_at else "current_timestamp()"
    return f"""
WITH hp AS (
    SELECT entity, CAST(date_trunc('HOUR', interval_start) AS TIMESTAMP) AS window_start,
           {r2(mean("price"))} AS avg_price, {r2("MAX(price)")} AS max_price, {r2("MIN(price)")} AS min_price
    FROM {prices_view} GROUP BY 1, 2),
hm AS (
    SELECT entity, CAST(date_trunc('HOUR', time) AS TIMESTAMP) AS window_start,
           {r2(mean(share_col))} AS {share_col},
           {comps}
    FROM {mix_view} GROUP BY 1, 2)
SELECT hp.entity, hp.window_start, hp.window_start + INTERVAL 1 HOUR AS window_end,
       avg_price, max_price, min_price, {share_col}, {", ".join(components)}, {at} AS computed_at
FROM hp LEFT JOIN hm ON hp.entity = hm.entity AND hp.window_start = hm.window_start"""
