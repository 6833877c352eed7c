"""tierline: layered time-series analytics on Spark.

Raw feeds of entities that report a measure (a price) and a component mix
are landed as files, normalized, contract-checked, deduplicated into silver,
and rolled up into an hourly gold summary per entity. Analytics (snapshots,
z-score anomaly status, distributions, mix series, data health) and data
management (retention, archive, backfill, schema evolution) run on top.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark's own
expressions, so Catalyst plans it and nothing is pulled through the driver.
"""

__version__ = "0.1.0"
