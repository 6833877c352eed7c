"""The polled feed as Structured Streaming queries.

Raw files land in a folder; a file stream picks up what is new. Event-time
watermarks close hours; an hour is emitted once, after it closes, and rows
that arrive for a closed hour are dropped (the batch path instead keeps the
first-written partial hour; see ``gold.gold_incremental``).

Checkpoints and sinks live under the shared folder (``session.shared_dir``),
so a restarted driver or a lost executor resumes from the last commit. The
``foreachBatch`` medallion job writes every micro-batch to its own ``batch_id``
folder with overwrite, so a replayed batch replaces its own output instead of
duplicating it; inside it rows are partitioned by date, so a batch reads only
its own dates of the tables written before.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions.numeric import exact_mean, round_half_away
from tierline.functions.time import instant_micros
from tierline.operators import gold as G
from tierline.operators.contracts import contract_report, gate_by_entity, quarantine
from tierline.operators.normalize import normalize_mix, normalize_prices
from tierline.operators.silver import new_mix_rows, new_price_rows
from tierline.settings import DEFAULT_MIX, MIX_CONTRACT, PRICE_CONTRACT, PRICE_SILVER_COLUMNS, MixSpec

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state (open hours, dedup keys, join buffers) in RocksDB.

    State then lives off the JVM heap and is checkpointed incrementally
    (changelog), so large state does not cause GC pauses or full snapshots.
    Only set when the cluster has not chosen a provider itself; a checkpoint
    keeps the provider it was created with.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if current is None or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB_PROVIDER)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def land(df: DataFrame, landing: str, files: int | None = None) -> None:
    """Drop a batch of raw rows into the landing folder as new Parquet files,
    one per partition (or at most ``files``, merged without a shuffle)."""
    out = df.coalesce(files) if files else df
    out.write.mode("append").parquet(landing)


def file_stream(spark: SparkSession, landing: str, schema, max_files: int | None = None) -> DataFrame:
    use_rocksdb_state(spark)
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(landing)


def run_available(stream_writer, timeout: int | None = None):
    """Start with ``availableNow``: process everything landed so far, then stop.

    No time limit unless the caller sets one: a backlog takes as long as it takes.
    """
    q = stream_writer.trigger(availableNow=True).start()
    if timeout is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"stream did not finish within {timeout}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def to_parquet(df: DataFrame, sink: str, checkpoint: str, mode: str = "append"):
    return (df.writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).outputMode(mode))


def hourly_price_stream(prices: DataFrame, delay: str, time_col: str = "interval_start") -> DataFrame:
    """Tumbling one-hour avg/max/min per entity, emitted when the hour closes.

    ``delay`` is how far behind the newest row a row may arrive and still count.
    """
    w = F.window(F.col(time_col), "1 hour")
    agg = (prices.withWatermark(time_col, delay)
           .groupBy(w.alias("w"), F.col("entity"))
           .agg(exact_mean("price").alias("avg"),
                F.max("price").alias("mx"), F.min("price").alias("mn")))
    return agg.select(
        "entity", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        round_half_away("avg").alias("avg_price"),
        round_half_away(F.col("mx")).alias("max_price"),
        round_half_away(F.col("mn")).alias("min_price"),
    )


def hourly_mix_stream(mix: DataFrame, delay: str, spec: MixSpec = DEFAULT_MIX) -> DataFrame:
    w = F.window(F.col(spec.time_col), "1 hour")
    cols = [spec.share_col, *spec.components]
    agg = (mix.withWatermark(spec.time_col, delay)
           .groupBy(w.alias("w"), F.col("entity"))
           .agg(*[exact_mean(c).alias(f"a_{c}") for c in cols]))
    return agg.select(
        F.col("entity").alias("m_entity"), F.col("w").alias("m_w"),
        *[round_half_away(f"a_{c}").alias(c) for c in cols])


def gold_join_stream(prices: DataFrame, mix: DataFrame, delay: str, spec: MixSpec = DEFAULT_MIX) -> DataFrame:
    """Hourly prices left-joined to hourly mix, both streaming (append mode)."""
    w = F.window(F.col("interval_start"), "1 hour")
    p = (prices.withWatermark("interval_start", delay)
         .groupBy(w.alias("w"), F.col("entity"))
         .agg(exact_mean("price").alias("avg"),
              F.max("price").alias("mx"), F.min("price").alias("mn")))
    m = hourly_mix_stream(mix, delay, spec)
    j = p.join(m, (p.entity == m.m_entity) & (p.w == m.m_w), "left_outer")
    return j.select(
        "entity", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        round_half_away("avg").alias("avg_price"),
        round_half_away(F.col("mx")).alias("max_price"),
        round_half_away(F.col("mn")).alias("min_price"),
        spec.share_col, *spec.components)


def dedup_stream(prices: DataFrame, delay: str) -> DataFrame:
    """Complete rows of a price stream, each distinct row once, remembered for ``delay`` of event time.

    As in a silver batch, rows that share a key but differ all enter; what a key
    of an earlier batch refuses is decided by ``MedallionBatch``, which reads
    the table written so far. ``delay`` is how far behind the newest row a row
    may arrive; later ones are dropped, so choose it from the feed.
    """
    rows = prices.filter(F.col("entity").isNotNull() & F.col("interval_start").isNotNull()
                         & F.col("price").isNotNull())
    return rows.withWatermark("interval_start", delay).dropDuplicatesWithinWatermark(prices.columns)


def write_batch(df: DataFrame, path: str, batch_id: int, date_col: str, time_col: str) -> None:
    """One batch's rows in its own folder (overwritten by a replay), by date inside it."""
    (df.withColumn(date_col, F.to_date(time_col)).write.mode("overwrite").partitionBy(date_col)
     .parquet(f"{path}/batch_id={batch_id}"))


def read_batch(spark: SparkSession, df: DataFrame, path: str, batch_id: int, date_col: str) -> DataFrame:
    """The batch just written, without the partition column (schema given: it may be empty)."""
    schema = df.withColumn(date_col, F.lit(None).cast("date")).schema
    return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id}").drop(date_col)


def keep_aside(raw: DataFrame, norm: DataFrame, report: DataFrame, bronze_path: str | None,
               quarantine_path: str | None, batch_id: int) -> None:
    """The batch as it came, and what the contract gate holds back, each to its own table."""
    if bronze_path:
        raw.write.mode("overwrite").parquet(f"{bronze_path}/batch_id={batch_id}")
    if quarantine_path:
        quarantine(norm, report).write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")


class MedallionBatch:
    """``foreachBatch`` body: raw price files -> normalize -> contract gate ->
    new silver rows -> incremental gold, against the tables written so far.

    Each table is a folder of ``batch_id=N`` partitions written with overwrite,
    so replaying batch N (after a failure) rewrites exactly its own output.
    """

    def __init__(self, silver_path: str, gold_path: str, mix: DataFrame | str, spec: MixSpec = DEFAULT_MIX,
                 computed_at=None, bronze_path: str | None = None, quarantine_path: str | None = None):
        """``mix`` is the silver mix: a DataFrame, or the folder of a silver mix
        table that another stream keeps (read as it stands at each batch).
        ``bronze_path`` keeps every batch as it came, ``quarantine_path`` the
        rows that the contract gate holds back."""
        self.bronze_path = bronze_path
        self.quarantine_path = quarantine_path
        self.silver_path = silver_path
        self.gold_path = gold_path
        self.mix = mix
        self.spec = spec
        self.computed_at = computed_at

    @staticmethod
    def _prior(spark: SparkSession, path: str, batch_id: int | None) -> DataFrame | None:
        """The rows of a batch-folder table written before ``batch_id`` (all when None).

        Only a missing path means that no batch was written yet; any other
        failure is raised, since an unread table would let every key in again.
        """
        try:
            df = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        if batch_id is not None:
            df = df.filter(F.col("batch_id") < batch_id)
        return df.drop("batch_id")

    def _mix(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.mix, str):
            mix = self._prior(spark, self.mix, None)
            if mix is None:
                raise RuntimeError(f"no silver mix at {self.mix}")
            return mix
        return self.mix

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The batch feeds both the contract report and the row path; keep the
        # normalized rows (memory, spilling to disk) instead of re-reading the
        # source files for each. Released when the batch is done.
        norm = normalize_prices(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._load(spark, batch, norm, batch_id)
        finally:
            norm.unpersist()

    def _load(self, spark: SparkSession, raw: DataFrame, norm: DataFrame, batch_id: int) -> None:
        report = contract_report(norm, PRICE_CONTRACT).persist(StorageLevel.MEMORY_AND_DISK)    # a row an entity, read by gate and quarantine
        try:
            self._load_gated(spark, raw, norm, report, batch_id)
        finally:
            report.unpersist()

    def _load_gated(self, spark: SparkSession, raw: DataFrame, norm: DataFrame, report: DataFrame, batch_id: int) -> None:
        keep_aside(raw, norm, report, self.bronze_path, self.quarantine_path, batch_id)
        silver_before = self._prior(spark, self.silver_path, batch_id)
        fresh = gate_by_entity(new_price_rows(norm, silver_before), report).select(*PRICE_SILVER_COLUMNS)
        write_batch(fresh, self.silver_path, batch_id, "event_date", "interval_start")
        new_silver = read_batch(spark, fresh, self.silver_path, batch_id, "event_date")
        gold_before = self._prior(spark, self.gold_path, batch_id)
        mix = self._mix(spark)
        if gold_before is None:
            new_gold = G.gold_summary(new_silver, mix, self.spec, self.computed_at)
        else:
            new_gold = G.gold_incremental(new_silver, mix, gold_before, self.spec, self.computed_at)
        write_batch(new_gold, self.gold_path, batch_id, "window_date", "window_start")


class MixSilverBatch:
    """``foreachBatch`` body for the mix feed: raw files -> normalize -> contract
    gate -> new silver mix rows, written to ``batch_id=N`` (overwrite, so a
    replayed batch replaces its own output)."""

    def __init__(self, silver_path: str, spec: MixSpec = DEFAULT_MIX, contract=MIX_CONTRACT,
                 bronze_path: str | None = None, quarantine_path: str | None = None):
        self.silver_path = silver_path
        self.spec = spec
        self.contract = contract
        self.bronze_path = bronze_path
        self.quarantine_path = quarantine_path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        norm = normalize_mix(batch, mix=self.spec).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            report = contract_report(norm, self.contract)
            keep_aside(batch, norm, report, self.bronze_path, self.quarantine_path, batch_id)
            before = MedallionBatch._prior(spark, self.silver_path, batch_id)
            fresh = gate_by_entity(new_mix_rows(norm, before, self.spec), report).select(*self.spec.silver_columns())
            write_batch(fresh, self.silver_path, batch_id, "event_date", self.spec.time_col)
        finally:
            norm.unpersist()


class LateLedgerBatch:
    """``foreachBatch`` body: hourly prices in which every landed row is accounted for.

    A stateful streaming aggregate drops late rows without a trace. Here each
    batch is split by the watermark that stood before it (newest event time of
    all earlier batches less ``delay``, kept in ``progress``): rows whose hour
    had closed by then, and rows without a time, go to ``late`` with the reason;
    the others to ``on_time`` by date. Then the hours that the new watermark
    closes are aggregated once, from the on-time rows of their dates alone, into
    ``gold`` with their row counts.

    Every table is a folder of ``batch_id=N`` written with overwrite and read
    only up to the batch before, so a replayed batch gives the same result.
    """

    def __init__(self, base: str, delay: str, time_col: str = "interval_start"):
        self.base, self.delay, self.time_col = base, delay, time_col

    def _watermark(self, spark: SparkSession, batch_id: int):
        """(watermark before the batch, newest event time before it) in epoch microseconds, or None."""
        done = MedallionBatch._prior(spark, f"{self.base}/progress", batch_id)
        if done is None:
            return None, None
        newest = F.max("newest")
        row = done.agg(F.unix_micros(newest - F.expr(f"INTERVAL {self.delay}")).alias("w"), F.unix_micros(newest).alias("n")).first()
        return row["w"], row["n"]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, t = batch.sparkSession, F.col(self.time_col)
        before, newest = self._watermark(spark, batch_id)
        end = F.date_trunc("hour", t) + F.expr("INTERVAL 1 HOUR")
        closed = F.coalesce(end <= instant_micros(before), F.lit(False)) if before is not None else F.lit(False)
        reason = F.when(t.isNull(), F.lit("no time")).when(closed, F.lit("closed hour"))
        rows = batch.withColumn("late_reason", reason).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._split(spark, rows, batch_id, before, newest)
        finally:
            rows.unpersist()

    def _split(self, spark, rows: DataFrame, batch_id: int, before: int | None, newest: int | None) -> None:
        t = F.col(self.time_col)
        rows.filter("late_reason is not null").write.mode("overwrite").parquet(f"{self.base}/late/batch_id={batch_id}")
        write_batch(rows.filter("late_reason is null").drop("late_reason"), f"{self.base}/on_time", batch_id, "event_date", self.time_col)
        seen = F.greatest(F.max(t), instant_micros(newest))
        progress = rows.agg(seen.alias("newest"))
        progress.write.mode("overwrite").parquet(f"{self.base}/progress/batch_id={batch_id}")
        after, _ = self._watermark(spark, batch_id + 1)
        on_time = MedallionBatch._prior(spark, f"{self.base}/on_time", batch_id + 1)
        end = F.date_trunc("hour", t) + F.expr("INTERVAL 1 HOUR")
        now = instant_micros(after)
        closing = on_time.filter((end <= now) & (F.col("event_date") <= F.to_date(now)))
        if before is not None:
            was = instant_micros(before)
            closing = closing.filter((end > was) & (F.col("event_date") >= F.to_date(was - F.expr("INTERVAL 1 HOUR"))))
        hours = (closing.groupBy("entity", F.date_trunc("hour", t).alias("window_start"))
                 .agg(exact_mean("price").alias("avg"), F.max("price").alias("mx"), F.min("price").alias("mn"), F.count(F.lit(1)).alias("rows")))
        hours = hours.select("entity", "window_start", (F.col("window_start") + F.expr("INTERVAL 1 HOUR")).alias("window_end"),
                             round_half_away("avg").alias("avg_price"), round_half_away(F.col("mx")).alias("max_price"),
                             round_half_away(F.col("mn")).alias("min_price"), "rows")
        write_batch(hours, f"{self.base}/gold", batch_id, "window_date", "window_start")


def run_late_ledger(stream: DataFrame, base: str, checkpoint: str, delay: str, time_col: str = "interval_start"):
    writer = stream.writeStream.foreachBatch(LateLedgerBatch(base, delay, time_col)).option("checkpointLocation", checkpoint)
    return run_available(writer)


def row_accounts(spark: SparkSession, landing: DataFrame, base: str) -> DataFrame:
    """Per entity: rows landed, in emitted hours, late, and in hours still open (landed is the sum of the others)."""
    n = F.count(F.lit(1))
    landed = landing.groupBy("entity").agg(n.alias("landed"))
    read = lambda name: spark.read.parquet(f"{base}/{name}")
    emitted = read("gold").groupBy("entity").agg(F.sum("rows").alias("emitted"))
    late = read("late").groupBy("entity").agg(n.alias("late"))
    on_time = read("on_time").groupBy("entity").agg(n.alias("on_time"))
    out = landed
    for part in (emitted, late, on_time):
        c = part.columns[1]
        out = out.alias("l").join(part.alias("r"), F.col("l.entity").eqNullSafe(F.col("r.entity")), "left").select(
            "l.*", F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("bigint").alias(c))
    return out.withColumn("open", F.col("on_time") - F.col("emitted")).drop("on_time")


def run_mix_silver(raw_stream: DataFrame, silver_path: str, checkpoint: str, spec: MixSpec = DEFAULT_MIX, **aside):
    writer = (raw_stream.writeStream.foreachBatch(MixSilverBatch(silver_path, spec, **aside))
              .option("checkpointLocation", checkpoint))
    return run_available(writer)


def run_medallion(raw_stream: DataFrame, silver_path: str, gold_path: str, checkpoint: str,
                 mix: DataFrame, spec: MixSpec = DEFAULT_MIX, computed_at=None, **aside):
    body = MedallionBatch(silver_path, gold_path, mix, spec, computed_at, **aside)
    writer = raw_stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return run_available(writer)
