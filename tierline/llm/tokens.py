"""Token counts with a digest cache.

Content is identified by the SHA-256 of its normalised text (null becomes the
empty text; nothing else may be normalised away, since any change of the bytes
can change the count) and the tokenizer by the SHA-256 of its vocabulary file.
Stored counts are joined on both digests, only distinct misses are encoded, and
their counts are appended to the cache.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.encoding import piece_memo, n_ids, version_digest

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def _cached(spark, cache_path: str, version: str) -> DataFrame | None:
    """Stored counts of one tokenizer version; None when no cache was written yet.

    Only a missing path means "none"; any other failure is raised.
    """
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    # two jobs may have stored the same content; equal digests have equal counts
    return cache.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(name: str):
    def run(batches):
        memo = piece_memo(name, n_ids)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [sum(v) for v in memo.values(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
    return run


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str = "byte_bpe_50k.json",
                 limit: int = 512) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs(doc_id, text)``.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows each get a
    row; other columns are ignored, whatever their names. Special strings in a
    text are tokens, as is the library's default; nothing is added, cut or
    padded. The cache at ``cache_path`` gains the counts of contents it lacked.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("text", 256)))
    # copies meet in the map-side aggregate, so a text of a million copies is shuffled once per task
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    cache = _cached(spark, cache_path, version)
    if cache is not None:
        misses = misses.join(cache.select("digest"), "digest", "left_anti")
    counted = misses.mapInArrow(_counter(tokenizer), "digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache_path)
    known = _cached(spark, cache_path, version)
    return (keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
            .join(known, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
