"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierline.llm import (forest, importance, langid, licences, mixing, neighbours, ngram, packing, phrases, quality,
                          sharding, tokens, urls)
from tierline.llm.common import fresh_dir, read

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


@query("op1_licence_scan")
def op1(spark, sf_dir):
    """Licence sentences and licences of every document."""
    return licences.scan(read(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2(spark, sf_dir):
    """Base rules and robust outlier verdict of every document."""
    return quality.quality(read(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3(spark, sf_dir):
    """Token counts of every document through a digest cache (a new cache each call)."""
    return tokens.token_counts(read(spark, sf_dir, "documents"), fresh_dir(spark, "llm-token-cache"))


@query("op4_language_id")
def op4(spark, sf_dir):
    """Predicted language of every document."""
    return langid.identify(read(spark, sf_dir, "documents"))


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    """Every document's pieces, packed into sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


@query("op6_sharding")
def op6(spark, sf_dir):
    """Slot and shard of every document."""
    return sharding.placements(read(spark, sf_dir, "documents"))


@query("op7_nearest_neighbours")
def op7(spark, sf_dir):
    """The ten nearest neighbours of every hundredth vector."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


@query("op8_url_filters")
def op8(spark, sf_dir):
    """Verdict of every page's url."""
    return urls.judge(read(spark, sf_dir, "pages"))


@query("op9_source_mixing")
def op9(spark, sf_dir):
    """Words the mix takes of every document."""
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op10_ngram_jaccard")
def op10(spark, sf_dir):
    """Near-duplicate class and links of every document."""
    return ngram.near_duplicates(read(spark, sf_dir, "documents"))


@query("op11_importance_resampling")
def op11(spark, sf_dir):
    """Weight, score and rank of every document against the benchmark's word distribution."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query("op12_minhash_forest")
def op12(spark, sf_dir):
    """Near-duplicate component of every document."""
    return forest.forest_classes(read(spark, sf_dir, "documents"))


@query("op13_phrase_mining")
def op13(spark, sf_dir):
    """The first phrases of every language."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


ORACLE = {
    "op1_licence_scan": licences.scan_sql(),
    "op6_sharding": sharding.placements_sql(),
    "op11_importance_resampling": "SELECT doc_id, n_features, weight, score, rank FROM (" + importance.resample_sql() + ")",
    "op12_minhash_forest": forest.forest_classes_sql(),
    "op13_phrase_mining": phrases.collocations_sql(),
}
