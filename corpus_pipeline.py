"""The corpus pipeline: quality, language, near duplicates, mixing, packing.

Each stage reads the rows its predecessor kept; the result of a stage is
written as Parquet to the shared folder and read again by the next one.

For every stage: an empty table gives an empty result; repeated rows and repeated
ids are separate documents; texts of any length are read whole; columns beyond
doc_id, text, lang, source and n_chars, whatever their names, are carried unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierline.llm import langid, mixing, ngram, packing, quality
from tierline.llm.common import prepare, read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the base rules or the outlier test reject go.

    A null or empty text has no words and goes. A null lang or source is a value
    of its own when rows are grouped. Equal rows get the same decision.
    """
    prepare(spark)
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a language recognised with confidence go.

    A null text, or one without a letter, goes. Rows with a null lang are judged but
    not learned from; a confidence equal to the bound is accepted.
    """
    prepare(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each near-duplicate class stays.

    The least doc_id of a class stays (a text that only rows without an id hold
    comes first; of equal rows any one). Null and empty texts are copies of one text; texts without a word
    are linked with no other text.
    """
    prepare(spark)
    return ngram.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents as often, and as far, as the mix takes them.

    A text without a word, or null, is taken by no mix and goes. A null source is a
    source of its own, the last one. Ties in the selection order are equal rows.
    """
    prepare(spark)
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the mix's documents packed into sequences.

    A null text counts as empty and is one piece that holds the end token only.
    """
    prepare(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# the covariance estimate, the trained classifier and the packing search have no SQL form;
# tests/llm holds each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
