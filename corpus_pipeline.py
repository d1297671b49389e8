"""A corpus pipeline: quality, near duplicates, personal data, mixing of sources, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of `docs`, and returns the columns of
`documents`; the last one returns packed pieces. `run` writes each stage to the shared folder and
reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscore.llm import jaccard_join, mixing, packing, pseudonyms, quality
from folioscore.llm.common import crc_bucket, own_name
from folioscore.session import ship_package, staged

# A demonstration key; real use takes one from a secret store.
KEY = b"registered query"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts get the score of padding; without labels all documents stay; repeated rows
    score alike; of several texts with one labelled id the first in order is learned from; an empty
    table stays empty; columns of any name pass through.
    """
    ship_package(spark)
    score = own_name("score")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_bucket("doc_id", 5) != 0)
    network = quality.fit(docs, labels)
    return quality.scored(docs, network, score_column=score).filter(F.col(score) >= 0.3).drop(score)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of similar texts.

    Texts without a word are in no class; of equal rows one stays; see `jaccard_join.one_of_each`.
    """
    ship_package(spark)
    return jaccard_join.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; the length column follows the new text.

    Null and empty texts stay as they are, and so do rows without a find; repeated rows stay equal;
    whole texts of any length are read; columns of any name pass through.
    """
    ship_package(spark)
    spans = own_name("spans")
    masked = pseudonyms.pseudonymised(docs, KEY, spans_column=spans)
    length = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length).drop(spans)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets.

    Null texts have size 0, null sources are one source; repeated rows get the same copies; ties in
    rank are broken by id, size and text; an empty table stays empty.
    """
    ship_package(spark)
    return mixing.mixed_documents(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places in windows.

    Null and empty texts have their end id only; repeated rows are packed each; long texts are cut.
    """
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality), ("near_duplicates", one_of_near_duplicates), ("personal_data", without_personal_data),
    ("mixing", mixed_sources), ("packing", packed_windows),
]

# A trained network and token ids are beyond SQL; tests/llm/test_pipeline.py follows the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
