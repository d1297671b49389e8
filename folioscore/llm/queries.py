"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscore.llm import (
    bpe, divergence, embedding_dedup, fingerprints, jaccard_join, language, merkle, mixing, packing, pseudonyms, quality, repeats, token_counts,
)
from folioscore.llm.common import crc_bucket
from folioscore.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
# A demonstration key; real use takes one from a secret store.
KEY = b"registered query"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op10_mix_sources", mixing.ORACLE)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op9_token_counts")
def count_tokens(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op6_pack_windows")
def pack_windows(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query("op4_pseudonyms")
def replace_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = pseudonyms.pseudonymised(table(spark, folder, "documents"), KEY)
    return docs.select("doc_id", "text", F.size("pii_spans").alias("n_replaced"), "pii_spans")


@query("op3_sketch_fingerprints", fingerprints.ORACLE)
def sketch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


@query("op8_quality")
def score_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    network = quality.fit(docs, labels.filter(crc_bucket("doc_id", 5) != 0))
    scores = quality.scored(docs.select("doc_id", "text"), network)
    return scores.select(
        "doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op7_language")
def predict_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    models = language.fit(docs.filter(crc_bucket("doc_id", 3) != 1).select("text", "lang"))
    found = language.identified(docs.select("doc_id", "text"), models)
    return found.select(
        "doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_entropy").alias("entropy"), F.col("lang_rejected").alias("rejected"),
    )


@query("op1_near_vectors")
def link_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = embedding_dedup.near_vectors(table(spark, folder, "embeddings"), threshold=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


@query("op2_jaccard_join")
def join_similar_texts(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, folder, "documents"))


@query("op5_repeats")
def remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents")).drop("kept")


@query("op11_bpe_round_trip")
def encode_and_decode(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    both = bpe.decoded(bpe.encoded(table(spark, folder, "documents").select("doc_id", "text"), ranks), ranks)
    return both.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op12_merkle_manifest", merkle.ORACLE)
def verify_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # A tampered row differs in its text only: capital ASCII letters become small.
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_of(docs, text=merkle.small_letters(F.col("text"))))
    proofs = merkle.merkle_manifest(docs, tampered)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op13_divergence_audit", divergence.ORACLE)
def audit_sources(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, folder, "documents"))
