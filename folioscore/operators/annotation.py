"""Double-annotation audit: labels against their two-pass reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscore import vocab
from folioscore.functions.edits import ratio
from folioscore.operators.rules import Rule, is_sha256, validate


def review_rules() -> list[Rule]:
    """Rules of one review row; expects `expected_final_sha256` from the label."""
    c = F.col
    agreed, adjudicated = c("status") == "agreed", c("status") == "adjudicated"
    adjudicator = F.coalesce(c("adjudicator_id"), F.lit(""))
    reason = F.coalesce(c("adjudication_reason"), F.lit(""))
    seconds = c("adjudication_seconds")
    return [
        Rule("annotator_1_id", c("annotator_1_id").rlike(vocab.ANNOTATOR_ID)),
        Rule("annotator_2_id", c("annotator_2_id").rlike(vocab.ANNOTATOR_ID)),
        Rule("annotators_independent", c("annotator_1_id") != c("annotator_2_id")),
        *[
            Rule(n, is_sha256(c(n), fold_case=False))
            for n in ("pass_1_sha256", "pass_2_sha256", "final_sha256")
        ],
        Rule("final_transcript", c("final_sha256") == c("expected_final_sha256")),
        Rule("crop_reviewed", c("crop_reviewed") == "true"),
        Rule("pass_1_seconds", c("pass_1_seconds") > 0),
        Rule("pass_2_seconds", c("pass_2_seconds") > 0),
        Rule("adjudication_seconds", seconds >= 0),
        Rule("status", agreed | adjudicated),
        Rule(
            "agreed_hashes",
            ~agreed | ((c("pass_1_sha256") == c("pass_2_sha256")) & (c("pass_1_sha256") == c("final_sha256"))),
        ),
        Rule("agreed_without_adjudication", ~agreed | ((adjudicator == "") & (reason == "") & (seconds == 0))),
        Rule("adjudicated_passes_differ", ~adjudicated | (c("pass_1_sha256") != c("pass_2_sha256"))),
        Rule("adjudicator_id", ~adjudicated | adjudicator.rlike(vocab.ANNOTATOR_ID)),
        Rule(
            "adjudicator_independent",
            ~adjudicated | ((adjudicator != c("annotator_1_id")) & (adjudicator != c("annotator_2_id"))),
        ),
        Rule(
            "adjudication_evidence",
            ~adjudicated | (reason.isin(*vocab.ADJUDICATION_REASONS) & (seconds > 0)),
        ),
    ]


def unreviewed_or_unknown(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """File names on one side only, or whose final hash is not the hash of the label text."""
    left = labels.select("filename", F.sha2("text", 256).alias("expected_final_sha256"))
    joined = left.join(reviews.select("filename", "final_sha256"), "filename", "full_outer")
    problem = (
        F.when(F.col("final_sha256").isNull(), "no_review")
        .when(F.col("expected_final_sha256").isNull(), "no_label")
        .when(F.col("final_sha256") != F.col("expected_final_sha256"), "final_hash_mismatch")
    )
    return joined.select("filename", problem.alias("problem")).filter(F.col("problem").isNotNull())


def check_reviews(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews with their broken rules."""
    expected = labels.select("filename", F.sha2("text", 256).alias("expected_final_sha256"))
    return validate(reviews.join(expected, "filename", "left"), review_rules())


def review_quality(reviews: DataFrame) -> DataFrame:
    """Agreement and adjudication shares and the hours they took."""
    seconds = F.col("pass_1_seconds") + F.col("pass_2_seconds") + F.col("adjudication_seconds")
    agreed, adjudicated = F.col("status") == "agreed", F.col("status") == "adjudicated"
    return reviews.agg(
        F.count("*").alias("samples"),
        F.count_if(agreed).alias("agreed_samples"),
        F.count_if(adjudicated).alias("adjudicated_samples"),
        ratio(F.count_if(agreed), F.count("*")).alias("agreement_rate"),
        ratio(F.count_if(adjudicated), F.count("*")).alias("adjudication_rate"),
        ratio(F.sum(seconds), F.lit(3600.0)).alias("total_review_hours"),
        ratio(F.count("*") * 3600, F.sum(seconds)).alias("samples_per_review_hour"),
    )
