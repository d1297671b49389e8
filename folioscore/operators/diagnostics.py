"""Failure atlas, calibration diagnostics, threshold policies and the blind labelling queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.functions.digests import task_id
from folioscore.functions.edits import ratio, row_cer, with_char_features
from folioscore.operators.metrics import confidence_bin

# Fixed names of the failure categories.
SEVERE, MODERATE, MINOR = (
    "character_error_ge_0_25", "character_error_0_10_to_0_25", "character_error_below_0_10",
)
MARKER, CONFIDENT_ERROR, UNCERTAIN, UNREADABLE = (
    "publisher_correction_marker", "high_confidence_exact_error",
    "model_marked_uncertain", "model_marked_unreadable",
)
STEPS = 20
QUEUE_SALT = "double-blind-v1"


def severity(cer: Column) -> Column:
    return F.when(cer >= 0.25, SEVERE).when(cer >= 0.1, MODERATE).otherwise(MINOR)


def with_failure_categories(
    records: DataFrame, high_confidence: float = 0.9, marker_slice: str = "publisher_hash_marker"
) -> DataFrame:
    """Records with `exact`, `line_cer` and the sorted failure categories that a failure would have."""
    rows = with_char_features(records)
    rows = rows.withColumn("line_cer", row_cer(F.col("char_edits"), F.col("ref_chars")))
    categories = F.array(
        severity(F.col("line_cer")),
        F.when(F.array_contains("slices", marker_slice), MARKER),
        F.when(F.col("confidence") >= high_confidence, CONFIDENT_ERROR),
        F.when(F.col("is_uncertain"), UNCERTAIN),
        F.when(F.col("is_unreadable"), UNREADABLE),
    )
    return rows.withColumn("categories", F.array_sort(F.array_compact(categories)))


def failure_records(
    records: DataFrame, high_confidence: float = 0.9, marker_slice: str = "publisher_hash_marker"
) -> DataFrame:
    """Rows that are not an exact match, each with its sorted failure categories."""
    rows = with_failure_categories(records, high_confidence, marker_slice).filter(~F.col("exact"))
    return rows.select(
        "sample_id", "source_sha256", "split", "reference", "prediction", "confidence",
        "line_cer", "categories", "slices", "is_uncertain", "is_unreadable",
    )


def with_flags(records: DataFrame, flags: DataFrame) -> DataFrame:
    """Records joined with their uncertainty flags by sample id."""
    return records.join(flags, "sample_id")


def unmatched_flags(records: DataFrame, flags: DataFrame) -> DataFrame:
    """Ids on one side only; the two envelopes must cover the same samples."""
    left = records.select("sample_id").join(flags, "sample_id", "left_anti")
    right = flags.select("sample_id").join(records, "sample_id", "left_anti")
    return left.withColumn("problem", F.lit("no_flags")).unionByName(
        right.withColumn("problem", F.lit("no_record"))
    )


def category_totals(failures: DataFrame) -> DataFrame:
    """Counts, per-split counts and means per category of multi-label failures."""
    # The outer form keeps Spark from inferring a filter that repeats the edit distances.
    per_set = failures.select("split", "confidence", "line_cer", F.explode_outer("categories").alias("category"))
    return per_set.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("split") == "validation").alias("validation_count"),
        F.count_if(F.col("split") == "test").alias("test_count"),
        F.avg("line_cer").alias("mean_cer"),
        F.avg("confidence").alias("mean_confidence"),
    )


def atlas_summary(instances: DataFrame) -> DataFrame:
    return instances.groupBy("category").agg(
        F.count("*").alias("n"),
        F.avg("cer").alias("avg_cer"),
        F.avg("confidence").alias("avg_confidence"),
        F.max("cer").alias("max_cer"),
    )


def compare_versions(instances: DataFrame, first: str, second: str) -> DataFrame:
    """Average CER per category of two model versions.

    A missing average leaves `improved` null, and so does an average of exactly 0.
    """
    def average(version: str) -> Column:
        return F.avg(F.when(F.col("model_version") == version, F.col("cer")))

    both = (
        instances.filter(F.col("model_version").isin(first, second))
        .groupBy("category")
        .agg(average(first).alias("first_avg_cer"), average(second).alias("second_avg_cer"))
    )
    comparable = (F.col("first_avg_cer") != 0) & (F.col("second_avg_cer") != 0)
    return both.withColumn(
        "improved", F.when(comparable, F.col("second_avg_cer") < F.col("first_avg_cer"))
    )


# --- calibration diagnostics ---------------------------------------------------------------


def calibration_diagnostic(records: DataFrame) -> DataFrame:
    """All calibration numbers of one record set as one row, from one pass over it."""
    rows = with_char_features(records).withColumns(
        {
            "_bin": confidence_bin(F.col("confidence")),
            "_cer": row_cer(F.col("char_edits"), F.col("ref_chars")),
            "_ok": F.col("exact").cast("double"),
        }
    )
    accuracy = F.greatest(F.lit(0.0), 1 - F.col("_cer"))
    per_bin = rows.groupBy("_bin").agg(
        F.count("*").alias("n"),
        F.count("_cer").alias("n_cer"),
        F.sum("_ok").alias("ok"),
        F.sum("confidence").alias("conf"),
        F.sum(F.pow(F.col("confidence") - F.col("_ok"), F.lit(2))).alias("brier"),
        F.sum("_cer").alias("cer"),
        F.sum(accuracy).alias("acc"),
        F.sum(F.abs(F.col("confidence") - accuracy)).alias("mae"),
    )
    n, n_cer = F.sum("n"), F.sum("n_cer")
    matches = F.sum("ok").cast("long")
    return per_bin.agg(
        n.alias("num_samples"),
        matches.alias("exact_matches"),
        (n - matches).alias("exact_errors"),
        ratio(F.sum("ok"), n).alias("exact_match_rate"),
        ratio(F.sum("conf"), n).alias("mean_confidence"),
        ratio(F.sum(F.abs(F.col("ok") - F.col("conf"))), n).alias("exact_match_ece"),
        ratio(F.sum("brier"), n).alias("exact_match_brier_score"),
        ratio(F.sum("cer"), n_cer).alias("mean_line_cer"),
        ratio(F.sum("acc"), n_cer).alias("mean_character_accuracy"),
        ratio(F.sum("mae"), n_cer).alias("confidence_character_accuracy_mae"),
        ((matches > 0) & (matches < n)).alias("target_has_both_classes"),
    )


def _threshold_step(confidence: Column) -> Column:
    """The highest step whose threshold the confidence reaches; compared, never multiplied."""
    reached = F.lit(0)
    for k in range(1, STEPS + 1):
        reached = reached + (confidence >= F.lit(k / STEPS)).cast("int")
    return reached


def _sweep(records: DataFrame) -> DataFrame:
    """The sweep with the number of all records, in one pass.

    Rows are summed per step first, those without a confidence under step -1; each of the at most
    22 sums then counts for all lower thresholds, instead of pairing every row with every threshold.
    """
    reached = F.when(F.col("confidence").isNull(), -1).otherwise(_threshold_step(F.col("confidence")))
    per_step = with_char_features(records).groupBy(reached.alias("_reached")).agg(
        F.count("*").alias("n"),
        F.sum("char_edits").alias("edits"),
        F.sum("ref_chars").alias("chars"),
        F.count_if(~F.col("exact")).alias("wrong"),
    )
    counted = per_step.withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0)))).filter("_reached >= 0")
    steps = counted.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_reached"))))
    return steps.groupBy("step", "total").agg(
        F.sum("n").alias("accepted_samples"),
        ratio(F.sum("edits"), F.sum("chars")).alias("selective_cer"),
        ratio(F.sum("wrong"), F.sum("n")).alias("exact_error_rate"),
    ).withColumns(
        {
            "threshold": F.col("step") / F.lit(float(STEPS)),
            "coverage": ratio(F.col("accepted_samples"), F.col("total")),
        }
    )


def threshold_sweep(records: DataFrame) -> DataFrame:
    """Accepted samples, coverage and risk at the thresholds 0, 0.05, ..., 1."""
    return _sweep(records).drop("total")


def select_policy(
    records: DataFrame, min_coverage: float = 0.5, max_selective_cer: float = 0.1
) -> DataFrame:
    """The eligible threshold with the best coverage, then CER, then threshold; always one row."""
    sweep = _sweep(records).withColumn("minimum_accepted_samples", F.ceil(F.col("total") * F.lit(min_coverage)))
    eligible = (F.col("accepted_samples") >= F.col("minimum_accepted_samples")) & (
        F.col("selective_cer") <= max_selective_cer
    )
    chosen = F.struct("threshold", "accepted_samples", "coverage", "selective_cer", "exact_error_rate")
    rank = F.struct(-F.col("coverage"), F.col("selective_cer"), F.col("threshold"))
    best = sweep.filter(eligible).agg(F.min_by(chosen, rank).alias("best"))
    return best.select(
        F.when(F.col("best").isNull(), "no_eligible_threshold")
        .otherwise("diagnostic_candidate_found")
        .alias("status"),
        "best.*",
        F.lit(min_coverage).alias("minimum_coverage"),
        F.lit(max_selective_cer).alias("maximum_selective_cer"),
    )


def apply_policy(records: DataFrame, policy: DataFrame) -> DataFrame:
    """The chosen threshold on a holdout: not applied, applied to nothing, or applied."""
    threshold = policy.select("threshold").scalar()
    rows = with_char_features(records).withColumn("_t", threshold)
    taken = F.col("confidence") >= F.col("_t")
    some = F.count_if(taken) > 0
    out = rows.agg(
        F.max("_t").alias("threshold"),
        F.count_if(taken).alias("accepted_samples"),
        ratio(F.count_if(taken), F.count("*")).alias("coverage"),
        F.when(
            some,
            ratio(
                F.sum(F.when(taken, F.col("char_edits"))), F.sum(F.when(taken, F.col("ref_chars")))
            ),
        ).alias("selective_cer"),
        F.when(some, ratio(F.count_if(taken & ~F.col("exact")), F.count_if(taken))).alias(
            "exact_error_rate"
        ),
    )
    applied = F.col("threshold").isNotNull()
    return out.select(
        F.when(applied, "applied").otherwise("not_applied").alias("status"),
        "threshold",
        *[F.when(applied, F.col(c)).alias(c) for c in out.columns if c != "threshold"],
    )


def calibration_blockers(diagnostic: DataFrame, policy: DataFrame, min_samples: int = 30) -> DataFrame:
    """Reasons that forbid fitting a calibration, as one array."""
    status = policy.select("status").scalar()
    return diagnostic.select(
        F.array_compact(
            F.array(
                F.when(
                    F.col("num_samples") < min_samples,
                    "validation_sample_count_below_calibration_minimum",
                ),
                F.when(~F.col("target_has_both_classes"), "exact_match_target_has_only_one_class"),
                F.when(
                    status != "diagnostic_candidate_found",
                    "no_validation_threshold_met_selective_risk_policy",
                ),
            )
        ).alias("blockers")
    )


def merged_reasons(*arrays: Column) -> Column:
    """Distinct reasons in sorted order."""
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


# --- blind labelling queue --------------------------------------------------------------------


def labelling_priority() -> Column:
    has = lambda name: F.array_contains("categories", name)
    return (
        F.least(F.col("line_cer"), F.lit(1.0)) * 0.4
        + F.col("confidence") * 0.25
        + F.when(has(MARKER), 0.15).otherwise(0.0)
        + F.when(has(UNCERTAIN), 0.1).otherwise(0.0)
        + F.when(has(CONFIDENT_ERROR), 0.1).otherwise(0.0)
    )


def queue_source(validation: DataFrame, failures: DataFrame) -> DataFrame:
    """Every validation record with its priority; records without a failure get -1."""
    scored = failures.filter(F.col("split") == "validation").select(
        "sample_id", labelling_priority().alias("priority")
    )
    joined = validation.select("sample_id", "source_sha256").join(scored, "sample_id", "left")
    return joined.withColumn("priority", F.coalesce("priority", F.lit(-1.0)))


def queue_source_of(records: DataFrame, high_confidence: float = 0.9) -> DataFrame:
    """`queue_source` of records whose failures are their own: no join, one pass."""
    rows = with_failure_categories(records.filter(F.col("split") == "validation"), high_confidence)
    return rows.select(
        "sample_id", "source_sha256", F.when(F.col("exact"), F.lit(-1.0)).otherwise(labelling_priority()).alias("priority")
    )


def blind_queue(
    source: DataFrame,
    manifest_sha256: Column,
    guideline_version: str = "annotation-v2",
    salt: str = QUEUE_SALT,
) -> DataFrame:
    """Tasks in priority order; priority, prediction and reference are not in the output."""
    protocol = F.struct(
        F.lit(guideline_version).alias("guideline_version"),
        F.lit(2).alias("required_blind_passes"),
        F.lit(False).alias("model_prediction_visible"),
        F.lit(False).alias("publisher_reference_visible"),
        F.lit(False).alias("failure_category_visible"),
        F.lit(True).alias("independent_adjudication_on_disagreement"),
    )
    return source.orderBy(F.col("priority").desc(), "sample_id").select(
        task_id(manifest_sha256, F.col("source_sha256"), F.col("sample_id"), salt).alias("task_id"),
        "sample_id",
        "source_sha256",
        manifest_sha256.alias("dataset_manifest_sha256"),
        F.lit("awaiting_blind_annotation").alias("status"),
        protocol.alias("review_protocol"),
    )


def queue_totals(source: DataFrame) -> DataFrame:
    targeted = F.col("priority") >= 0
    return source.agg(
        F.count("*").alias("validation_tasks"),
        F.count_if(targeted).alias("failure_targeted_tasks"),
        F.count_if(~targeted).alias("coverage_control_tasks"),
        (F.count("*") * 2).alias("required_blind_annotation_assignments"),
    )


def isolation_overlap(validation: DataFrame, test: DataFrame) -> DataFrame:
    """Sample ids or source hashes shared by the two splits; must be empty."""
    ids = validation.select("sample_id").intersect(test.select("sample_id"))
    hashes = validation.select("source_sha256").intersect(test.select("source_sha256"))
    return ids.select(F.lit("sample_id").alias("field"), F.col("sample_id").alias("value")).unionByName(
        hashes.select(F.lit("source_sha256").alias("field"), F.col("source_sha256").alias("value"))
    )
