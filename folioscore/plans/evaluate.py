"""From scored records to an evaluation document and a release decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscore.functions.edits import ratio
from folioscore.operators.fingerprints import evaluation_line, evaluation_set_fingerprint, row_fingerprint_sums
from folioscore.operators.gate import gate_checks, slice_checks
from folioscore.operators.metrics import ALL, exact_percentiles, latency_summary, mean_cost, slice_metrics
from folioscore.operators.onerow import beside
from folioscore.operators.rules import broken_rules, evaluation_record_rules


def operations_row(records: DataFrame) -> DataFrame:
    """Latency, throughput and cost of a record set as one row."""
    return beside(latency_summary(records), mean_cost(records))


def identity_row(records: DataFrame, test_set: str) -> DataFrame:
    """Name and order-free digest of the evaluation set."""
    return evaluation_set_fingerprint(records).select(
        F.lit(test_set).alias("test_set"), "fingerprint", F.col("n_rows").alias("num_records")
    )


def evaluation_document(records: DataFrame, model_version: str, test_set: str) -> DataFrame:
    """One document row: identity, overall metrics, operations, and a map of slice metrics.

    The map has one entry per slice name, a controlled vocabulary.
    """
    per_slice = slice_metrics(records)
    names = [c for c in per_slice.columns if c != "slice"]
    bundle = F.struct(*names)
    tags = F.col("slice") != ALL
    packed = per_slice.agg(
        F.max(F.when(~tags, bundle)).alias("metrics"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(tags, F.struct("slice", bundle.alias("metrics")))))
        ).alias("slices"),
    )
    operations = operations_row(records)
    return beside(packed, operations, identity_row(records, test_set)).select(
        F.lit(1).alias("schema_version"),
        F.lit("evaluated").alias("status"),
        F.lit(model_version).alias("model_version"),
        "test_set",
        F.col("fingerprint").alias("evaluation_set_fingerprint"),
        "num_records",
        "metrics",
        *operations.columns,
        "slices",
    )


def _release_sums() -> dict[str, Column]:
    """Identity, cost and validity of records as sums, next to those of the metrics."""
    lanes = {f"lane_{i}": c for i, c in enumerate(row_fingerprint_sums(F.sha2(evaluation_line(), 256)))}
    valid = F.size(broken_rules(evaluation_record_rules())) == 0
    return {
        **lanes, "n_valid": F.count_if(valid), "cost": F.sum("cost_per_page_usd"), "n_cost": F.count("cost_per_page_usd"),
    }


def release_metrics(records: DataFrame) -> DataFrame:
    """Slice metrics with fingerprint, cost and valid share of each slice: one pass over the records.

    The fingerprint over all rows is that of `evaluation_set_fingerprint`.
    """
    sums = _release_sums()
    rows = slice_metrics(records, more=sums)
    lanes = [F.col(n) for n in sums if n.startswith("lane_")]
    return rows.withColumns({
        "fingerprint": F.sha2(F.concat_ws(":", "num_samples", *lanes), 256), "cost_per_page_usd": ratio(F.col("cost"), F.col("n_cost")),
        "valid_output_rate": ratio(F.col("n_valid"), F.col("num_samples")),
    }).drop(*sums)


def decide_release(
    candidate: DataFrame, baseline: DataFrame, test_set: str, valid_rate: DataFrame | None = None,
    thresholds: dict[str, float] | None = None, baseline_test_set: str | None = None,
) -> DataFrame:
    """The seven gate checks of two record sets.

    Each side is aggregated once; only the exact percentile of the candidate's latencies is a pass
    of its own. `valid_rate`, one row, replaces the share of valid records of the candidate.
    """
    left, right = release_metrics(candidate), release_metrics(baseline)
    whole = F.col("slice") == ALL
    sides = left.withColumnRenamed("cer", "candidate_cer").join(
        right.select("slice", F.col("cer").alias("baseline_cer"), F.col("fingerprint").alias("expected")), "slice", "full_outer"
    ).withColumn("regression", F.col("candidate_cer") - F.col("baseline_cer"))
    overall = lambda name: F.max(F.when(whole, F.col(name))).alias(name)
    same_name = F.lit(test_set == (baseline_test_set or test_set))
    row = sides.agg(
        *slice_checks(), overall("cost_per_page_usd"), *([] if valid_rate is not None else [overall("valid_output_rate")]),
        F.max(F.when(whole, F.col("fingerprint").eqNullSafe(F.col("expected")) & same_name)).alias("sets_match"),
    )
    percentile = exact_percentiles(candidate, "latency_ms", {"p95_latency_ms": 0.95})
    return gate_checks(beside(row, percentile, *([valid_rate] if valid_rate is not None else [])), thresholds)
