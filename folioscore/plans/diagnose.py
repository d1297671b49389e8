"""Diagnostics of a validation and a test run: atlas, calibration, policy and queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from folioscore.operators import diagnostics as D
from folioscore.operators.rules import require_empty


@dataclass(frozen=True)
class Diagnosis:
    failures: DataFrame
    categories: DataFrame
    queue: DataFrame
    queue_totals: DataFrame
    validation: DataFrame
    test: DataFrame
    policy: DataFrame
    holdout: DataFrame
    blockers: DataFrame


def diagnose(
    validation: DataFrame,
    test: DataFrame,
    manifest_sha256: str,
    min_samples: int = 30,
    min_coverage: float = 0.5,
    max_selective_cer: float = 0.1,
    high_confidence: float = 0.9,
) -> Diagnosis:
    """Both sides carry `split` and the flags; the policy is searched on validation only."""
    require_empty(D.isolation_overlap(validation, test), "validation and test share samples")
    failures = D.failure_records(validation.unionByName(test), high_confidence)
    source = D.queue_source(validation, failures)
    on_validation = D.calibration_diagnostic(validation)
    policy = D.select_policy(validation, min_coverage, max_selective_cer)
    return Diagnosis(
        failures=failures,
        categories=D.category_totals(failures),
        queue=D.blind_queue(source, F.lit(manifest_sha256)),
        queue_totals=D.queue_totals(source),
        validation=on_validation,
        test=D.calibration_diagnostic(test),
        policy=policy,
        holdout=D.apply_policy(test, policy),
        blockers=D.calibration_blockers(on_validation, policy, min_samples),
    )
