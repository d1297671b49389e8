"""Release gate: a candidate evaluation against a baseline, as rows of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscore import vocab
from folioscore.operators.metrics import ALL
from folioscore.operators.onerow import beside


def compare_slices(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """CER per slice on both sides; a slice missing on one side keeps a null."""
    left = candidate.withColumnRenamed("cer", "candidate_cer")
    right = baseline.select("slice", F.col("cer").alias("baseline_cer"))
    return left.join(right, "slice", "full_outer").select(
        "slice",
        *[c for c in candidate.columns if c == "false_confidence_rate"],
        "candidate_cer",
        "baseline_cer",
        (F.col("candidate_cer") - F.col("baseline_cer")).alias("regression"),
    )


def missing_slices(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline slices the candidate was not measured on."""
    return baseline.select("slice").subtract(candidate.select("slice"))


def evaluation_sets_match(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Same digest and same test-set name, from two one-row identity tables."""
    right = baseline.select(
        F.col("test_set").alias("expected_test_set"),
        F.col("fingerprint").alias("expected_fingerprint"),
    )
    return beside(candidate.select("test_set", "fingerprint"), right).select(
        "test_set",
        "fingerprint",
        "expected_test_set",
        "expected_fingerprint",
        (
            F.col("test_set").eqNullSafe(F.col("expected_test_set"))
            & F.col("fingerprint").eqNullSafe(F.col("expected_fingerprint"))
        ).alias("passed"),
    )


def release_gate(
    candidate_slices: DataFrame,
    baseline_slices: DataFrame,
    operations: DataFrame,
    sets_match: DataFrame,
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """Seven checks as rows (name, actual, expected, passed).

    `*_slices` come from `slice_metrics` with the overall row; `operations` is one row with
    `p95_latency_ms`, `cost_per_page_usd` and `valid_output_rate`; `sets_match` is one row
    with `passed`. All of them are aggregates of a few rows.
    """
    both = compare_slices(candidate_slices, baseline_slices)
    measured = operations.select("p95_latency_ms", "cost_per_page_usd", "valid_output_rate")
    row = beside(both.agg(*slice_checks()), measured, sets_match.select(F.col("passed").alias("sets_match")))
    return gate_checks(row, thresholds)


def slice_checks() -> list[Column]:
    """What the gate needs of the slices of both sides, as aggregates over `compare_slices`."""
    tags = F.col("slice") != ALL
    return [
        F.max(F.when(~tags, F.col("baseline_cer") - F.col("candidate_cer"))).alias("improvement"),
        F.coalesce(F.max(F.when(tags, F.col("regression"))), F.lit(0.0)).alias("regression"),
        F.count_if(tags & F.col("baseline_cer").isNotNull()).alias("required"),
        F.count_if(tags & F.col("candidate_cer").isNull()).alias("missing"),
        F.max(F.when(~tags, F.col("false_confidence_rate"))).alias("false_confidence_rate"),
    ]


def gate_checks(row: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The seven checks of one row with `slice_checks`, the operations and `sets_match`."""
    limits = {**vocab.RELEASE_GATE, **(thresholds or {})}

    def check(name: str, actual: Column, expected: str, passed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            actual.cast("double").alias("actual"),
            F.lit(expected).alias("expected"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
        )

    def at_least(name: str, column: str, key: str) -> Column:
        c, limit = F.col(column), limits[key]
        return check(name, c, f">= {limit}", c >= limit)

    def at_most(name: str, key: str) -> Column:
        c, limit = F.col(name), limits[key]
        return check(name, c, f"<= {limit}", c <= limit)

    regression_limit = limits["max_slice_regression"]
    checks = [
        check("evaluation_set_match", F.col("sets_match").cast("int"), "== 1", F.col("sets_match")),
        at_least("cer_improvement", "improvement", "min_cer_improvement"),
        check(
            "slice_regression",
            F.col("regression"),
            f"<= {regression_limit}",
            (F.col("required") > 0)
            & (F.col("missing") == 0)
            & (F.col("regression") <= regression_limit),
        ),
        at_most("false_confidence_rate", "max_false_confidence_rate"),
        at_most("p95_latency_ms", "max_p95_latency_ms"),
        at_most("cost_per_page_usd", "max_cost_per_page_usd"),
        at_least("valid_output_rate", "valid_output_rate", "min_valid_output_rate"),
    ]
    return row.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def gate_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.every("passed").alias("passed"))
