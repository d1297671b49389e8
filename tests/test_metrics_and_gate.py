import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscore import schemas
from folioscore.operators import diagnostics as D, gate, metrics, rules
from folioscore.plans import evaluate

SHA = "a" * 64


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.EVALUATION_RECORD)


BASE = [
    ("1", SHA, "hello world", "helo world", 0.85, ["clean", "print"], 180.0, 0.004),
    ("2", SHA, "the quick fox", "the quik fox", 0.82, ["clean", "cursive"], 210.0, 0.004),
    ("3", SHA, "student writing", "student writ", 0.65, ["cursive", "faint_pencil"], 260.0, 0.004),
]
BETTER = [
    ("1", SHA, "hello world", "hello world", 0.98, ["clean", "print"], 100.0, 0.002),
    ("2", SHA, "the quick fox", "the quick fox", 0.95, ["clean", "cursive"], 120.0, 0.002),
    ("3", SHA, "student writing", "student writin", 0.70, ["cursive", "faint_pencil"], 180.0, 0.002),
]


def decide(spark, candidate, baseline):
    rate = metrics.valid_output_rate(rules.validate(candidate, rules.evaluation_record_rules()))
    checks = evaluate.decide_release(candidate, baseline, "set", rate)
    return {r["name"]: r for r in checks.collect()}


def test_gate_passes_an_improvement(spark):
    checks = decide(spark, frame(spark, BETTER), frame(spark, BASE))
    assert len(checks) == 7 and all(c["passed"] for c in checks.values())


def test_gate_sees_a_slice_regression_and_another_set(spark):
    worse = [BETTER[0], BETTER[1], (*BETTER[2][:3], "st", *BETTER[2][4:])]
    checks = decide(spark, frame(spark, worse), frame(spark, BASE))
    assert not checks["slice_regression"]["passed"] and checks["evaluation_set_match"]["passed"]
    other = [(*r[:2], r[2] + "!", *r[3:]) for r in BETTER]
    assert not decide(spark, frame(spark, other), frame(spark, BASE))["evaluation_set_match"]["passed"]


def test_gate_fails_without_slices(spark):
    bare = lambda rows: frame(spark, [(*r[:5], [], *r[6:]) for r in rows])
    assert not decide(spark, bare(BETTER), bare(BASE))["slice_regression"]["passed"]
    gone = frame(spark, [(*r[:5], ["clean"], *r[6:]) for r in BETTER])
    assert not decide(spark, gone, frame(spark, BASE))["slice_regression"]["passed"]


def test_confidence_bins(spark):
    values = [0.0, 0.1, 0.3, 0.30000000000000004, 0.30000000000000010, 0.95, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = [r[0] for r in df.select(metrics.confidence_bin(F.col("c"))).collect()]
    edges = np.linspace(0, 1, 11)
    want = [max(0, int(np.searchsorted(edges, v, side="left")) - 1) for v in values]
    assert got == want


def test_percentiles_match_numpy_with_ties_and_negative_values(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([5.0, 5.0, rng.uniform(-50, 4000)])) for g in "ab" for _ in range(501)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in metrics.exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0}, "g").collect()}
    for g in "ab":
        values = [v for k, v in rows if k == g]
        for name, q in (("p50", 50), ("p95", 95), ("p0", 0)):
            assert got[g][name] == pytest.approx(np.percentile(values, q))


def test_policy_matches_a_plain_search(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        ref = "abcdefghij"
        wrong = rng.randint(0, 3)
        rows.append((str(i), SHA, ref, "z" * wrong + ref[wrong:], rng.randint(0, 100) / 100, [], 1.0, 1.0))
    df = frame(spark, rows)
    for coverage, limit in ((0.5, 0.16), (0.2, 0.15), (0.9, 0.01)):
        best = None
        for k in range(21):
            taken = [r for r in rows if r[4] >= k / 20]
            if not taken:
                continue
            cer = sum(sum(a != b for a, b in zip(r[2], r[3])) for r in taken) / (10 * len(taken))
            if len(taken) >= math.ceil(len(rows) * coverage) and cer <= limit:
                key = (-len(taken) / len(rows), cer, k / 20)
                best = min(best, key) if best else key
        got = D.select_policy(df, coverage, limit).head()
        assert (got["threshold"] is None) == (best is None)
        if best:
            assert got["threshold"] == best[2] and got["coverage"] == pytest.approx(-best[0])


def test_sweep_coverage_never_rises(spark):
    df = frame(spark, [(str(i), SHA, "a", "a", i / 40, [], 1.0, 1.0) for i in range(41)])
    rows = sorted(D.threshold_sweep(df).collect(), key=lambda r: r["threshold"])
    assert [r["coverage"] for r in rows] == sorted((r["coverage"] for r in rows), reverse=True)
    assert rows[0]["accepted_samples"] == 41


def test_diagnosis_of_a_small_run_pair(spark):
    """Nine validation rows with one exact match give eight failures, one control, 18 assignments."""
    from folioscore.plans.diagnose import diagnose

    def run(split, n):
        rows = [
            (
                f"{split}-{i}", f"{i}{split}".encode().hex().ljust(64, "0"), "reference text",
                "reference text" if split == "validation" and i == 0 else "reference tex", 0.96 - 0.03 * i,
                ["publisher_hash_marker"] if i % 2 == 0 else ["plain"], split, i == 8, False,
            )
            for i in range(n)
        ]
        return spark.createDataFrame(
            rows,
            "sample_id string, source_sha256 string, reference string, prediction string, confidence double, "
            "slices array<string>, split string, is_uncertain boolean, is_unreadable boolean",
        )

    d = diagnose(run("validation", 9), run("test", 6), SHA)
    assert d.failures.filter("split = 'validation'").count() == 8
    totals = d.queue_totals.head()
    assert (totals[0], totals[1], totals[2], totals[3]) == (9, 8, 1, 18)
    assert "validation_sample_count_below_calibration_minimum" in d.blockers.head()[0]
    assert set(d.queue.columns) & {"prediction", "reference", "priority"} == set()
    with pytest.raises(rules.InvalidRows):
        diagnose(run("validation", 3), run("validation", 3), SHA)


def test_versions_with_a_zero_average_are_not_comparable(spark):
    rows = [("a", "v1", 0.5), ("a", "v2", 0.2), ("b", "v1", 0.0), ("b", "v2", 0.2), ("c", "v1", 0.1)]
    df = spark.createDataFrame(rows, "category string, model_version string, cer double")
    got = {r["category"]: r["improved"] for r in D.compare_versions(df, "v1", "v2").collect()}
    assert got == {"a": True, "b": None, "c": None}


def test_missing_slices(spark):
    left, right = (spark.createDataFrame([(s,) for s in v], "slice string") for v in (["a"], ["a", "b"]))
    assert [r[0] for r in gate.missing_slices(left, right).collect()] == ["b"]
