"""Published predictions must give the published numbers."""

import json
from pathlib import Path

import pytest

from folioscore import schemas
from folioscore.operators import metrics
from folioscore.operators.fingerprints import evaluation_set_sha256

GOLDEN = json.loads((Path(__file__).parent / "data" / "golden_predictions.json").read_text())

# Published values.
EXPECTED = {
    "adult": {
        "num_samples": 5, "cer": 0.058394160583941604, "wer": 0.32142857142857145,
        "normalized_edit_distance": 0.06540082863612276, "mean_confidence": 0.9086351275444031,
        "calibration_error": 0.7086351275444032, "false_confidence_rate": 0.5, "abstention_rate": 0.0,
        "p50_latency_ms": 1329.9255, "p95_latency_ms": 1763.3348, "samples_per_minute": 44.7434,
        "sha256": "3fc02a64ebdd9b1e2bb903f29d992104f2a55f200f5032f08a336cf9f3b8ff6d",
    },
    "synthetic": {
        "num_samples": 6, "cer": 0.05555555555555555, "wer": 0.5,
        "normalized_edit_distance": 0.06127498232761391, "mean_confidence": 0.8627596199512482,
        "calibration_error": 0.5294262866179149, "false_confidence_rate": 0.6666666666666666,
        "abstention_rate": 0.0, "p50_latency_ms": 1208.2162, "p95_latency_ms": 1347.1620,
        "samples_per_minute": 49.5621,
        "sha256": "9b062c7b4e6bc2a496f826b8b136e6816f0c9e3c85ec659f5118937a8342a099",
    },
}


def records(spark, name):
    rows = [{**r, "cost_per_page_usd": None} for r in GOLDEN[name]]
    order = [f.strip().split()[0] for f in schemas.EVALUATION_RECORD.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schemas.EVALUATION_RECORD)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_published_metrics(spark, name):
    want = EXPECTED[name]
    df = records(spark, name)
    overall = metrics.slice_metrics(df).filter(f"slice = '{metrics.ALL}'").head().asDict()
    single = metrics.full_metrics(df).head().asDict()
    for key in single:
        assert overall[key] == pytest.approx(single[key], abs=1e-12)
        if key in want:
            assert single[key] == pytest.approx(want[key], abs=1e-9)
    latency = metrics.latency_summary(df).head().asDict()
    for key, value in latency.items():
        assert value == pytest.approx(want[key], abs=1e-4)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_published_set_digest(spark, name):
    assert evaluation_set_sha256(records(spark, name)).head()["sha256"] == EXPECTED[name]["sha256"]


def test_single_metrics_agree_with_the_bundle(spark):
    df = records(spark, "adult")
    want = EXPECTED["adult"]
    assert metrics.character_error_rate(df).head()[0] == pytest.approx(want["cer"], abs=1e-12)
    assert metrics.word_error_rate(df).head()[0] == pytest.approx(want["wer"], abs=1e-12)
    assert metrics.calibration_error(df).head()[0] == pytest.approx(want["calibration_error"], abs=1e-9)
    assert metrics.false_confidence_rate(df).head()[0] == want["false_confidence_rate"]


def test_empty_input_counts_as_wrong(spark):
    df = records(spark, "adult").limit(0)
    assert metrics.character_error_rate(df).head()[0] == 1.0
    assert metrics.word_error_rate(df).head()[0] == 1.0
    assert metrics.normalized_edit_distance(df).head()[0] == 1.0
    assert metrics.calibration_error(df).head()[0] == 0.0
