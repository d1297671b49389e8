import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioscore import vocab
from folioscore.functions.text import utc_timestamp
from folioscore.operators import annotation, governance as G, inference as I, rules
from folioscore.queries import governed
from folioscore.queries.inputs import Inputs



@pytest.fixture
def contract(spark, small):
    """A document without a defect."""
    rows = governed._contracts(Inputs(spark, small)).filter("pilot_id = 'pilot-customer-9'")
    return json.loads(rows.head()["document"])


def errors(spark, document):
    df = spark.createDataFrame([("pilot-customer-9", json.dumps(document))], "pilot_id string, document string")
    return G.check_contracts(df).head()["errors"]


@pytest.mark.parametrize(
    ("path", "value"),
    [
        ("jurisdiction", "EU"), ("pilot_id", "class-3a"), ("approval.consent.authority", "teacher"),
        ("approval.consent.training_allowed", True), ("approval.consent.verified_at", "2999-01-01T00:00:00Z"),
        ("privacy.image_metadata_removed", False), ("privacy.image_metadata_removed", "true"),
        ("storage.encryption_at_rest", None), ("storage.deletion_on_withdrawal_days", 0),
        ("annotation.independent_annotators_per_sample", 1), ("gold.minimum_distinct_writers", 2),
        ("gold.split_seed", -1), ("gold.gold_ready", True), ("gold.evaluation_set_version", "v0"),
    ],
)
def test_each_contract_rule(spark, contract, path, value):
    assert errors(spark, contract) == []
    *parents, leaf = path.split(".")
    node = contract
    for p in parents:
        node = node[p]
    node[leaf] = value
    assert path in errors(spark, contract)


def test_broken_contract_text_breaks_every_rule(spark):
    df = spark.createDataFrame([("p", "{oops")], "pilot_id string, document string")
    assert len(G.check_contracts(df).head()["errors"]) == len(G.contract_rules())


def test_preflight(spark):
    rows = [("a", True, True, True), ("b", True, False, True), ("c", True, True, False), ("d", False, True, False)]
    df = spark.createDataFrame(
        rows, "pilot_id string, frozen_evaluation boolean, sealed_local_model boolean, inference_authorization boolean"
    )
    got = {r["pilot_id"]: (r["ready"], r["blockers"]) for r in G.preflight(df).collect()}
    assert got["a"] == (True, [])
    assert got["b"] == (False, ["inference_authorization_not_evaluable", "sealed_local_model_gate_failed"])
    assert got["c"] == (False, ["inference_authorization_gate_failed"])
    assert got["d"] == (False, ["frozen_evaluation_gate_failed", "inference_authorization_not_evaluable"])


def test_comparable_runs(spark):
    first = spark.createDataFrame([("m1", 3)], "model string, beams int")
    assert G.comparable_runs(first, first, ["model", "beams"]).isEmpty()
    other = spark.createDataFrame([("m1", 4)], "model string, beams int")
    assert [tuple(r) for r in G.comparable_runs(first, other, ["model", "beams"]).collect()] == [("beams", "3", "4")]


def test_review_audit(spark):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    labels = spark.createDataFrame([(f"{i}.png", f"text {i}") for i in range(3)], "filename string, text string")
    who = lambda c: "annotator-" + c * 12
    rows = [
        (f"{i}.png", who("a"), who("b"), sha(f"text {i}"), sha(f"text {i}"), sha(f"text {i}"), "agreed", None, None, "true", 30.0, 35.0, 0.0)
        for i in range(2)
    ]
    rows.append(("2.png", who("a"), who("b"), sha("other"), sha("text 2"), sha("text 2"), "adjudicated", who("c"),
                 "uncertain_character", "true", 30.0, 35.0, 20.0))
    from folioscore import schemas

    reviews = spark.createDataFrame(rows, schemas.REVIEWS)
    assert annotation.check_reviews(labels, reviews).filter(F.size("errors") > 0).isEmpty()
    assert annotation.unreviewed_or_unknown(labels, reviews).isEmpty()
    quality = annotation.review_quality(reviews).head()
    assert quality["total_review_hours"] == pytest.approx(215 / 3600)
    bad = reviews.withColumn("adjudicator_id", F.when(F.col("status") == "adjudicated", F.lit(who("a"))))
    assert annotation.check_reviews(labels, bad).filter("filename = '2.png'").head()["errors"] == ["adjudicator_independent"]
    assert annotation.unreviewed_or_unknown(labels, reviews.limit(2)).count() == 1


def model(short=False):
    """A model class that travels to the workers by value."""

    class Echo:
        def predict_batch(self, inputs):
            out = [I.Prediction(str(v), 0.5, 1.0, True, False, "m") for v in inputs]
            return out[1:] if short else out

    return Echo


def manifest(spark, n):
    rows = [(f"s{i}", "a" * 64, f"ref {i}", ["x"], "test") for i in range(n)]
    return spark.createDataFrame(
        rows, "sample_id string, source_sha256 string, reference string, slices array<string>, split string"
    )


def test_prediction_resume_and_identity(spark):
    rows = manifest(spark, 20)
    inputs = rows.withColumn("payload", F.col("reference"))
    done = I.prediction_rows(I.predict(inputs.limit(7), model(), "payload", batch_size=3))
    left = I.resume(rows, done)
    assert left.count() == 13
    assert I.partial_mismatches(done, rows).isEmpty()
    with pytest.raises(rules.InvalidRows):
        I.resume(rows.withColumn("reference", F.lit("changed")), done).count()
    with pytest.raises(Exception, match="different number"):
        I.predict(inputs, model(short=True), "payload").count()
    assert I.reference_free_rows(done).columns == ["sample_id", "source_sha256", "prediction", "confidence", "latency_ms"]


def test_predictions_keep_repeated_rows_and_share_the_time_of_a_batch(spark):
    class Silent:
        def predict_batch(self, inputs):
            return [I.Prediction(v, 0.5, None, True, False, "m") for v in inputs]

    rows = manifest(spark, 5)
    twice = rows.unionByName(rows).withColumn("payload", F.col("reference")).coalesce(1)
    done = I.predict(twice, lambda: Silent(), "payload", batch_size=4)
    assert done.columns[:5] == rows.columns
    got = done.collect()
    assert len(got) == 10 and all(r["latency_ms"] > 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["batch"], set()).add(r["latency_ms"])
    assert sorted(len(v) for v in by.values()) == [1, 1, 1]


@pytest.mark.parametrize("ending", ["", "\n", " "])
def test_rules_match_whole_values(spark, ending):
    row = spark.createDataFrame([("a" * 64 + ending, "writer-" + "0" * 16 + ending, "2024-05-01T10:00:00Z" + ending)], "h string, w string, t string")
    found = row.select(
        rules.is_sha256(F.col("h")).alias("h"), F.col("w").rlike(vocab.WRITER_ID).alias("w"), utc_timestamp(F.col("t")).isNotNull().alias("t")
    ).head()
    assert tuple(found) == (ending == "",) * 3


def test_times_need_a_zone(spark):
    row = spark.createDataFrame([("2024-05-01",)], "t string").select(utc_timestamp(F.col("t")).alias("t")).head()
    assert row["t"] is None


def test_gold_problems(spark):
    gold = manifest(spark, 3)
    rows = [("s0", "a" * 64), ("s0", "a" * 64), ("s1", "b" * 64), ("zz", "a" * 64)]
    predictions = spark.createDataFrame(rows, "sample_id string, source_sha256 string")
    got = {tuple(r) for r in I.gold_problems(predictions, gold).collect()}
    assert got == {("s0", "duplicate"), ("s1", "hash_mismatch"), ("zz", "unknown"), ("s2", "missing")}
