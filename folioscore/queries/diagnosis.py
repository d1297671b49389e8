"""Queries: failure atlas, calibration policy, labelling queue, active learning, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscore.operators import annotation, diagnostics as D, inference, review as R
from folioscore.operators.ordering import global_position
from folioscore.queries.inputs import Inputs, mod
from folioscore.queries.registry import query
from folioscore.sources.buckets import store_by_key

ID = "sample_id"
MANIFEST_SHA = "a" * 64


def _failures(t: Inputs) -> DataFrame:
    return D.failure_records(t.pairs)


# --- failures ----------------------------------------------------------------------------


@query(
    "f12_severity", "feat",
    sql="""SELECT sample_id, CASE WHEN line_cer>=0.25 THEN 'character_error_ge_0_25' WHEN line_cer>=0.1 THEN 'character_error_0_10_to_0_25' ELSE 'character_error_below_0_10' END AS severity FROM feat""",
)
def f12(t: Inputs) -> DataFrame:
    from folioscore.functions.edits import row_cer, with_char_features

    cer = row_cer(F.col("char_edits"), F.col("ref_chars"))
    return with_char_features(t.pairs).select(ID, D.severity(cer).alias("severity"))


@query(
    "f13_failure_records", "failures",
    sql="SELECT sample_id, split, prediction, round(line_cer,6) AS line_cer, array_to_string(categories,'|') AS categories FROM failures",
)
def f13(t: Inputs) -> DataFrame:
    return _failures(t).select(ID, "split", "prediction", "line_cer", "categories")


@query("f14_priority", "prioritised", sql="SELECT sample_id, round(priority,6) AS priority FROM prioritised WHERE priority>=0")
def f14(t: Inputs) -> DataFrame:
    failures = _failures(t).filter(F.col("split") == "validation")
    return failures.select(ID, D.labelling_priority().alias("priority"))


@query(
    "a20_atlas_summary", "instances",
    sql="SELECT category, count(*) AS n, round(avg(cer),6) AS avg_cer, round(avg(confidence),6) AS avg_confidence, round(max(cer),6) AS max_cer FROM instances GROUP BY 1",
)
def a20(t: Inputs) -> DataFrame:
    return D.atlas_summary(t.instances)


@query(
    "a21_category_totals", "failures",
    sql="""SELECT category, count(*) AS n, count(*) FILTER (split='validation') AS validation_count, count(*) FILTER (split='test') AS test_count,
      round(avg(line_cer),6) AS mean_cer, round(avg(confidence),6) AS mean_confidence FROM (SELECT *, unnest(categories) AS category FROM failures) GROUP BY 1""",
)
def a21(t: Inputs) -> DataFrame:
    return D.category_totals(_failures(t))


@query(
    "j9_version_comparison", "instances",
    sql="""SELECT category, round(a,6) AS first_avg_cer, round(b,6) AS second_avg_cer, CASE WHEN a<>0 AND b<>0 THEN CASE WHEN b<a THEN 'true' ELSE 'false' END ELSE 'unknown' END AS improved FROM (
      SELECT category, avg(cer) FILTER (model_version='v1') AS a, avg(cer) FILTER (model_version='v2') AS b FROM instances GROUP BY 1)""",
)
def j9(t: Inputs) -> DataFrame:
    verdict = F.coalesce(F.col("improved").cast("string"), F.lit("unknown"))
    return D.compare_versions(t.instances, "v1", "v2").withColumn("improved", verdict)


@query(
    "j7_flag_join", "pairs",
    sql="SELECT sample_id, is_uncertain, is_unreadable, split FROM pairs",
)
def j7(t: Inputs) -> DataFrame:
    flags = t.pairs.select(ID, "is_uncertain", "is_unreadable", "split")
    records = t.pairs.drop("is_uncertain", "is_unreadable", "split")
    return D.with_flags(records, flags).select(ID, "is_uncertain", "is_unreadable", "split")


@query(
    "j7_unmatched_flags", "pairs", "dirty",
    sql="""SELECT sample_id, 'no_flags' AS problem FROM pairs WHERE sample_id NOT IN (SELECT sample_id FROM dirty)
      UNION ALL SELECT sample_id, 'no_record' FROM dirty WHERE sample_id NOT IN (SELECT sample_id FROM pairs)""",
)
def j7_unmatched(t: Inputs) -> DataFrame:
    return D.unmatched_flags(t.pairs.select(ID), t.dirty.select(ID))


@query(
    "j8_split_isolation", "pairs",
    sql="""SELECT 'source_sha256' AS field, source_sha256 AS value FROM pairs GROUP BY 2 HAVING count(DISTINCT split)>1
      UNION ALL SELECT 'sample_id', sample_id FROM pairs GROUP BY 2 HAVING count(DISTINCT split)>1""",
)
def j8(t: Inputs) -> DataFrame:
    return D.isolation_overlap(t.validation, t.test)


@query(
    "u2_shared_writers", "pairs",
    sql="SELECT writer_id FROM pairs WHERE split='validation' INTERSECT SELECT writer_id FROM pairs WHERE split='test'",
)
def u2(t: Inputs) -> DataFrame:
    return t.validation.select("writer_id").intersect(t.test.select("writer_id"))


@query("u1_union_of_splits", "pairs", sql="SELECT split, count(*) AS n FROM pairs GROUP BY 1")
def u1(t: Inputs) -> DataFrame:
    return t.validation.unionByName(t.test).groupBy("split").agg(F.count("*").alias("n"))


# --- policy ------------------------------------------------------------------------------------

_DIAGNOSTIC = """count(*) AS num_samples, count(*) FILTER (exact) AS exact_matches, count(*) FILTER (NOT exact) AS exact_errors,
  round(avg(CAST(exact AS INT)::DOUBLE),6) AS exact_match_rate, round(avg(confidence),6) AS mean_confidence,
  round(avg(pow(confidence-CAST(exact AS INT),2)),6) AS exact_match_brier_score, round(avg(line_cer),6) AS mean_line_cer,
  round(avg(greatest(0.0::DOUBLE,1-line_cer)),6) AS mean_character_accuracy, round(avg(abs(confidence-greatest(0.0::DOUBLE,1-line_cer))),6) AS confidence_character_accuracy_mae,
  bool_or(exact) AND NOT bool_and(exact) AS target_has_both_classes"""


@query("a11_calibration_diagnostic", "feat", sql=f"SELECT {_DIAGNOSTIC} FROM feat WHERE split='validation'")
def a11(t: Inputs) -> DataFrame:
    return D.calibration_diagnostic(t.validation).drop("exact_match_ece")


_SWEEP = """(SELECT s.step, count(*) AS accepted_samples, CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM feat WHERE split='validation') AS coverage,
  CAST(sum(char_edits) AS DOUBLE)/sum(ref_chars) AS selective_cer, CAST(count(*) FILTER (NOT exact) AS DOUBLE)/count(*) AS exact_error_rate, CAST(s.step AS DOUBLE)/20 AS threshold
  FROM (SELECT * FROM feat WHERE split='validation') f JOIN (SELECT unnest(range(0,21)) AS step) s ON f.confidence >= CAST(s.step AS DOUBLE)/20 GROUP BY s.step)"""
_SWEEP_COLUMNS = "CAST(step AS INT) AS step, accepted_samples, round(coverage,6) AS coverage, round(selective_cer,6) AS selective_cer, round(exact_error_rate,6) AS exact_error_rate, round(threshold,6) AS threshold"


@query("a22_threshold_sweep", "feat", sql=f"SELECT {_SWEEP_COLUMNS} FROM {_SWEEP}")
def a22(t: Inputs) -> DataFrame:
    return D.threshold_sweep(t.validation)


@query("j18_threshold_join", "feat", sql=f"SELECT CAST(step AS INT) AS step, accepted_samples FROM {_SWEEP}")
def j18(t: Inputs) -> DataFrame:
    return D.threshold_sweep(t.validation).select("step", "accepted_samples")


_LIMIT = 0.2
_POLICY = f"""(SELECT * FROM {_SWEEP} WHERE accepted_samples >= ceil((SELECT count(*) FROM feat WHERE split='validation')*0.3::DOUBLE) AND selective_cer <= {_LIMIT}
  ORDER BY coverage DESC, selective_cer, threshold LIMIT 1)"""


def _policy(t: Inputs) -> DataFrame:
    return D.select_policy(t.validation, 0.3, _LIMIT)


@query(
    "a23_policy", "feat",
    sql=f"""SELECT 'diagnostic_candidate_found' AS status, round(threshold,6) AS threshold, accepted_samples, round(coverage,6) AS coverage,
      round(selective_cer,6) AS selective_cer, round(exact_error_rate,6) AS exact_error_rate, 0.3::DOUBLE AS minimum_coverage, {_LIMIT}::DOUBLE AS maximum_selective_cer FROM {_POLICY}""",
)
def a23(t: Inputs) -> DataFrame:
    return _policy(t)


@query("a23_no_policy", "feat", sql="SELECT 'no_eligible_threshold' AS status, true AS none")
def a23_none(t: Inputs) -> DataFrame:
    return D.select_policy(t.validation, 0.5, 0.0001).select("status", F.col("threshold").isNull().alias("none"))


@query("t8_best_policy_row", "feat", sql=f"SELECT round(threshold,6) AS threshold FROM {_POLICY}")
def t8(t: Inputs) -> DataFrame:
    return _policy(t).select("threshold")


@query(
    "a24_policy_on_holdout", "feat",
    sql=f"""SELECT 'applied' AS status, round(max(p.threshold),6) AS threshold, count(*) FILTER (confidence>=p.threshold) AS accepted_samples,
      round(CAST(count(*) FILTER (confidence>=p.threshold) AS DOUBLE)/count(*),6) AS coverage,
      round(CAST(sum(char_edits) FILTER (confidence>=p.threshold) AS DOUBLE)/sum(ref_chars) FILTER (confidence>=p.threshold),6) AS selective_cer,
      round(CAST(count(*) FILTER (confidence>=p.threshold AND NOT exact) AS DOUBLE)/count(*) FILTER (confidence>=p.threshold),6) AS exact_error_rate
      FROM feat, {_POLICY} p WHERE split='test'""",
)
def a24(t: Inputs) -> DataFrame:
    return D.apply_policy(t.test, _policy(t))


@query(
    "a25_blockers", "feat",
    sql="SELECT 'no_validation_threshold_met_selective_risk_policy' AS blockers",
)
def a25(t: Inputs) -> DataFrame:
    policy = D.select_policy(t.validation, 0.5, 0.0001)
    return D.calibration_blockers(D.calibration_diagnostic(t.validation), policy)


@query(
    "u6_reasons", "failures",
    sql="""SELECT sample_id, array_to_string(list_sort(list_distinct(list_concat(categories, slices, ['human_review_required']))),'|') AS reasons FROM failures""",
)
def u6(t: Inputs) -> DataFrame:
    reasons = D.merged_reasons(F.col("categories"), F.col("slices"), F.array(F.lit("human_review_required")))
    return _failures(t).select(ID, reasons.alias("reasons"))


# --- labelling queue -----------------------------------------------------------------------------


def _source(t: Inputs) -> DataFrame:
    return D.queue_source_of(t.pairs)


@query("j12_queue_source", "prioritised", sql="SELECT sample_id, source_sha256, round(priority,6) AS priority FROM prioritised")
def j12(t: Inputs) -> DataFrame:
    return _source(t)


@query(
    "a42_queue_totals", "prioritised",
    sql="""SELECT count(*) AS validation_tasks, count(*) FILTER (priority>=0) AS failure_targeted_tasks, count(*) FILTER (priority<0) AS coverage_control_tasks,
      count(*)*2 AS required_blind_annotation_assignments FROM prioritised""",
)
def a42(t: Inputs) -> DataFrame:
    return D.queue_totals(_source(t))


@query(
    "t3_blind_queue", "prioritised",
    sql=f"""SELECT sample_id, source_sha256, 'label-'||substr(sha256('{MANIFEST_SHA}:'||source_sha256||':'||sample_id||':double-blind-v1'),1,24) AS task_id,
      'awaiting_blind_annotation' AS status, CAST(2 AS INT) AS passes FROM prioritised""",
)
def t3(t: Inputs) -> DataFrame:
    queue = D.blind_queue(_source(t), F.lit(MANIFEST_SHA))
    return queue.select(ID, "source_sha256", "task_id", "status", F.col("review_protocol.required_blind_passes").alias("passes"))


@query(
    "t3_queue_positions", "prioritised",
    sql="SELECT sample_id, row_number() OVER (ORDER BY round(priority,9) DESC, sample_id) AS position FROM prioritised",
)
def t3_positions(t: Inputs) -> DataFrame:
    rows = _source(t).select(ID, F.round("priority", 9).alias("p"))
    return global_position(rows, [F.col("p").desc(), F.col(ID)]).select(ID, "position")


# --- active learning ---------------------------------------------------------------------------------


def _scored(t: Inputs) -> DataFrame:
    return R.score_items(t.al_items, t.frequencies)


@query("j10_frequency_lookup", "scored", "old_frequencies", sql="SELECT item_id, round(coalesce(o.frequency,0.5::DOUBLE),6) AS frequency FROM al_items a LEFT JOIN old_frequencies o ON coalesce(a.failure_category,'unknown')=o.category")
def j10(t: Inputs) -> DataFrame:
    return R.with_frequency(t.al_items, t.old_frequencies).select("item_id", "frequency")


@query("f15_priority_score", "scored", sql="SELECT item_id, round(priority_score,6) AS priority_score FROM scored")
def f15(t: Inputs) -> DataFrame:
    return _scored(t).select("item_id", "priority_score")


_QUEUE = "(SELECT * FROM scored WHERE confidence<0.95 ORDER BY round(priority_score,9) DESC, item_id LIMIT 1000)"


def _queue(t: Inputs) -> DataFrame:
    return R.annotation_queue(_scored(t).withColumn("priority_score", F.round("priority_score", 9)))


@query("t1_annotation_queue", "scored", sql=f"SELECT item_id, round(priority_score,6) AS priority_score, round(confidence,6) AS confidence FROM {_QUEUE}")
def t1(t: Inputs) -> DataFrame:
    return _queue(t).select("item_id", "priority_score", "confidence")


@query(
    "t2_next_batch", "scored",
    sql=f"""SELECT item_id, 'batch' AS part FROM (SELECT * FROM {_QUEUE} ORDER BY round(priority_score,9) DESC, item_id LIMIT 20)
      UNION ALL SELECT item_id, 'rest' FROM (SELECT * FROM {_QUEUE} ORDER BY round(priority_score,9) DESC, item_id OFFSET 20)""",
)
def t2(t: Inputs) -> DataFrame:
    batch, rest = R.next_batch(_queue(t))
    label = lambda df, name: df.select("item_id", F.lit(name).alias("part"))
    return label(batch, "batch").unionByName(label(rest, "rest"))


@query("a33_failure_frequencies", "frequencies", sql="SELECT category, round(frequency,6) AS frequency FROM frequencies")
def a33(t: Inputs) -> DataFrame:
    return t.frequencies


@query(
    "a33_merged_frequencies", "frequencies", "old_frequencies",
    sql="SELECT coalesce(n.category,o.category) AS category, round(coalesce(n.frequency,o.frequency),6) AS frequency FROM frequencies n FULL JOIN old_frequencies o ON n.category=o.category",
)
def a33_merged(t: Inputs) -> DataFrame:
    return R.merge_frequencies(t.old_frequencies, t.frequencies)


@query("t4_top_categories", "old_frequencies", sql="SELECT category, round(frequency,6) AS frequency FROM old_frequencies ORDER BY frequency DESC, category LIMIT 10")
def t4(t: Inputs) -> DataFrame:
    return R.top_categories(t.old_frequencies)


@query(
    "a34_queue_statistics", "scored",
    sql=f"SELECT count(*) AS queue_size, round(avg(priority_score),6) AS avg_priority, round(max(priority_score),6) AS max_priority, round(avg(confidence),6) AS avg_confidence FROM {_QUEUE}",
)
def a34(t: Inputs) -> DataFrame:
    return R.queue_statistics(_queue(t))


# --- reviews ------------------------------------------------------------------------------------------


@query(
    "j4_review_completeness", "label_rows", "reviews",
    sql="""SELECT filename, problem FROM (SELECT coalesce(l.filename,r.filename) AS filename, CASE WHEN r.filename IS NULL THEN 'no_review'
      WHEN l.filename IS NULL THEN 'no_label' WHEN sha256(l.text)<>r.final_sha256 THEN 'final_hash_mismatch' END AS problem
      FROM label_rows l FULL JOIN reviews r ON l.filename=r.filename) WHERE problem IS NOT NULL""",
)
def j4(t: Inputs) -> DataFrame:
    return annotation.unreviewed_or_unknown(t.label_rows, t.reviews)


@query(
    "j4_review_rules", "label_rows", "reviews",
    sql="""SELECT r.filename, concat_ws('|', CASE WHEN status='adjudicated' AND (adjudication_reason<>'transcription_disagreement' OR adjudication_seconds<=0) THEN 'adjudication_evidence' END,
      CASE WHEN status='agreed' AND (pass_1_sha256<>pass_2_sha256 OR pass_1_sha256<>final_sha256) THEN 'agreed_hashes' END,
      CASE WHEN annotator_1_id=annotator_2_id THEN 'annotators_independent' END, CASE WHEN crop_reviewed<>'true' THEN 'crop_reviewed' END,
      CASE WHEN l.filename IS NULL OR final_sha256<>sha256(l.text) THEN 'final_transcript' END) AS errors
      FROM reviews r LEFT JOIN label_rows l ON r.filename=l.filename""",
)
def j4_rules(t: Inputs) -> DataFrame:
    return annotation.check_reviews(t.label_rows, t.reviews).select("filename", "errors")


@query(
    "a27_review_quality", "reviews",
    sql="""SELECT count(*) AS samples, count(*) FILTER (status='agreed') AS agreed_samples, count(*) FILTER (status='adjudicated') AS adjudicated_samples,
      round(CAST(count(*) FILTER (status='agreed') AS DOUBLE)/count(*),6) AS agreement_rate, round(CAST(count(*) FILTER (status='adjudicated') AS DOUBLE)/count(*),6) AS adjudication_rate,
      round(sum(pass_1_seconds+pass_2_seconds+adjudication_seconds)/3600,6) AS total_review_hours, round(count(*)*3600/sum(pass_1_seconds+pass_2_seconds+adjudication_seconds),6) AS samples_per_review_hour FROM reviews""",
)
def a27(t: Inputs) -> DataFrame:
    return annotation.review_quality(t.reviews)


@query(
    "a40_review_statistics", "reviews",
    sql="""SELECT writer_id, count(*) AS total_reviewed, round(avg(pass_1_seconds+pass_2_seconds+adjudication_seconds),6) AS avg_seconds,
      round(CAST(count(*) FILTER (status='agreed') AS DOUBLE)/count(*),6) AS agreement_rate, round(CAST(count(*) FILTER (status='adjudicated') AS DOUBLE)/count(*),6) AS adjudication_rate,
      round(count(*)*3600/sum(pass_1_seconds+pass_2_seconds+adjudication_seconds),6) AS pages_per_hour FROM reviews GROUP BY 1""",
)
def a40(t: Inputs) -> DataFrame:
    return R.review_statistics(t.reviews, "writer_id")


# --- predictions against the manifest ---------------------------------------------------------------------


@query(
    "j1_gold_join", "pairs",
    sql="SELECT sample_id, reference, prediction, array_to_string(slices,'|') AS slices FROM pairs",
)
def j1(t: Inputs) -> DataFrame:
    rows = inference.reference_free_rows(t.pairs)
    return inference.join_gold(rows, t.pairs).select(ID, "reference", "prediction", "slices")


@query(
    "j1_gold_problems", "dirty", "pairs",
    sql="""SELECT sample_id, problem FROM (SELECT coalesce(d.sample_id,p.sample_id) AS sample_id,
        unnest(list_filter([CASE WHEN d.n IS NOT NULL AND p.source_sha256 IS NULL THEN 'unknown' END, CASE WHEN d.n>1 THEN 'duplicate' END,
          CASE WHEN d.n IS NULL THEN 'missing' END, CASE WHEN d.n IS NOT NULL AND p.source_sha256 IS NOT NULL AND (d.lo<>p.source_sha256 OR d.hi<>p.source_sha256) THEN 'hash_mismatch' END], lambda x: x IS NOT NULL)) AS problem
      FROM (SELECT sample_id, count(*) AS n, min(source_sha256) AS lo, max(source_sha256) AS hi FROM dirty GROUP BY 1) d FULL JOIN pairs p ON d.sample_id=p.sample_id)""",
)
def j1_problems(t: Inputs) -> DataFrame:
    return inference.gold_problems(t.dirty, t.pairs)


def _completed(t: Inputs) -> DataFrame:
    """Partial predictions: one sample in three has another reference or is unknown."""
    d = mod(F.col("k"), 30)
    return t.pairs.select(
        F.when(d == 1, F.concat(F.lit("x"), ID)).otherwise(F.col(ID)).alias(ID), "source_sha256",
        F.when(d == 2, F.concat("reference", F.lit("?"))).otherwise(F.col("reference")).alias("reference"),
    )


@query("j2_remaining", "pairs", sql="SELECT sample_id FROM pairs WHERE k%30=1")
def j2(t: Inputs) -> DataFrame:
    return inference.remaining(t.pairs, _completed(t)).select(ID)


@query(
    "j3_partial_identity", "pairs",
    sql="SELECT CASE WHEN k%30=1 THEN 'x' ELSE '' END||sample_id AS sample_id, CASE WHEN k%30=1 THEN 'unknown_sample' ELSE 'identity_mismatch' END AS problem FROM pairs WHERE k%30 IN (1,2)",
)
def j3(t: Inputs) -> DataFrame:
    return inference.partial_mismatches(_completed(t), t.pairs)


# The same joins over tables stored by sample id, which then move no rows. Both sides of a join have
# as many buckets as the texts fill, so that the rows of a bucket do not grow with the input.
BUCKET_BYTES = 4_000_000


def _by_id(t: Inputs, df: DataFrame, name: str, *more: str) -> DataFrame:
    (size,) = t.table("documents").agg(F.sum(F.octet_length("text"))).first()
    return store_by_key(df, [ID, *more], name, buckets=max(8, (size or 0) // BUCKET_BYTES))


@query("j1_bucketed_gold", "pairs", sql="SELECT sample_id, reference, prediction, array_to_string(slices,'|') AS slices FROM pairs")
def j1_bucketed(t: Inputs) -> DataFrame:
    rows = _by_id(t, inference.reference_free_rows(t.pairs), "predictions", "source_sha256")
    gold = _by_id(t, t.pairs.select(ID, "source_sha256", "reference", "slices"), "gold", "source_sha256")
    return inference.join_gold(rows, gold).select(ID, "reference", "prediction", "slices")


@query("j2_bucketed_remaining", "pairs", sql="SELECT sample_id FROM pairs WHERE k%30=1")
def j2_bucketed(t: Inputs) -> DataFrame:
    return inference.remaining(_by_id(t, t.pairs.select(ID, "source_sha256"), "selected"), _by_id(t, _completed(t), "completed")).select(ID)


@query(
    "j3_bucketed_identity", "pairs",
    sql="SELECT CASE WHEN k%30=1 THEN 'x' ELSE '' END||sample_id AS sample_id, CASE WHEN k%30=1 THEN 'unknown_sample' ELSE 'identity_mismatch' END AS problem FROM pairs WHERE k%30 IN (1,2)",
)
def j3_bucketed(t: Inputs) -> DataFrame:
    manifest = _by_id(t, t.pairs.select(ID, "source_sha256", "reference"), "manifest")
    return inference.partial_mismatches(_by_id(t, _completed(t), "partial"), manifest)


@query(
    "j21_reusable_runs", "pairs",
    sql="""SELECT doc_id, split, n AS num_records, doc_id%4=0 AS reusable FROM (SELECT doc_id, split, count(*) AS n FROM pairs GROUP BY 1,2)""",
)
def j21(t: Inputs) -> DataFrame:
    """One run per document; three in four finished runs differ in one bound column."""
    d = mod(F.col("doc_id"), 4)
    runs = t.pairs.groupBy("doc_id", "split").agg(F.count("*").alias("num_records")).withColumns(
        {
            "manifest_sha256": F.sha2(F.col("doc_id").cast("string"), 256),
            "output_sha256": F.sha2(F.concat(F.lit("o"), F.col("doc_id").cast("string")), 256),
            "model_version": F.lit("v1"),
        }
    )
    finished = runs.withColumns(
        {
            "status": F.when(d == 1, "running").otherwise("complete"),
            "num_records": F.col("num_records") + F.when(d == 2, 1).otherwise(0),
            "model_version": F.when(d == 3, "v2").otherwise("v1"),
        }
    )
    return inference.reusable_runs(runs, finished).select("doc_id", "split", "num_records", "reusable")
