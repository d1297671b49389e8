"""Queries: ledger, contracts, controls, authorisations, attestations and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscore import vocab
from folioscore.functions.text import utc_timestamp
from folioscore.operators import governance as G, ledger as L, rule_table
from folioscore.operators.rules import keys_match
from folioscore.queries.inputs import Inputs, mod
from folioscore.queries.registry import query
from folioscore.session import staging_path
from folioscore.sources import scans

NOW = "2024-06-01 00:00:00"
DAYS = 5


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


# --- ledger --------------------------------------------------------------------------------


@query(
    "w8_hash_chain", "ledger",
    sql="SELECT pilot_id, sequence, event_id FROM ledger WHERE sequence%97=0",
)
def w8(t: Inputs) -> DataFrame:
    return L.chain_breaks(t.ledger)


@query(
    "w9_sequence_gaps", "ledger",
    sql="SELECT pilot_id, count(*) AS events, min(sequence) AS first_sequence, max(sequence) AS last_sequence, min(sequence)=1 AND max(sequence)=count(*) AS gap_free FROM ledger GROUP BY 1",
)
def w9(t: Inputs) -> DataFrame:
    return L.sequence_gaps(t.ledger)


@query(
    "w10_time_order", "ledger",
    sql="""SELECT pilot_id, sequence, concat_ws('|', CASE WHEN occurred_at>recorded_at THEN 'occurred_after_recorded' END,
        CASE WHEN occurred_at<po THEN 'occurred_regressed' END, CASE WHEN recorded_at<pr THEN 'recorded_regressed' END) AS errors
      FROM (SELECT *, lag(occurred_at) OVER w AS po, lag(recorded_at) OVER w AS pr FROM ledger WINDOW w AS (PARTITION BY pilot_id ORDER BY sequence))
      WHERE occurred_at>recorded_at OR occurred_at<po OR recorded_at<pr""",
)
def w10(t: Inputs) -> DataFrame:
    return L.time_regressions(t.ledger, now())


@query(
    "w11_transitions", "ledger",
    sql="""SELECT pilot_id, sequence, event_id, errors FROM (SELECT pilot_id, sequence, event_id, concat_ws('|',
        CASE WHEN event_type<>'consent_withdrawal_requested' AND c>0 THEN 'after_close' END,
        CASE WHEN event_type<>'consent_withdrawal_requested' AND r=0 THEN 'before_request' END,
        CASE WHEN event_type='withdrawal_closed' AND (p=0 OR b=0) THEN 'closed_early' END,
        CASE WHEN event_type='backup_deletion_verified' AND b>0 THEN 'duplicate_backup' END,
        CASE WHEN event_type='primary_deletion_verified' AND p>0 THEN 'duplicate_primary' END,
        CASE WHEN event_type='consent_withdrawal_requested' AND r>0 THEN 'duplicate_request' END,
        CASE WHEN event_type<>'consent_withdrawal_requested' AND r>0 AND scope_sha256<>rs THEN 'scope_changed' END) AS errors
      FROM (SELECT *, count(*) FILTER (event_type='consent_withdrawal_requested') OVER w AS r, count(*) FILTER (event_type='primary_deletion_verified') OVER w AS p,
          count(*) FILTER (event_type='backup_deletion_verified') OVER w AS b, count(*) FILTER (event_type='withdrawal_closed') OVER w AS c,
          min(CASE WHEN event_type='consent_withdrawal_requested' THEN scope_sha256 END) OVER w AS rs
        FROM ledger WINDOW w AS (PARTITION BY pilot_id, subject_token_sha256 ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
      WHERE errors<>''""",
)
def w11(t: Inputs) -> DataFrame:
    return L.transition_errors(t.ledger)


_DUE = f"requested_at + INTERVAL {DAYS} DAY"
_BREACHED = f"CASE WHEN closed_at IS NULL THEN TIMESTAMP '{NOW}' > {_DUE} ELSE closed_at > {_DUE} OR closed_recorded_at > {_DUE} END"


@query(
    "a41_ledger_summary", "milestones",
    sql=f"""SELECT m.*, e.num_events, e.head_sha256, CASE WHEN open_withdrawals=0 AND deadline_breaches=0 THEN 'lifecycle_ready' ELSE 'lifecycle_attention_required' END AS status
      FROM (SELECT pilot_id, count(*) FILTER (first_request IS NOT NULL AND closed_at IS NULL) AS open_withdrawals, count(*) FILTER (first_request IS NOT NULL AND closed_at IS NOT NULL) AS closed_withdrawals,
        count(*) FILTER (first_request IS NOT NULL AND {_BREACHED}) AS deadline_breaches FROM milestones GROUP BY 1) m
      JOIN (SELECT pilot_id, count(*) AS num_events, arg_max(event_sha256, sequence) AS head_sha256 FROM ledger GROUP BY 1) e USING (pilot_id)""",
)
def a41(t: Inputs) -> DataFrame:
    return L.ledger_summary(t.ledger, DAYS, now())


@query(
    "f33_deadline_breach", "milestones",
    sql=f"SELECT pilot_id, subject_token_sha256, closed_at IS NULL AS is_open, {_BREACHED} AS breached FROM milestones WHERE first_request IS NOT NULL",
)
def f33(t: Inputs) -> DataFrame:
    rows = L.with_deadlines(L.subject_milestones(t.ledger), DAYS, now())
    return rows.filter(F.col("first_request").isNotNull()).select("pilot_id", "subject_token_sha256", "is_open", "breached")


@query(
    "f32_expected_actor", "ledger",
    sql="""SELECT event_id, CASE event_type WHEN 'consent_withdrawal_requested' THEN 'pilot_owner' WHEN 'withdrawal_closed' THEN 'deletion_owner' ELSE 'storage_operator' END AS actor FROM ledger""",
)
def f32(t: Inputs) -> DataFrame:
    actor = L.expected_actor(F.lit("pilot_owner"), F.lit("storage_operator"), F.lit("deletion_owner"))
    return t.ledger.select("event_id", actor.alias("actor"))


@query(
    "j19_consent_gate", "milestones",
    sql="""SELECT pilot_id, sequence, event_id FROM ledger WHERE subject_token_sha256 NOT IN
      (SELECT subject_token_sha256 FROM milestones WHERE first_request IS NOT NULL AND first_close IS NULL)""",
)
def j19(t: Inputs) -> DataFrame:
    return L.consented(t.ledger, L.open_withdrawals(t.ledger)).select("pilot_id", "sequence", "event_id")


def _iso(t: Inputs) -> DataFrame:
    """Event times as text: zulu, with an offset, or without a zone."""
    seq = F.col("sequence")
    plain = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.date_format(F.col("occurred_at") + F.expr("INTERVAL 2 HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    value = (
        F.when(mod(seq, 3) == 0, F.concat(plain, F.lit("Z")))
        .when(mod(seq, 3) == 1, F.concat(shifted, F.lit("+02:00")))
        .otherwise(plain)
    )
    return t.ledger.withColumn("iso", value)


@query(
    "f29_utc_timestamps", "ledger",
    sql="SELECT event_id, CASE WHEN sequence%3=2 THEN -1 ELSE epoch_us(occurred_at) END AS micros FROM ledger",
)
def f29(t: Inputs) -> DataFrame:
    micros = F.coalesce(F.unix_micros(utc_timestamp(F.col("iso"))), F.lit(-1).cast("long"))
    return _iso(t).select("event_id", micros.alias("micros"))


@query(
    "s12_ledger_scan", "ledger",
    sql="""SELECT event_id, sequence, epoch_us(occurred_at) AS occurred_us,
      concat_ws('|', CASE WHEN sequence%61=0 THEN 'fields' END, CASE WHEN sequence%3=2 THEN 'occurred_at' END) AS errors FROM ledger""",
)
def s12(t: Inputs) -> DataFrame:
    path = staging_path(t.spark, "ledger")
    extra = F.when(mod(F.col("sequence"), 61) == 0, "x")
    row = F.struct(
        F.lit(1).alias("schema_version"), "sequence", "event_id", "event_type", F.col("iso").alias("occurred_at"),
        F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("recorded_at"), "pilot_id", "subject_token_sha256",
        "scope_sha256", F.lit("storage_operator").alias("actor_role"), F.lit("evidence-file").alias("evidence_reference"),
        F.col("event_sha256").alias("evidence_sha256"), "previous_event_sha256", "event_sha256", extra.alias("comment"),
        F.unix_micros("occurred_at").alias("us"),
    )
    # The extra key and the checked time are dropped again unless they are the point of a row.
    fields = [*vocab.EVENT_COLUMNS, "comment"]
    _iso(t).select(row.alias("r")).select(
        F.to_json(F.struct(*[F.col(f"r.{f}").alias(f) for f in fields])).alias("value")
    ).write.text(path)
    rows = scans.ledger_events(t.spark, path)
    original = t.ledger.select("event_id", F.unix_micros("occurred_at").alias("occurred_us"))
    return rows.select("event_id", "sequence", "errors").join(original, "event_id")


@query(
    "p9_event_rules", "ledger",
    sql="SELECT event_id, CASE WHEN sequence%89=0 THEN 'timestamps' ELSE '' END AS errors FROM ledger",
)
def p9(t: Inputs) -> DataFrame:
    rows = t.ledger.withColumns(
        {
            "schema_version": F.lit(1), "actor_role": F.lit("storage_operator"),
            "evidence_reference": F.lit("evidence-file"), "evidence_sha256": F.col("event_sha256"),
        }
    )
    return L.check_events(rows, now()).select("event_id", "errors")


# --- documents per customer ---------------------------------------------------------------------


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _obj(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _consts(**values: object) -> dict[str, Column]:
    return {n: F.lit(v) for n, v in values.items()}


def _customers(t: Inputs) -> DataFrame:
    key = F.col("c_custkey")
    return t.table("customer").select(
        "c_custkey", F.format_string("pilot-customer-%d", "c_custkey").alias("pilot_id"), mod(key, 9).alias("d")
    )


def _broken(d: int, bad: object, good: object) -> Column:
    return F.when(F.col("d") == d, F.lit(bad)).otherwise(F.lit(good))


def _contract() -> Column:
    approval = _obj(
        **_consts(privacy_review_status="approved", privacy_review_reference="privacy-ref-1",
                  educator_approval_status="approved", educator_approval_reference="educator-ref-1"),
        accountable_owner_role=_broken(1, "pending", "pilot_owner_role"),
        consent=_obj(
            status=_broken(2, "withdrawn", "active"),
            **_consts(authority="participant", capacity_assessment_complete=True,
                      collection_purpose="handwriting_ocr_shadow_evaluation", evaluation_allowed=True),
            publication_allowed=_broken(3, True, False),
            **_consts(withdrawal_process_documented=True, consent_records_separate_from_dataset=True,
                      verified_at="2024-01-01T00:00:00Z", training_allowed=False),
        ),
    )
    privacy = _obj(
        **_consts(direct_identifiers_removed=True, visual_identifier_review_complete=True, image_metadata_removed=True,
                  filename_policy="opaque_sample_id", writer_id_policy="opaque_pseudonym"),
        allowed_demographics=F.when(F.col("d") == 4, F.array(F.lit("age_band"), F.lit("name"))).otherwise(F.array(F.lit("age_band"))),
        **_consts(public_repository_allowed=False, github_actions_allowed=False, third_party_ai_upload_allowed=False,
                  automated_education_decisions_allowed=False),
    )
    storage = _obj(
        **_consts(location_class="approved_private", encryption_at_rest=True, encryption_in_transit=True, audit_logging=True,
                  backup_copies_in_retention_scope=True, access_control="named_least_privilege", cross_border_disclosure="none"),
        raw_source_retention_days=_broken(5, 31, 30),
        **_consts(normalized_candidate_retention_days=180, deletion_on_withdrawal_days=14,
                  deletion_method="verified_secure_deletion_or_deidentification",
                  deletion_verification_owner_role="deletion_owner_role"),
    )
    note = _obj(**_consts(
        review_filename="annotation_review.csv", guideline_version=G.ANNOTATION_GUIDELINE, independent_annotators_per_sample=2,
        blind_first_passes=True, adjudication_required_on_disagreement=True, adjudicator_must_be_independent=True,
        crop_boundary_review_required=True, model_preannotations_allowed=False))
    gold = _obj(
        **_consts(minimum_distinct_writers=3, evaluation_set_version="v1", split_seed=42, minimum_samples_per_writer=3,
                  validation_writer_ratio=0.5),
        test_writer_ratio=_broken(6, 0.4, 0.5),
        **_consts(writer_isolation_required=True, split_locked_before_model_selection=True,
                  test_set_training_access_allowed=False, gold_ready=False),
    )
    return _json(
        schema_version=_broken(7, 2, 1), pilot_id=F.col("pilot_id"), **_consts(data_stage="normalized_line_gold_candidate", jurisdiction="AU-VIC"),
        approval=approval, privacy=privacy, storage=storage, annotation=note, gold=gold,
    )


def _expected(*codes: str) -> str:
    """Per customer the rules its broken field breaks, in the order of the defect number."""
    cases = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(codes))
    return f"SELECT 'pilot-customer-'||c_custkey AS pilot_id, CASE c_custkey%9 {cases} ELSE '' END AS errors FROM customer"


def _contracts(t: Inputs) -> DataFrame:
    return _customers(t).select("pilot_id", _contract().alias("document"))


@query(
    "p13_contract_rules",
    sql=_expected("", "approval.accountable_owner_role", "approval.consent.status", "approval.consent.publication_allowed",
                  "privacy.allowed_demographics", "storage.raw_source_retention_days", "gold.writer_ratios", "schema_version"),
)
def p13(t: Inputs) -> DataFrame:
    return G.check_contracts(_contracts(t)).select("pilot_id", "errors")


def _own_contracts(t: Inputs) -> DataFrame:
    """Contracts whose terms come from all columns of a customer; some have keys of their own."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    name, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    share = (1 + mod(cents, 9)).cast("double") / 10
    own = {
        "approval": dict(
            accountable_owner_role=F.when(mod(nation, 5) == 0, name).otherwise(F.lower(name)),
            consent=dict(
                status=F.when(cents < 0, "withdrawn").otherwise("active"), publication_allowed=mod(cents, 13) == 0,
                verified_at=F.when(mod(nation, 7) == 0, "2024-01-01 00:00:00").otherwise("2024-01-01T00:00:00Z"),
            ),
        ),
        "storage": dict(raw_source_retention_days=nation + 8),
        "gold": dict(
            split_seed=cents, validation_writer_ratio=share, test_writer_ratio=F.when(mod(cents, 11) == 0, share).otherwise(1 - share),
            gold_ready=F.when(mod(cents, 17) == 0, "false").otherwise(None),
        ),
    }
    base = F.col("base")  # a column of its own, so that it is parsed once a row
    fields = {f: base[f] for f in ("schema_version", "pilot_id", "data_stage", "jurisdiction", "approval", "privacy", "storage", "annotation", "gold")}
    consent = fields["approval"]["consent"]
    for key, value in own["approval"]["consent"].items():
        consent = consent.withField(key, value)
    fields["approval"] = fields["approval"].withField("accountable_owner_role", own["approval"]["accountable_owner_role"]).withField("consent", consent)
    fields["storage"] = fields["storage"].withField("raw_source_retention_days", own["storage"]["raw_source_retention_days"]).withField(
        "note", F.struct(F.when(name == "MACHINERY", F.col("c_name")).alias("from"))
    )
    for key, value in own["gold"].items():
        if key != "gold_ready":
            fields["gold"] = fields["gold"].withField(key, value)
    # Text instead of a truth value.
    fields["gold"] = F.when(mod(cents, 17) == 0, F.to_json(fields["gold"].withField("gold_ready", F.lit("false")))).otherwise(F.to_json(fields["gold"]))
    rest = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items() if n != "gold"], F.when(name == "BUILDING", F.col("c_name")).alias("remark")))
    document = F.concat(F.substring(rest, 1, F.length(rest) - 1), F.lit(',"gold":'), fields["gold"], F.lit("}"))
    return t.spread(t.table("customer")).select(
        "*", F.lit(0).alias("d"), F.format_string("pilot-customer-%d", "c_custkey").alias("pilot_id")
    ).withColumn("base", F.from_json(_contract(), G.CONTRACT_SCHEMA)).select("pilot_id", F.when(mod(cents, 101) == 0, F.lit("[1]")).otherwise(document).alias("document"))


@query(
    "p13_rule_table",
    sql="""SELECT pilot_id, CASE WHEN cents%101=0 THEN 'document' ELSE concat_ws('|', CASE WHEN c_nationkey%5=0 THEN 'approval.accountable_owner_role' END,
        CASE WHEN cents%13=0 THEN 'approval.consent.publication_allowed' END, CASE WHEN cents<0 THEN 'approval.consent.status' END,
        CASE WHEN c_nationkey%7=0 THEN 'approval.consent.verified_at' END, CASE WHEN cents%17=0 THEN 'gold.gold_ready' END,
        CASE WHEN cents<0 THEN 'gold.split_seed' END, CASE WHEN cents%11=0 AND abs(2*share-1)>1e-9 THEN 'gold.writer_ratios' END,
        CASE WHEN c_nationkey+8>30 THEN 'storage.raw_source_retention_days' END) END AS errors,
      CASE WHEN cents%101=0 THEN '' ELSE concat_ws('|', CASE WHEN c_mktsegment='BUILDING' THEN 'remark' END, 'storage.note') END AS unknown
      FROM (SELECT *, 'pilot-customer-'||c_custkey AS pilot_id, CAST(1+((cents%9)+9)%9 AS DOUBLE)/10 AS share FROM (SELECT *, CAST(round(c_acctbal*100) AS BIGINT) AS cents FROM customer))""",
)
def p13_table(t: Inputs) -> DataFrame:
    """The same rules as rows, over documents whose values come from every column."""
    return rule_table.check_documents(_own_contracts(t), rule_table.rule_frame(t.spark, G.contract_rule_rows()))


def _controls(t: Inputs) -> DataFrame:
    document = _json(
        **_consts(schema_version=1),
        status=_broken(1, "draft", "approved"),
        storage_id=F.format_string("storage-%08d", "c_custkey"), pilot_id=F.col("pilot_id"),
        approved_at=F.lit("2024-05-01T00:00:00Z"),
        expires_at=_broken(2, "2024-09-01T00:00:00Z", "2024-07-01T00:00:00Z"),
        accountable_owner_role=F.lit("pilot_owner_role"), operator_role=_broken(3, "Operator", "storage_operator"),
        **_consts(deletion_verification_owner_role="deletion_owner_role", platform="self_hosted_posix", root_identity_sha256="0" * 64,
                  operator_uid=1000, operator_gid=1000),
        controls=_obj(
            **_consts(encryption_at_rest_attested=True, encryption_in_transit_attested=True, named_least_privilege_attested=True,
                      audit_logging_attested=True, backup_copies_in_retention_scope=True, network_isolation_attested=True),
            public_access_allowed=_broken(4, True, False), cross_border_disclosure=F.lit("none"),
        ),
        retention=_obj(
            raw_source_retention_days=_broken(5, 31, 30), normalized_candidate_retention_days=F.lit(180),
            deletion_on_withdrawal_days=_broken(6, 7, 14),
        ),
        lifecycle_ledger_filename=F.lit("protected_lifecycle_events.jsonl"),
        note=F.when(F.col("d") == 7, "extra"),
    )
    return _customers(t).select("pilot_id", document.alias("document"))


@query(
    "p15_storage_control",
    sql="""SELECT 'pilot-customer-'||c_custkey AS pilot_id, CASE c_custkey%9 WHEN 1 THEN 'accountable_owner_role|approved' WHEN 2 THEN 'validity_window' WHEN 3 THEN 'operator_role'
      WHEN 4 THEN 'controls.public_access_allowed' WHEN 5 THEN 'retention.raw_source_retention_days' WHEN 6 THEN 'retention' WHEN 7 THEN 'fields'
      WHEN 8 THEN CASE c_custkey%2 WHEN 0 THEN 'root_identity_sha256' ELSE 'execution_principal' END ELSE '' END AS errors FROM customer""",
)
def p15(t: Inputs) -> DataFrame:
    moved, other = (F.col("d") == 8) & (mod(F.col("c_custkey"), 2) == 0), (F.col("d") == 8) & (mod(F.col("c_custkey"), 2) == 1)
    stores = _customers(t).select(
        "pilot_id", F.when(moved, F.lit("1" * 64)).otherwise(F.lit("0" * 64)).alias("root_identity_sha256"),
        F.when(other, 1001).otherwise(1000).alias("operator_uid"), F.lit(1000).alias("operator_gid"),
    )
    return G.check_controls(_controls(t), _contracts(t), stores, now()).select("pilot_id", "errors")


def _sha(tag: str) -> Column:
    return F.sha2(F.concat(F.lit(tag), "pilot_id"), 256)


def _bindings(t: Inputs) -> DataFrame:
    return _customers(t).select(
        "pilot_id", F.concat("pilot_id", F.lit("-v1")).alias("evaluation_set_id"), _sha("manifest").alias("manifest_sha256"),
        _sha("control").alias("storage_control_sha256"), _sha("head").alias("lifecycle_ledger_head_sha256"),
        F.lit("pilot_owner_role").alias("accountable_owner_role"), F.lit("storage_operator").alias("operator_role"),
        F.lit("model-v1").alias("model_version"), _sha("predictions").alias("predictions_sha256"),
    )


def _authorizations(t: Inputs) -> DataFrame:
    document = _json(
        **_consts(schema_version=1, status="approved", execution_environment="approved_self_hosted"),
        evaluation_set_id=F.concat("pilot_id", F.lit("-v1")),
        manifest_sha256=F.when(F.col("d") == 1, _sha("other")).otherwise(_sha("manifest")),
        storage_control_sha256=_sha("control"), lifecycle_ledger_head_sha256=_sha("head"), model_artifact_sha256=_sha("model"),
        model_version=F.lit("model-v1"), device=F.lit("cpu"),
        inference_config=_obj(
            **_consts(batch_size=8, beam_width=4), max_length=_broken(2, 0, 64),
            confidence_threshold=F.lit(0.7), abstention_threshold=_broken(3, 0.8, 0.4), dtype=_broken(4, "float16", "float32"),
        ),
        **_consts(prediction_schema=G.PREDICTION_SCHEMA_NAME, approval_reference="approval-ref-1", accountable_owner_role="pilot_owner_role",
                  operator_role="storage_operator", approved_at="2024-05-20T00:00:00Z"),
        expires_at=F.when(F.col("d") == 5, "2024-06-30T00:00:00Z").when(F.col("d") == 6, "2024-05-30T00:00:00Z").otherwise("2024-06-10T00:00:00Z"),
        **_consts(protected_storage_required=True, network_access_during_inference=False, external_ai_services_allowed=False,
                  github_actions_allowed=False, model_artifacts_preloaded=True),
        training_allowed=_broken(7, True, False), automated_decisions_allowed=F.lit(False),
    )
    return _customers(t).select("pilot_id", document.alias("document"))


@query(
    "p14_authorization",
    sql=_expected("", "manifest_sha256", "inference_config.max_length", "threshold_order", "inference_config.dtype",
                  "validity_window", "in_force", "training_allowed"),
)
def p14(t: Inputs) -> DataFrame:
    return G.check_authorizations(_authorizations(t), _bindings(t), now()).select("pilot_id", "errors")


def _attestations(t: Inputs) -> DataFrame:
    document = _json(
        **_consts(schema_version=1, execution_environment="approved_self_hosted"),
        executed_at=_broken(1, "2024-07-01T00:00:00Z", "2024-05-25T00:00:00Z"), operator_role=_broken(2, "other_operator", "storage_operator"),
        approval_reference=F.lit("approval-ref-1"), inference_authorization_sha256=_sha("authorization"), model_version=F.lit("model-v1"),
        model_artifact_sha256=F.when(F.col("d") == 3, F.upper(_sha("model"))).otherwise(_sha("model")), inference_config_sha256=_sha("config"),
        evaluation_set_id=F.concat("pilot_id", F.lit("-v1")), manifest_sha256=_sha("manifest"), storage_control_sha256=_sha("control"),
        lifecycle_ledger_head_sha256=_sha("head"),
        predictions_sha256=F.when(F.col("d") == 4, _sha("other")).otherwise(_sha("predictions")),
        **_consts(protected_storage_mounted=True), network_access_during_inference=_broken(5, True, False),
        **_consts(external_ai_services_used=False, github_actions_used=False, model_artifacts_preloaded=True,
                  predictions_contain_references=False, automated_decisions_enabled=False),
        note=F.when(F.col("d") == 6, "extra"),
    )
    return _customers(t).select("pilot_id", document.alias("document"))


@query(
    "p16_attestation",
    sql="""SELECT 'pilot-customer-'||c_custkey AS pilot_id, CASE c_custkey%9 WHEN 1 THEN 'executed_at' WHEN 2 THEN 'operator_role' WHEN 3 THEN CASE WHEN upper(sha256('modelpilot-customer-'||c_custkey)) = lower(sha256('modelpilot-customer-'||c_custkey)) THEN '' ELSE 'model_artifact_sha256' END
      WHEN 4 THEN 'predictions_sha256' WHEN 5 THEN 'network_access_during_inference' WHEN 6 THEN 'fields' ELSE '' END AS errors FROM customer""",
)
def p16(t: Inputs) -> DataFrame:
    return G.check_attestations(_attestations(t), _bindings(t), now()).select("pilot_id", "errors")


def _runs(t: Inputs) -> DataFrame:
    return _customers(t).select(
        F.col("pilot_id").alias("run_id"), "d", F.when(F.col("d") == 1, "partial").otherwise("complete").alias("status"),
        F.lit("test").alias("split"), (6 + mod(F.col("c_custkey"), 5)).alias("num_records"), _sha("manifest").alias("manifest_sha256"),
        F.lit("model-v1").alias("model_version"), _sha("model").alias("model_artifact_sha256"), _sha("predictions").alias("predictions_sha256"),
        (F.col("d") == 2).alias("writer_ids_exported"), F.lit(False).alias("source_images_exported"),
    )


@query(
    "p21_run_provenance",
    sql="""SELECT 'pilot-customer-'||c_custkey AS run_id, CASE c_custkey%9 WHEN 1 THEN 'status' WHEN 2 THEN 'writer_ids_exported' WHEN 3 THEN 'num_records' WHEN 4 THEN 'predictions_sha256'
      WHEN 5 THEN 'network_access_allowed' WHEN 6 THEN 'gold_benchmark' ELSE '' END AS errors FROM customer""",
)
def p21(t: Inputs) -> DataFrame:
    d = F.col("d")
    attested = _runs(t).withColumns(
        {
            "num_records": F.col("num_records") + F.when(d == 3, 1).otherwise(0),
            "predictions_sha256": F.when(d == 4, F.lit("0" * 64)).otherwise(F.col("predictions_sha256")),
            "network_access_allowed": d == 5, "gold_benchmark": d == 6, "num_writers": F.lit(2),
        }
    )
    return G.check_provenance(_runs(t), attested)


@query(
    "a43_preflight",
    sql="""SELECT 'pilot-customer-'||c_custkey AS pilot_id, NOT (x OR y OR z) AS ready, CASE WHEN x OR y OR z THEN 'blocked_external_evidence_required' ELSE 'ready_for_owner_authorized_shadow_inference' END AS status,
      concat_ws('|', CASE WHEN x THEN 'frozen_evaluation_gate_failed' END, CASE WHEN NOT (x OR y) AND z THEN 'inference_authorization_gate_failed' WHEN x OR y THEN 'inference_authorization_not_evaluable' END,
        CASE WHEN y THEN 'sealed_local_model_gate_failed' END) AS blockers
      FROM (SELECT c_custkey, c_custkey%9 BETWEEN 1 AND 7 AS x, c_custkey%7=0 AS y, c_custkey%9 BETWEEN 1 AND 7 AS z FROM customer)""",
)
def a43(t: Inputs) -> DataFrame:
    """Contracts gate the frozen set, the customer key the sealed model, then the authorisation."""
    contracts = G.check_contracts(_contracts(t)).select("pilot_id", (F.size("errors") == 0).alias("frozen_evaluation"))
    allowed = G.check_authorizations(_authorizations(t), _bindings(t), now()).select(
        "pilot_id", (F.size("errors") == 0).alias("inference_authorization")
    )
    key = F.substring_index("pilot_id", "-", -1).cast("long")
    gates = contracts.join(allowed, "pilot_id").withColumn("sealed_local_model", mod(key, 7) != 0)
    return G.preflight(gates)


@query(
    "j15_leak_detection", "pairs",
    sql="SELECT DISTINCT reference AS value FROM pairs WHERE doc_id%10=0 AND reference<>''",
)
def j15(t: Inputs) -> DataFrame:
    """A report that quotes the references of every tenth document."""
    quoted = F.when(mod(F.col("doc_id"), 10) == 0, F.col("reference")).otherwise(F.lit("withheld"))
    report = t.pairs.select(quoted.alias("value"))
    return G.leaked_values(report, t.pairs, ["sample_id", "writer_id", "reference"])


@query(
    "s26_intake_audit", "reviews", "label_rows",
    sql="""SELECT (SELECT count(*) FROM label_rows) AS samples, (SELECT count(DISTINCT writer_id) FROM label_rows) AS writers,
      (SELECT round(CAST(count(*) FILTER (status='agreed') AS DOUBLE)/count(*),6) FROM reviews) AS agreement_rate,
      (SELECT count(*)-count(DISTINCT source_sha256) FROM label_rows) AS duplicate_source_hashes""",
)
def s26(t: Inputs) -> DataFrame:
    from folioscore.operators.annotation import review_quality
    from folioscore.operators.manifest import duplicate_hash_surplus

    labels = t.label_rows.groupBy("writer_id").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("samples"), F.count("*").alias("writers")
    )
    return labels.withColumns(
        {
            "agreement_rate": review_quality(t.reviews).select("agreement_rate").scalar(),
            "duplicate_source_hashes": duplicate_hash_surplus(t.label_rows).scalar(),
        }
    )


@query(
    "s27_attestation_rows",
    sql="""SELECT p AS pilot_id, p||'-v1' AS evaluation_set_id, 'storage_operator' AS operator_role, 'approval-ref-1' AS approval_reference,
      'model-v1' AS model_version, sha256('model'||p) AS model_artifact_sha256, sha256(CASE WHEN d=1 THEN 'other' ELSE 'manifest' END||p) AS manifest_sha256,
      sha256('control'||p) AS storage_control_sha256, sha256('head'||p) AS lifecycle_ledger_head_sha256, sha256('predictions'||p) AS predictions_sha256,
      sha256('{"abstention_threshold":'||CASE WHEN d=3 THEN '0.8' ELSE '0.4' END||',"batch_size":8,"beam_width":4,"confidence_threshold":0.7,"dtype":"'
        ||CASE WHEN d=4 THEN 'float16' ELSE 'float32' END||'","max_length":'||CASE WHEN d=2 THEN '0' ELSE '64' END||'}') AS inference_config_sha256,
      CASE WHEN d=1 THEN 'manifest_sha256' ELSE '' END AS errors
      FROM (SELECT 'pilot-customer-'||c_custkey AS p, c_custkey%9 AS d FROM customer)""",
)
def s27(t: Inputs) -> DataFrame:
    """The rows as documents pass the attestation rules, but for the one authorised wrongly."""
    rows = G.attestation_rows(
        _authorizations(t).join(_bindings(t).select("pilot_id", "predictions_sha256"), "pilot_id"), F.lit("2024-05-25T00:00:00Z")
    )
    documents = rows.select("pilot_id", F.to_json(F.struct(*G.ATTESTATION_FIELDS)).alias("document"))
    checked = G.check_attestations(documents, _bindings(t), now()).select("pilot_id", "errors")
    return rows.join(checked, "pilot_id").select(
        "pilot_id", "evaluation_set_id", "operator_role", "approval_reference", "model_version", "model_artifact_sha256",
        "manifest_sha256", "storage_control_sha256", "lifecycle_ledger_head_sha256", "predictions_sha256",
        "inference_config_sha256", "errors",
    )


@query(
    "p12_control_fields",
    sql="SELECT 'pilot-customer-'||c_custkey AS pilot_id, c_custkey%9<>7 AS ok FROM customer",
)
def p12(t: Inputs) -> DataFrame:
    return _controls(t).select("pilot_id", keys_match(F.col("document"), G.CONTROL_FIELDS).alias("ok"))

