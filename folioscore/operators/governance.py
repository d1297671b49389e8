"""Rule engines over contract, control, authorisation, attestation and provenance documents.

Each engine parses one JSON document per row with a fixed schema and lists the broken rules;
a value of the wrong type parses to null and therefore breaks its rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscore import vocab
from folioscore.functions.digests import canonical_sha256
from folioscore.functions.text import utc_timestamp
from folioscore.operators import rule_table as R
from folioscore.operators.onerow import beside
from folioscore.operators.rules import (
    Rule, is_role, is_sha256, keys_match, optional_number, validate,
)

# --- fixed schemas ------------------------------------------------------------------------

CONTRACT_SCHEMA = """
schema_version int, pilot_id string, data_stage string, jurisdiction string,
approval struct<privacy_review_status:string, privacy_review_reference:string,
  educator_approval_status:string, educator_approval_reference:string,
  accountable_owner_role:string,
  consent:struct<status:string, authority:string, capacity_assessment_complete:boolean,
    collection_purpose:string, evaluation_allowed:boolean, publication_allowed:boolean,
    withdrawal_process_documented:boolean, consent_records_separate_from_dataset:boolean,
    verified_at:string, training_allowed:boolean>>,
privacy struct<direct_identifiers_removed:boolean, visual_identifier_review_complete:boolean,
  image_metadata_removed:boolean, filename_policy:string, writer_id_policy:string,
  allowed_demographics:array<string>, public_repository_allowed:boolean,
  github_actions_allowed:boolean, third_party_ai_upload_allowed:boolean,
  automated_education_decisions_allowed:boolean>,
storage struct<location_class:string, encryption_at_rest:boolean, encryption_in_transit:boolean,
  audit_logging:boolean, backup_copies_in_retention_scope:boolean, access_control:string,
  cross_border_disclosure:string, raw_source_retention_days:int,
  normalized_candidate_retention_days:int, deletion_on_withdrawal_days:int,
  deletion_method:string, deletion_verification_owner_role:string>,
annotation struct<review_filename:string, guideline_version:string,
  independent_annotators_per_sample:int, blind_first_passes:boolean,
  adjudication_required_on_disagreement:boolean, adjudicator_must_be_independent:boolean,
  crop_boundary_review_required:boolean, model_preannotations_allowed:boolean>,
gold struct<minimum_distinct_writers:int, evaluation_set_version:string, split_seed:bigint,
  minimum_samples_per_writer:int, validation_writer_ratio:double, test_writer_ratio:double,
  writer_isolation_required:boolean, split_locked_before_model_selection:boolean,
  test_set_training_access_allowed:boolean, gold_ready:boolean>
"""

CONTROL_FIELDS = [
    "schema_version", "status", "storage_id", "pilot_id", "approved_at", "expires_at",
    "accountable_owner_role", "operator_role", "deletion_verification_owner_role", "platform",
    "root_identity_sha256", "operator_uid", "operator_gid", "controls", "retention",
    "lifecycle_ledger_filename",
]
CONTROL_SCHEMA = """
schema_version int, status string, storage_id string, pilot_id string, approved_at string,
expires_at string, accountable_owner_role string, operator_role string,
deletion_verification_owner_role string, platform string, root_identity_sha256 string,
operator_uid int, operator_gid int,
controls struct<encryption_at_rest_attested:boolean, encryption_in_transit_attested:boolean,
  named_least_privilege_attested:boolean, audit_logging_attested:boolean,
  backup_copies_in_retention_scope:boolean, network_isolation_attested:boolean,
  public_access_allowed:boolean, cross_border_disclosure:string>,
retention struct<raw_source_retention_days:int, normalized_candidate_retention_days:int,
  deletion_on_withdrawal_days:int>,
lifecycle_ledger_filename string
"""
RETENTION_LIMITS = {
    "raw_source_retention_days": 30,
    "normalized_candidate_retention_days": 180,
    "deletion_on_withdrawal_days": 30,
}

AUTHORIZATION_FIELDS = [
    "schema_version", "status", "execution_environment", "evaluation_set_id", "manifest_sha256",
    "storage_control_sha256", "lifecycle_ledger_head_sha256", "model_artifact_sha256",
    "model_version", "device", "inference_config", "prediction_schema", "approval_reference",
    "accountable_owner_role", "operator_role", "approved_at", "expires_at",
    "protected_storage_required", "network_access_during_inference",
    "external_ai_services_allowed", "github_actions_allowed", "model_artifacts_preloaded",
    "training_allowed", "automated_decisions_allowed",
]
AUTHORIZATION_FLAGS = {
    "protected_storage_required": True,
    "network_access_during_inference": False,
    "external_ai_services_allowed": False,
    "github_actions_allowed": False,
    "model_artifacts_preloaded": True,
    "training_allowed": False,
    "automated_decisions_allowed": False,
}
AUTHORIZATION_SCHEMA = """
schema_version int, status string, execution_environment string, evaluation_set_id string,
manifest_sha256 string, storage_control_sha256 string, lifecycle_ledger_head_sha256 string,
model_artifact_sha256 string, model_version string, device string,
inference_config struct<batch_size:int, beam_width:int, max_length:int,
  confidence_threshold:double, abstention_threshold:double, dtype:string>,
prediction_schema string, approval_reference string, accountable_owner_role string,
operator_role string, approved_at string, expires_at string,
protected_storage_required boolean, network_access_during_inference boolean,
external_ai_services_allowed boolean, github_actions_allowed boolean,
model_artifacts_preloaded boolean, training_allowed boolean, automated_decisions_allowed boolean
"""

ATTESTATION_FLAGS = {
    "protected_storage_mounted": True,
    "network_access_during_inference": False,
    "external_ai_services_used": False,
    "github_actions_used": False,
    "model_artifacts_preloaded": True,
    "predictions_contain_references": False,
    "automated_decisions_enabled": False,
}
ATTESTATION_FIELDS = [
    "schema_version", "execution_environment", "executed_at", "operator_role",
    "approval_reference", "inference_authorization_sha256", "model_version",
    "model_artifact_sha256", "inference_config_sha256", "evaluation_set_id", "manifest_sha256",
    "storage_control_sha256", "lifecycle_ledger_head_sha256", "predictions_sha256",
    *ATTESTATION_FLAGS,
]
ATTESTATION_SCHEMA = ", ".join(
    f"{name} " + ("int" if name == "schema_version" else "boolean" if name in ATTESTATION_FLAGS else "string")
    for name in ATTESTATION_FIELDS
)
PREDICTION_SCHEMA_NAME = "reference-free-v1"
ANNOTATION_GUIDELINE = "annotation-v2"


# --- rule helpers ---------------------------------------------------------------------------


def _exact(path: str, value: object) -> Rule:
    return Rule(path, F.col(path) == F.lit(value))


def _flags(prefix: str, names: list[str], value: bool) -> list[Rule]:
    return [_exact(f"{prefix}.{n}", value) for n in names]


def _days(path: str, maximum: int) -> Rule:
    return Rule(path, F.col(path).between(1, maximum))


def _parse(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """All fields of the document as columns, keeping the raw text and the keys of the row."""
    keys = [c for c in df.columns if c != raw]
    parsed = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    return df.select(*[F.col(k).alias(f"key_{k}") for k in keys], F.col(raw).alias("raw"), parsed.alias("d")).select(
        *[f"key_{k}" for k in keys], "raw", "d.*"
    )


def _checked(df: DataFrame, rules: list[Rule]) -> DataFrame:
    checked = validate(df, rules)
    keys = [c for c in checked.columns if c.startswith("key_")]
    return checked.select(*[F.col(k).alias(k.removeprefix("key_")) for k in keys], "errors")


def _validity(days: int, now: Column) -> list[Rule]:
    """An approval that is in force and not longer than `days`."""
    start = utc_timestamp(F.col("approved_at"))
    end = utc_timestamp(F.col("expires_at"))
    return [
        Rule("in_force", (start <= now) & (end > now)),
        Rule("validity_window", (end > start) & (end <= start + F.make_dt_interval(F.lit(days)))),
    ]


# --- engines -----------------------------------------------------------------------------------


def contract_rules() -> list[Rule]:
    c = F.col
    shares = [c("gold.validation_writer_ratio"), c("gold.test_writer_ratio")]
    inside = (shares[0] > 0) & (shares[0] < 1) & (shares[1] > 0) & (shares[1] < 1)
    return [
        _exact("schema_version", 1),
        Rule("pilot_id", c("pilot_id").rlike(vocab.PILOT_ID)),
        _exact("data_stage", "normalized_line_gold_candidate"),
        _exact("jurisdiction", "AU-VIC"),
        _exact("approval.privacy_review_status", "approved"),
        _exact("approval.educator_approval_status", "approved"),
        Rule("approval.privacy_review_reference", c("approval.privacy_review_reference").rlike(vocab.REFERENCE_ID)),
        Rule("approval.educator_approval_reference", c("approval.educator_approval_reference").rlike(vocab.REFERENCE_ID)),
        Rule("approval.accountable_owner_role", is_role(c("approval.accountable_owner_role"))),
        _exact("approval.consent.status", "active"),
        Rule(
            "approval.consent.authority",
            c("approval.consent.authority").isin(
                "participant", "parent_guardian", "participant_and_parent_guardian"
            ),
        ),
        _exact("approval.consent.collection_purpose", "handwriting_ocr_shadow_evaluation"),
        *_flags(
            "approval.consent",
            ["capacity_assessment_complete", "evaluation_allowed", "withdrawal_process_documented",
             "consent_records_separate_from_dataset"],
            True,
        ),
        *_flags("approval.consent", ["publication_allowed", "training_allowed"], False),
        Rule("approval.consent.verified_at", utc_timestamp(c("approval.consent.verified_at")) <= F.current_timestamp()),
        *_flags(
            "privacy",
            ["direct_identifiers_removed", "visual_identifier_review_complete", "image_metadata_removed"],
            True,
        ),
        _exact("privacy.filename_policy", "opaque_sample_id"),
        _exact("privacy.writer_id_policy", "opaque_pseudonym"),
        Rule("privacy.allowed_demographics", c("privacy.allowed_demographics") == F.array(F.lit("age_band"))),
        *_flags(
            "privacy",
            ["public_repository_allowed", "github_actions_allowed", "third_party_ai_upload_allowed",
             "automated_education_decisions_allowed"],
            False,
        ),
        _exact("storage.location_class", "approved_private"),
        *_flags(
            "storage",
            ["encryption_at_rest", "encryption_in_transit", "audit_logging", "backup_copies_in_retention_scope"],
            True,
        ),
        _exact("storage.access_control", "named_least_privilege"),
        _exact("storage.cross_border_disclosure", "none"),
        *[_days(f"storage.{n}", limit) for n, limit in RETENTION_LIMITS.items()],
        _exact("storage.deletion_method", "verified_secure_deletion_or_deidentification"),
        Rule("storage.deletion_verification_owner_role", is_role(c("storage.deletion_verification_owner_role"))),
        _exact("annotation.review_filename", "annotation_review.csv"),
        _exact("annotation.guideline_version", ANNOTATION_GUIDELINE),
        _exact("annotation.independent_annotators_per_sample", 2),
        *_flags(
            "annotation",
            ["blind_first_passes", "adjudication_required_on_disagreement",
             "adjudicator_must_be_independent", "crop_boundary_review_required"],
            True,
        ),
        *_flags("annotation", ["model_preannotations_allowed"], False),
        Rule("gold.minimum_distinct_writers", c("gold.minimum_distinct_writers") >= 3),
        Rule("gold.evaluation_set_version", c("gold.evaluation_set_version").rlike(vocab.EVALUATION_SET_VERSION)),
        Rule("gold.split_seed", c("gold.split_seed").between(0, 2**32 - 1)),
        Rule("gold.minimum_samples_per_writer", c("gold.minimum_samples_per_writer").between(1, 1000)),
        Rule("gold.writer_ratios", inside & (F.abs(shares[0] + shares[1] - 1.0) <= 1e-9)),
        *_flags("gold", ["writer_isolation_required", "split_locked_before_model_selection"], True),
        *_flags("gold", ["test_set_training_access_allowed", "gold_ready"], False),
    ]


def check_contracts(contracts: DataFrame, raw: str = "document") -> DataFrame:
    """Contract documents with their broken rules."""
    return _checked(_parse(contracts, raw, CONTRACT_SCHEMA), contract_rules())


def check_controls(controls: DataFrame, contracts: DataFrame, stores: DataFrame, now: Column) -> DataFrame:
    """Storage controls against the contract and the store of the same pilot.

    Controls and contracts have `pilot_id` and `document`; stores have `pilot_id` and what is really
    there: `root_identity_sha256`, `operator_uid` and `operator_gid`.
    """
    terms = contracts.select(
        F.col("pilot_id").alias("key_pilot_id"),
        F.from_json("document", CONTRACT_SCHEMA).alias("contract"),
    )
    there = stores.select(
        F.col("pilot_id").alias("key_pilot_id"), F.struct("root_identity_sha256", "operator_uid", "operator_gid").alias("store")
    )
    rows = _parse(controls, "document", CONTROL_SCHEMA).join(terms, "key_pilot_id", "left").join(there, "key_pilot_id", "left")
    c = F.col
    agreed = F.struct(*[c(f"contract.storage.{n}").alias(n) for n in RETENTION_LIMITS])
    rules = [
        Rule("fields", keys_match(c("raw"), CONTROL_FIELDS)),
        Rule("approved", (c("schema_version") == 1) & (c("status") == "approved")),
        Rule("storage_id", c("storage_id").rlike(vocab.STORAGE_ID)),
        Rule("pilot_id", (c("pilot_id") == c("key_pilot_id")) & c("pilot_id").rlike(vocab.PILOT_ID)),
        _exact("platform", "self_hosted_posix"),
        Rule(
            "root_identity_sha256",
            is_sha256(c("root_identity_sha256"), fold_case=False) & (c("root_identity_sha256") == c("store.root_identity_sha256")),
        ),
        Rule("execution_principal", (c("operator_uid") == c("store.operator_uid")) & (c("operator_gid") == c("store.operator_gid"))),
        Rule("accountable_owner_role", is_role(c("accountable_owner_role")) & (c("accountable_owner_role") == c("contract.approval.accountable_owner_role"))),
        Rule("operator_role", is_role(c("operator_role"))),
        Rule(
            "deletion_verification_owner_role",
            is_role(c("deletion_verification_owner_role"))
            & (c("deletion_verification_owner_role") == c("contract.storage.deletion_verification_owner_role")),
        ),
        *_flags(
            "controls",
            ["encryption_at_rest_attested", "encryption_in_transit_attested",
             "named_least_privilege_attested", "audit_logging_attested",
             "backup_copies_in_retention_scope", "network_isolation_attested"],
            True,
        ),
        _exact("controls.public_access_allowed", False),
        _exact("controls.cross_border_disclosure", "none"),
        Rule("retention", c("retention") == agreed),
        *[_days(f"retention.{n}", limit) for n, limit in RETENTION_LIMITS.items()],
        _exact("lifecycle_ledger_filename", "protected_lifecycle_events.jsonl"),
        *_validity(90, now),
    ]
    return _checked(rows, rules)


def check_authorizations(authorizations: DataFrame, bindings: DataFrame, now: Column) -> DataFrame:
    """Inference authorisations against the hashes and roles they must be bound to.

    Both have `pilot_id`; `bindings` has the expected `evaluation_set_id`, `manifest_sha256`,
    `storage_control_sha256`, `lifecycle_ledger_head_sha256`, `accountable_owner_role` and
    `operator_role`.
    """
    bound = [
        "evaluation_set_id", "manifest_sha256", "storage_control_sha256",
        "lifecycle_ledger_head_sha256", "accountable_owner_role", "operator_role",
    ]
    expected = bindings.select(F.col("pilot_id").alias("key_pilot_id"), F.struct(*bound).alias("want"))
    rows = _parse(authorizations, "document", AUTHORIZATION_SCHEMA).join(expected, "key_pilot_id", "left")
    c = F.col
    config = "inference_config"
    dtype = F.when(c("device") == "cuda", "float16").otherwise("float32")
    rules = [
        Rule("fields", keys_match(c("raw"), AUTHORIZATION_FIELDS)),
        Rule("approved", (c("schema_version") == 1) & (c("status") == "approved")),
        _exact("execution_environment", "approved_self_hosted"),
        *[Rule(n, c(n) == c(f"want.{n}")) for n in bound],
        Rule("roles", is_role(c("accountable_owner_role")) & is_role(c("operator_role"))),
        Rule("model_artifact_sha256", is_sha256(c("model_artifact_sha256"), fold_case=False)),
        Rule("model_version", c("model_version").rlike(r"^[A-Za-z0-9_.-]+\z")),
        Rule("device", c("device").isin("cpu", "cuda")),
        *[Rule(f"{config}.{n}", c(f"{config}.{n}") >= 1) for n in ("batch_size", "beam_width", "max_length")],
        *[
            Rule(
                f"{config}.{n}",
                c(f"{config}.{n}").isNotNull() & optional_number(c(f"{config}.{n}"), 0.0, 1.0),
            )
            for n in ("confidence_threshold", "abstention_threshold")
        ],
        Rule("threshold_order", c(f"{config}.abstention_threshold") <= c(f"{config}.confidence_threshold")),
        Rule(f"{config}.dtype", c(f"{config}.dtype") == dtype),
        _exact("prediction_schema", PREDICTION_SCHEMA_NAME),
        Rule("approval_reference", c("approval_reference").rlike(vocab.REFERENCE_ID)),
        *[_exact(n, v) for n, v in AUTHORIZATION_FLAGS.items()],
        *_validity(30, now),
    ]
    return _checked(rows, rules)


def check_attestations(attestations: DataFrame, bindings: DataFrame, now: Column) -> DataFrame:
    """Execution attestations against the hashes, model and role of the run."""
    bound = [
        "model_version", "evaluation_set_id", "manifest_sha256", "storage_control_sha256",
        "lifecycle_ledger_head_sha256", "predictions_sha256", "operator_role",
    ]
    expected = bindings.select(F.col("pilot_id").alias("key_pilot_id"), F.struct(*bound).alias("want"))
    rows = _parse(attestations, "document", ATTESTATION_SCHEMA).join(expected, "key_pilot_id", "left")
    c = F.col
    digests = ["inference_authorization_sha256", "model_artifact_sha256", "inference_config_sha256"]
    rules = [
        Rule("fields", keys_match(c("raw"), ATTESTATION_FIELDS)),
        _exact("schema_version", 1),
        _exact("execution_environment", "approved_self_hosted"),
        *[Rule(n, c(n) == c(f"want.{n}")) for n in bound],
        *[Rule(n, is_sha256(c(n), fold_case=False)) for n in digests],
        Rule("approval_reference", c("approval_reference").rlike(vocab.REFERENCE_ID)),
        Rule("role", is_role(c("operator_role"))),
        Rule("executed_at", utc_timestamp(c("executed_at")) <= now),
        *[_exact(n, v) for n, v in ATTESTATION_FLAGS.items()],
    ]
    return _checked(rows, rules)


def check_provenance(runs: DataFrame, attested: DataFrame) -> DataFrame:
    """Run metadata against the attestation of the same run: identity, counts, hashes, claims.

    Both have `run_id`, `split`, `num_records`, `manifest_sha256`, `model_version`,
    `model_artifact_sha256` and `predictions_sha256`; runs add `status` and the privacy flags,
    attestations add `num_writers`, `network_access_allowed` and `gold_benchmark`.
    """
    bound = [
        "split", "num_records", "manifest_sha256", "model_version", "model_artifact_sha256",
        "predictions_sha256",
    ]
    right = attested.select(
        "run_id", "num_writers", "network_access_allowed", "gold_benchmark",
        F.struct(*bound).alias("want"),
    )
    c = F.col
    rules = [
        Rule("attested", c("want").isNotNull()),
        _exact("status", "complete"),
        *[Rule(n, c(n).eqNullSafe(c(f"want.{n}"))) for n in bound],
        Rule("split_known", c("split").isin("validation", "test")),
        *[
            Rule(f"{n}_format", is_sha256(c(n), fold_case=False))
            for n in ("manifest_sha256", "model_artifact_sha256", "predictions_sha256")
        ],
        Rule("num_writers", c("num_writers") >= 1),
        _exact("writer_ids_exported", False),
        _exact("source_images_exported", False),
        _exact("network_access_allowed", False),
        _exact("gold_benchmark", False),
    ]
    return validate(runs.join(right, "run_id", "left"), rules).select("run_id", "errors")


def comparable_runs(first: DataFrame, second: DataFrame, fields: list[str]) -> DataFrame:
    """Fields in which two one-row run descriptions differ; must be empty."""
    described = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    pair = beside(first.select(described.alias("a")), second.select(described.alias("b")))
    entries = [
        F.when(
            ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")),
            F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("first"), F.col(f"b.{f}").alias("second")),
        )
        for f in fields
    ]
    return pair.select(F.explode(F.array_compact(F.array(*entries))).alias("d")).select("d.*")


def preflight(gates: DataFrame) -> DataFrame:
    """Ready when all three gates hold, else the sorted blockers.

    `gates` has one row per pilot with `frozen_evaluation`, `sealed_local_model` and
    `inference_authorization`. The last one cannot be judged while another one fails.
    """
    frozen, sealed = F.col("frozen_evaluation"), F.col("sealed_local_model")
    authorised = F.col("inference_authorization")
    blockers = F.array(
        F.when(~frozen, "frozen_evaluation_gate_failed"),
        F.when(~sealed, "sealed_local_model_gate_failed"),
        F.when(~(frozen & sealed), "inference_authorization_not_evaluable").when(
            ~authorised, "inference_authorization_gate_failed"
        ),
    )
    ready = frozen & sealed & authorised
    return gates.select(
        "pilot_id",
        ready.alias("ready"),
        F.when(ready, "ready_for_owner_authorized_shadow_inference")
        .otherwise("blocked_external_evidence_required")
        .alias("status"),
        F.array_sort(F.array_compact(blockers)).alias("blockers"),
    )


def leaked_values(report_strings: DataFrame, protected: DataFrame, columns: list[str]) -> DataFrame:
    """Strings of a report that equal a protected value; must be empty.

    `report_strings` has `value`. Both sides are distinct before they meet.
    """
    values = F.explode(F.array(*[F.col(c) for c in columns]))
    sensitive = protected.select(values.alias("value")).filter("value <> ''").distinct()
    return report_strings.distinct().join(sensitive, "value", "left_semi")


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or changed between two inventories; must be empty."""
    left = before.select("path", F.col("sha256").alias("before_sha256"))
    right = after.select("path", F.col("sha256").alias("after_sha256"))
    return left.join(right, "path", "full_outer").filter(
        ~F.col("before_sha256").eqNullSafe(F.col("after_sha256"))
    )


def attestation_rows(authorizations: DataFrame, executed_at: Column) -> DataFrame:
    """One attestation per authorised run: every field of the allow-list, bound by hashes.

    `authorizations` has `pilot_id`, the authorisation's `document` and `predictions_sha256`. What
    the run was allowed to use is what it attests; the configuration's digest is over its keys in
    sorted order.
    """
    parsed = authorizations.withColumn("_auth", F.from_json("document", AUTHORIZATION_SCHEMA))
    auth = F.col("_auth")
    config = [f.name for f in parsed.schema["_auth"].dataType["inference_config"].dataType.fields]
    values = {
        "schema_version": F.lit(1),
        "execution_environment": F.lit("approved_self_hosted"),
        "executed_at": executed_at,
        "inference_authorization_sha256": F.sha2("document", 256),
        "inference_config_sha256": canonical_sha256(**{n: auth["inference_config"][n] for n in config}),
        "predictions_sha256": F.col("predictions_sha256"),
        **{n: F.lit(v) for n, v in ATTESTATION_FLAGS.items()},
    }
    return parsed.select("pilot_id", *[(values[n] if n in values else auth[n]).alias(n) for n in ATTESTATION_FIELDS])


# --- the contract's rules as rows ------------------------------------------------------------------


def contract_rule_rows() -> list[R.Row]:
    """The rules of `contract_rules` for a rule table (`rule_table.check_documents`)."""
    def flags(prefix: str, value: bool, *names: str) -> list[R.Row]:
        return [R.Row(f"{prefix}.{n}", str(value).lower()) for n in names]

    def texts(prefix: str, **values: str) -> list[R.Row]:
        return [R.Row(f"{prefix}{n}", "text", v) for n, v in values.items()]

    role = rf"^(?!(?:{"|".join(vocab.PLACEHOLDER_ROLES)})\z){vocab.ROLE[1:]}"
    ratios = ["gold.validation_writer_ratio", "gold.test_writer_ratio"]
    return [
        R.Row("schema_version", "number", low=1), R.Row("pilot_id", "pattern", vocab.PILOT_ID),
        *texts("", data_stage="normalized_line_gold_candidate", jurisdiction="AU-VIC"),
        *texts("approval.", privacy_review_status="approved", educator_approval_status="approved"),
        R.Row("approval.privacy_review_reference", "pattern", vocab.REFERENCE_ID),
        R.Row("approval.educator_approval_reference", "pattern", vocab.REFERENCE_ID),
        R.Row("approval.accountable_owner_role", "pattern", role),
        *texts("approval.consent.", status="active", collection_purpose="handwriting_ocr_shadow_evaluation"),
        R.Row("approval.consent.authority", "one_of", options=["participant", "parent_guardian", "participant_and_parent_guardian"]),
        *flags("approval.consent", True, "capacity_assessment_complete", "evaluation_allowed", "withdrawal_process_documented",
               "consent_records_separate_from_dataset"),
        *flags("approval.consent", False, "publication_allowed", "training_allowed"),
        R.Row("approval.consent.verified_at", "past"),
        *flags("privacy", True, "direct_identifiers_removed", "visual_identifier_review_complete", "image_metadata_removed"),
        *texts("privacy.", filename_policy="opaque_sample_id", writer_id_policy="opaque_pseudonym"),
        R.Row("privacy.allowed_demographics", "json", '["age_band"]'),
        *flags("privacy", False, "public_repository_allowed", "github_actions_allowed", "third_party_ai_upload_allowed",
               "automated_education_decisions_allowed"),
        *texts("storage.", location_class="approved_private", access_control="named_least_privilege", cross_border_disclosure="none",
               deletion_method="verified_secure_deletion_or_deidentification"),
        *flags("storage", True, "encryption_at_rest", "encryption_in_transit", "audit_logging", "backup_copies_in_retention_scope"),
        *[R.Row(f"storage.{n}", "whole", low=1, high=limit) for n, limit in RETENTION_LIMITS.items()],
        R.Row("storage.deletion_verification_owner_role", "pattern", role),
        *texts("annotation.", review_filename="annotation_review.csv", guideline_version=ANNOTATION_GUIDELINE),
        R.Row("annotation.independent_annotators_per_sample", "number", low=2),
        *flags("annotation", True, "blind_first_passes", "adjudication_required_on_disagreement", "adjudicator_must_be_independent",
               "crop_boundary_review_required"),
        *flags("annotation", False, "model_preannotations_allowed"),
        R.Row("gold.minimum_distinct_writers", "whole", low=3, high=float(2**53)),
        R.Row("gold.evaluation_set_version", "pattern", vocab.EVALUATION_SET_VERSION),
        R.Row("gold.split_seed", "whole", low=0, high=2**32 - 1), R.Row("gold.minimum_samples_per_writer", "whole", low=1, high=1000),
        *[R.Row(r, "inside", low=0, high=1, code="gold.writer_ratios") for r in ratios],
        R.Row("gold.writer_ratios", "sum", low=1, options=ratios),
        *flags("gold", True, "writer_isolation_required", "split_locked_before_model_selection"),
        *flags("gold", False, "test_set_training_access_allowed", "gold_ready"),
    ]
