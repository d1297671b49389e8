"""Vocabularies, patterns, thresholds and weights, as plain text."""

# --- splits, sample types -------------------------------------------------------------
SPLITS = ["train", "validation", "test"]
SAMPLE_TYPES = ["line", "page"]

# --- page regions, quality issues, routes ---------------------------------------------
REGION_TYPES = [
    "student_handwriting", "printed_text", "crossed_out", "margin_insertion", "header",
    "page_number", "diagram", "blank", "teacher_annotation",
]
QUALITY_PENALTIES = {
    "blur": 0.3,
    "skew": 0.15,
    "underexposed": 0.2,
    "overexposed": 0.2,
    "low_resolution": 0.25,
    "glare": 0.2,
    "shadow": 0.15,
    "incomplete_crop": 0.1,
    "blank_page": 1.0,
}

# --- failure categories ----------------------------------------------------------------
FAILURE_CATEGORIES = [
    "faint_pencil", "severe_perspective", "joined_cursive", "touching_lines", "crossed_out",
    "margin_insertion", "mixed_print_handwriting", "teacher_annotation", "missing_page_edge",
    "repeated_page", "blank_page", "diagram_non_text", "low_contrast", "heavy_blur",
    "jpeg_artifacts", "unknown",
]

# --- protected labels and reviews --------------------------------------------------------
AGE_BANDS = ["5-7", "8-10", "11-13", "14-17"]
DOCUMENT_TYPES = ["essay", "short_answer", "worksheet"]
CAPTURE_TYPES = ["camera", "scan"]
PROTECTED_SLICES = [
    "age_band_5_7", "age_band_8_10", "age_band_11_13", "age_band_14_17", "camera",
    "crossed_out", "essay", "faint_pencil", "heavy_blur", "joined_cursive",
    "margin_insertion", "missing_page_edge", "mixed_content", "perspective", "scan",
    "short_answer", "student_handwriting", "teacher_annotation", "touching_lines", "worksheet",
]
ADJUDICATION_REASONS = [
    "crop_boundary_disagreement", "reading_order_disagreement", "region_type_disagreement",
    "transcription_disagreement", "uncertain_character",
]

# --- lifecycle ledger ----------------------------------------------------------------------
WITHDRAWAL_REQUESTED = "consent_withdrawal_requested"
PRIMARY_DELETED = "primary_deletion_verified"
BACKUP_DELETED = "backup_deletion_verified"
WITHDRAWAL_CLOSED = "withdrawal_closed"
EVENT_TYPES = [WITHDRAWAL_REQUESTED, PRIMARY_DELETED, BACKUP_DELETED, WITHDRAWAL_CLOSED]
ZERO_SHA256 = "0" * 64

# --- patterns --------------------------------------------------------------------------------
# They end with \z: a dollar would also match before a final line break.
SHA256_HEX = r"^[0-9a-f]{64}\z"
MD5_HEX = r"^[0-9a-f]{32}\z"
SAMPLE_FILENAME = r"^sample-[0-9a-f]{16,64}\.(jpeg|jpg|pgm|png)\z"
WRITER_ID = r"^writer-[0-9a-f]{16,64}\z"
ANNOTATOR_ID = r"^annotator-[0-9a-f]{12,64}\z"
PILOT_ID = r"^pilot-[a-z0-9][a-z0-9-]{7,63}\z"
STORAGE_ID = r"^storage-[a-z0-9][a-z0-9-]{7,63}\z"
EVENT_ID = r"^evt-[0-9a-f]{32}\z"
ROLE = r"^[a-z][a-z0-9_]{7,63}\z"
PLACEHOLDER_ROLES = ["pending", "replace_me"]
REFERENCE_ID = r"^[a-z][a-z0-9_-]{7,127}\z"
EVALUATION_SET_ID = r"^pilot-[a-z0-9-]{8,64}-v[1-9][0-9]{0,5}\z"
EVALUATION_SET_VERSION = r"^v[1-9][0-9]{0,5}\z"
CORPUS_INDEX_LINE = r"^([0-9]{4}-[0-9]{3}),([0-9]+)\s+(.*)\z"
ZONED_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})\z"

# --- columns fixed by the data model --------------------------------------------------------
EVENT_COLUMNS = [
    "schema_version", "sequence", "event_id", "event_type", "occurred_at", "recorded_at",
    "pilot_id", "subject_token_sha256", "scope_sha256", "actor_role", "evidence_reference",
    "evidence_sha256", "previous_event_sha256", "event_sha256",
]
REFERENCE_FREE_REQUIRED = ["sample_id", "source_sha256", "prediction"]
REFERENCE_FREE_OPTIONAL = ["confidence", "latency_ms", "cost_per_page_usd"]

# --- release gate -----------------------------------------------------------------------------
RELEASE_GATE = {
    "min_cer_improvement": 0.005,
    "max_slice_regression": 0.02,
    "min_valid_output_rate": 1.0,
    "max_p95_latency_ms": 5000.0,
    "max_false_confidence_rate": 0.05,
    "max_cost_per_page_usd": 0.05,
}
