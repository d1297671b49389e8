"""From label files to a validated, split and written manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscore.operators.manifest import (
    DatasetIdentity, assign_writer_split, build_manifest, leaking_writers, manifest_metadata,
    require_writer_sizes,
)
from folioscore.operators.rules import (
    dataset_identity_rules, duplicate_keys, manifest_record_rules, require_empty, require_valid,
    validate,
)
from folioscore.session import staged
from folioscore.sources.scans import file_hashes, label_rows
from folioscore.sources.sinks import write_manifest


def make_manifest(
    spark: SparkSession,
    labels_path: str,
    images_path: str,
    identity: DatasetIdentity,
    output: str,
    seed: int = 42,
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
    min_samples: int = 3,
) -> DataFrame:
    """Reads, hashes, checks, splits and writes a dataset; returns the metadata row."""
    require_valid(validate(identity.row(spark), dataset_identity_rules()))
    files = file_hashes(spark, images_path).selectExpr("filename", "sha256 AS source_sha256")
    labels = label_rows(spark, labels_path).selectExpr(
        "filename", "text", "writer_id", "array_join(slices, '|') AS slices"
    )
    require_empty(duplicate_keys(labels, "filename"), "a filename occurs more than once")
    # Hashing the images is the costly step, so it is written once and read by every check.
    records = staged(build_manifest(labels, files, identity), "manifest")
    require_writer_sizes(records, min_samples)
    split = require_valid(
        validate(assign_writer_split(records, seed, ratios), manifest_record_rules())
    )
    require_empty(leaking_writers(split), "a writer is in more than one split")
    write_manifest(split, f"{output}/manifest")
    metadata = manifest_metadata(split, seed, min_samples)
    metadata.write.mode("overwrite").json(f"{output}/metadata")
    return metadata
