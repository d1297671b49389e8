"""Digests of whole tables and of file sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioscore.functions.digests import canonical_json

_LANES = 16


def row_fingerprint_sums(digest: Column) -> list[Column]:
    """Sixteen sums of 16-bit slices of a SHA-256 hex digest."""
    return [
        F.sum(F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long")).alias(f"_lane_{i}")
        for i in range(_LANES)
    ]


def table_fingerprint(df: DataFrame, row_text: Column, *by: str) -> DataFrame:
    """Order-free digest of a multiset of rows, for any number of rows.

    Row digests are added up lane by lane, so partial sums combine before the shuffle and no
    row order is needed. Equal row multisets give equal digests; it detects drift and is not
    the sequential digest of `ordered_digest`.
    """
    sums = df.withColumn("_d", F.sha2(row_text, 256)).groupBy(*by).agg(
        F.count("*").alias("n_rows"), *row_fingerprint_sums(F.col("_d"))
    )
    lanes = F.concat_ws(":", F.col("n_rows"), *[F.col(f"_lane_{i}") for i in range(_LANES)])
    return sums.select(*by, "n_rows", F.sha2(lanes, 256).alias("fingerprint"))


def evaluation_line(reference: str = "reference") -> Column:
    """Identity, reference and slices of a record as canonical JSON, without the prediction."""
    return canonical_json(
        sample_id=F.col("sample_id"),
        source_sha256=F.col("source_sha256"),
        reference=F.col(reference),
        slices=F.col("slices"),
    )


def evaluation_set_fingerprint(df: DataFrame) -> DataFrame:
    return table_fingerprint(df, evaluation_line())


def _hashed_in_order(batches):
    import hashlib

    import pyarrow as pa

    digest, n = hashlib.sha256(), 0
    for batch in batches:
        for line in batch.column(0).to_pylist():
            digest.update(line.encode() + b"\n")
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["n_rows", "sha256"])


def ordered_digest(df: DataFrame, order_by: Sequence[str], line: Column) -> DataFrame:
    """SHA-256 over the lines in key order, each ended by a newline: the published digest.

    The hash is sequential by definition, so one task reads the sorted lines, for any number of
    rows: the sort spills, and the hash holds one batch at a time. Where drift is all that
    matters, `table_fingerprint` is spread over all tasks.
    """
    lines = df.select(*order_by, line.alias("_line")).repartition(1).sortWithinPartitions(*order_by, "_line")
    hashed = lines.select("_line").mapInArrow(_hashed_in_order, "n_rows long, sha256 string")
    # One row for an empty table as well.
    return hashed.agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("sha256"),
    )


def evaluation_set_sha256(df: DataFrame) -> DataFrame:
    """The published identity of an evaluation set, rows ordered by sample id."""
    return ordered_digest(df, ["sample_id"], evaluation_line())


def inventory_digest(files: DataFrame) -> DataFrame:
    """One digest of a model folder: path, hash and size of each file in path order."""
    line = canonical_json(
        path=F.col("path"), sha256=F.col("sha256"), size_bytes=F.col("size_bytes")
    )
    digest = ordered_digest(files, ["path"], line)
    totals = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)))
    return digest.select(
        F.col("sha256").alias("model_artifact_sha256"),
        F.col("n_rows").alias("num_files"),
        totals.scalar().alias("total_bytes"),
    )


def table_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number differs between two tables; empty means equal as multisets.

    One aggregation over both sides, with `surplus` > 0 for rows the left has more of.
    """
    columns = left.columns
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    return (
        signed.groupBy(*columns)
        .agg(F.sum("_sign").alias("surplus"))
        .filter("surplus <> 0")
    )
