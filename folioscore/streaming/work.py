"""Streams of work: predictions, the annotation queue, corrections and the consent gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from folioscore.operators.inference import Predictor, predict, prediction_rows
from folioscore.operators.review import annotation_queue
from folioscore.streaming.tables import KeptTable, append_available, run_available


def predict_stream(
    manifest: DataFrame, build: Callable[[], Predictor], payload: str, path: str
) -> DataFrame:
    """Scores each new manifest row once; stopping and starting again continues."""
    spark = manifest.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = prediction_rows(predict(batch, build, payload))
        scored.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    run_available(manifest, write, f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows").drop("batch")


def live_queue(items: DataFrame, kept: KeptTable, size: int, checkpoint: str) -> DataFrame:
    """Keeps the top items of a stream: each batch meets the stored queue and is cut again."""
    columns = [f.split()[0] for f in kept.schema.split(",")]

    def merge(batch: DataFrame, batch_id: int) -> None:
        both = kept.read(batch_id).unionByName(batch.select(*columns))
        kept.replace(annotation_queue(both, size), batch_id)

    run_available(items, merge, checkpoint)
    return kept.read()


def correction_counts(corrections: DataFrame, path: str, delay: str = "1 day") -> DataFrame:
    """Corrections per failure category; a repeated item within the delay counts once."""
    once = corrections.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["item_id"])
    category = F.coalesce("failure_category", F.lit("unknown")).alias("category")
    rows = append_available(once.select(category, "item_id", "ts"), path)
    return rows.groupBy("category").agg(F.count("*").alias("n"))
