"""Pluggable batch prediction over a manifest, resumable and checked against it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from folioscore.functions.digests import packed_texts, unpacked_texts
from folioscore.operators.rules import InvalidRows


@dataclass(frozen=True)
class Prediction:
    """One answer; without a latency of its own it gets its share of the batch's measured time."""

    raw_text: str
    confidence: float
    latency_ms: float | None
    is_uncertain: bool
    is_unreadable: bool
    model_version: str


class Predictor(Protocol):
    """A model: takes the loaded inputs of a batch, returns one prediction for each."""

    def predict_batch(self, inputs: list[Any]) -> list[Prediction]: ...


PREDICTION_COLUMNS = (
    "raw_text string, confidence double, latency_ms double, is_uncertain boolean, "
    "is_unreadable boolean, model_version string, batch string"
)


def predict(
    inputs: DataFrame,
    build: Callable[[], Predictor],
    payload: str = "content",
    load: Callable[[Any], Any] | None = None,
    batch_size: int = 8,
) -> DataFrame:
    """Runs a model over the rows; `build` is called once per task, `load` once per row.

    All columns but the payload pass through, so the answers need no join back to their rows.
    `batch` names the model call that an answer came from. An empty table needs no model.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    kept = [c for c in inputs.columns if c != payload]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        read = load or (lambda value: value)
        for frame in batches:
            model = model or build()
            values, results, latency, calls = frame[payload].tolist(), [], [], []
            for start in range(0, len(values), batch_size):
                part = [read(v) for v in values[start : start + batch_size]]
                began = time.perf_counter()
                answers = model.predict_batch(part)
                spent = max((time.perf_counter() - began) * 1000, 1e-6) / len(part)
                if len(answers) != len(part):
                    raise RuntimeError("the model returned a different number of results")
                results.extend(answers)
                latency.extend(spent if a.latency_ms is None else a.latency_ms for a in answers)
                calls.extend([uuid.uuid4().hex] * len(part))
            # One frame per Arrow batch, however small the model's own batches are.
            out = pd.DataFrame({f.name: pd.Series([getattr(r, f.name) for r in results], dtype=object) for f in fields(Prediction)})
            out["latency_ms"], out["batch"] = latency, pd.Series(calls, dtype=object)
            bounded = out["confidence"].astype(float).between(0, 1) & (out["latency_ms"] >= 0)
            if not (bounded & (out["model_version"].str.strip() != "")).all():
                raise ValueError("the model returned an invalid prediction")
            yield pd.concat([frame[kept].reset_index(drop=True), out], axis=1)

    schema = StructType([inputs.schema[c] for c in kept] + StructType.fromDDL(PREDICTION_COLUMNS).fields)
    return inputs.mapInPandas(run, schema)


def transcribe_pages(
    pages: DataFrame, build: Callable[[], Callable[[Any], str]], payload: str = "content"
) -> DataFrame:
    """Runs a page model; gives its raw output text per page, to be parsed natively."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for batch in batches:
            yield pd.DataFrame(
                {"page_id": batch["page_id"], "raw_output": [model(v) for v in batch[payload]]}
            )

    return pages.select("page_id", payload).mapInPandas(run, "page_id bigint, raw_output string")


def prediction_rows(scored: DataFrame) -> DataFrame:
    """Public prediction rows: identity, texts, flags and split, without writer or image path."""
    return scored.select(
        F.lit(1).alias("schema_version"),
        "sample_id", "source_sha256", "reference",
        F.col("raw_text").alias("prediction"),
        "confidence", "slices", "latency_ms", "model_version", "is_uncertain", "is_unreadable",
        "split",
    )


def reference_free_rows(rows: DataFrame) -> DataFrame:
    """Exactly the five columns that may leave the protected store."""
    return rows.select("sample_id", "source_sha256", "prediction", "confidence", "latency_ms")


def remaining(selected: DataFrame, completed: DataFrame) -> DataFrame:
    """Selected samples without a prediction yet."""
    return selected.join(completed.select("sample_id"), "sample_id", "left_anti")


def partial_mismatches(partial: DataFrame, manifest: DataFrame) -> DataFrame:
    """Partial predictions outside the manifest, or with another hash or reference."""
    want = manifest.select(
        "sample_id", F.col("source_sha256").alias("want_sha256"), F.col("reference").alias("want_reference")
    )
    joined = partial.join(want, "sample_id", "left")
    problem = F.when(F.col("want_sha256").isNull(), "unknown_sample").when(
        (F.col("source_sha256") != F.col("want_sha256")) | (F.col("reference") != F.col("want_reference")),
        "identity_mismatch",
    )
    return joined.select("sample_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def join_gold(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Reference-free predictions with their gold reference and slices."""
    return predictions.join(gold.select("sample_id", "source_sha256", "reference", "slices"),
                            ["sample_id", "source_sha256"])


def gold_problems(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Unknown, duplicate, missing and mismatching predictions, one row per sample and problem.

    One shuffle on the sample id: both sides are counted per id and then compared.
    """
    left = predictions.groupBy("sample_id").agg(
        F.count("*").alias("n"),
        F.min("source_sha256").alias("lo"),
        F.max("source_sha256").alias("hi"),
    )
    right = gold.select("sample_id", F.col("source_sha256").alias("want"))
    both = left.join(right, "sample_id", "full_outer")
    known, predicted = F.col("want").isNotNull(), F.col("n").isNotNull()
    problems = F.array_compact(
        F.array(
            F.when(predicted & ~known, "unknown"),
            F.when(F.col("n") > 1, "duplicate"),
            F.when(known & ~predicted, "missing"),
            F.when(
                known & predicted & ((F.col("lo") != F.col("want")) | (F.col("hi") != F.col("want"))),
                "hash_mismatch",
            ),
        )
    )
    return both.select("sample_id", F.explode(problems).alias("problem"))


def resume(selected: DataFrame, completed: DataFrame) -> DataFrame:
    """Work left after checking that the completed part belongs to this manifest.

    Digests of the rows meet first; only if some differ, or there are none of them, do the rows.
    """
    left, right = (t.select(*_identity()) for t in (completed, selected))
    met = left.join(right.withColumnRenamed("digest", "want"), "key", "left")
    if not met.filter(~F.coalesce(F.col("digest") == F.col("want"), F.lit(False))).isEmpty():
        bad = partial_mismatches(completed, selected).head()
        if bad is not None:
            raise InvalidRows(f"partial predictions do not match the manifest: {bad['problem']}")
    return unpacked_texts(remaining(packed_texts(selected), packed_texts(completed.select("sample_id"))), selected)


def _identity() -> list[Column]:
    """A sample's key and half a SHA-256 of its hash and reference; null where one of them is."""
    digest = F.sha2(F.concat("source_sha256", F.sha2("reference", 256)), 256)
    return [
        F.when(F.col("sample_id").isNotNull(), F.xxhash64("sample_id")).alias("key"),
        F.substring(F.unhex(digest), 1, 16).alias("digest"),
    ]


def reusable_runs(requested: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests that a finished run answers: manifest, split, model, output hash and count agree."""
    bound = ["manifest_sha256", "split", "model_version", "output_sha256", "num_records"]
    done = runs.filter(F.col("status") == "complete").select(*bound).distinct()
    done = done.withColumn("reusable", F.lit(True))
    return requested.join(done, bound, "left").withColumn(
        "reusable", F.coalesce("reusable", F.lit(False))
    )
