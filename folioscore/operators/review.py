"""Active learning, review queues and review statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscore.functions.edits import ratio
from folioscore.operators.ordering import neighbours

# Fixed weights of the priority score.
UNCERTAINTY_WEIGHT, FREQUENCY_WEIGHT, IMPACT_WEIGHT, COST_WEIGHT = 0.4, 0.2, 0.3, 0.1
AUTO_ACCEPT = 0.95
QUEUE_SIZE = 1000
DEFAULT_FREQUENCY = 0.5


def with_frequency(items: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Failure frequency of each item's category; unknown categories get the default.

    The categories are few, so Spark broadcasts them by their size; beyond that its skew join
    splits a popular category.
    """
    category = F.coalesce("failure_category", F.lit("unknown"))
    lookup = frequencies.select(F.col("category").alias("_category"), "frequency")
    return (
        items.withColumn("_category", category)
        .join(lookup, "_category", "left")
        .withColumn("frequency", F.coalesce("frequency", F.lit(DEFAULT_FREQUENCY)))
        .drop("_category")
    )


def priority_score() -> Column:
    """Weighted uncertainty, failure frequency, correction impact and labelling cost."""
    impact = F.least(F.lit(1.0), F.col("correction_impact") / 60.0)
    cheapness = 1.0 / F.greatest(F.lit(1.0), F.col("label_seconds") / 10.0)
    return (
        UNCERTAINTY_WEIGHT * (1.0 - F.col("confidence"))
        + FREQUENCY_WEIGHT * F.col("frequency")
        + IMPACT_WEIGHT * impact
        + COST_WEIGHT * cheapness
    )


def score_items(items: DataFrame, frequencies: DataFrame) -> DataFrame:
    return with_frequency(items, frequencies).withColumn("priority_score", priority_score())


def annotation_queue(scored: DataFrame, size: int = QUEUE_SIZE) -> DataFrame:
    """The `size` items of highest priority among those not accepted automatically."""
    uncertain = scored.filter(F.col("confidence") < AUTO_ACCEPT)
    return uncertain.orderBy(F.col("priority_score").desc(), "item_id").limit(size)


def next_batch(queue: DataFrame, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first items of a queue, and the queue without them."""
    batch = queue.orderBy(F.col("priority_score").desc(), "item_id").limit(size)
    return batch, queue.join(batch.select("item_id"), "item_id", "left_anti")


def failure_frequencies(corrections: DataFrame) -> DataFrame:
    """Share of each failure category among the corrections."""
    category = F.coalesce("failure_category", F.lit("unknown")).alias("category")
    counts = corrections.groupBy(category).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("category", ratio(F.col("n"), total).alias("frequency"))


def merge_frequencies(old: DataFrame, new: DataFrame) -> DataFrame:
    """New shares replace old ones; categories without a correction keep theirs."""
    left = old.select("category", F.col("frequency").alias("_old"))
    right = new.select("category", F.col("frequency").alias("_new"))
    return left.join(right, "category", "full_outer").select(
        "category", F.coalesce("_new", "_old").alias("frequency")
    )


def top_categories(frequencies: DataFrame, k: int = 10) -> DataFrame:
    return frequencies.orderBy(F.col("frequency").desc(), "category").limit(k)


def queue_statistics(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count("*").alias("queue_size"),
        F.avg("priority_score").alias("avg_priority"),
        F.max("priority_score").alias("max_priority"),
        F.avg("confidence").alias("avg_confidence"),
    )


def review_queue(blocks: DataFrame, mode: str = "uncertainty", limit: int = 100) -> DataFrame:
    """Blocks that need a review, ordered by the mode's key."""
    waiting = blocks.filter("is_uncertain")
    keys = {
        "uncertainty": F.col("confidence").asc(),
        "impact": F.length("text").desc(),
        "active_learning": ((1 - F.col("confidence")) * F.length("text")).desc(),
    }
    if mode not in keys:
        raise ValueError(f"unknown review mode: {mode}")
    return waiting.orderBy(keys[mode], "page_id", "reading_order").limit(limit)


def review_context(blocks: DataFrame, band: int = 4096) -> DataFrame:
    """Each block with the text before and after it on its page."""
    return neighbours(
        blocks,
        ["page_id"],
        [F.col("reading_order")],
        F.floor(F.col("reading_order") / band),
        previous={"context_before": "text"},
        following={"context_after": "text"},
    )


def review_statistics(reviews: DataFrame, *by: str) -> DataFrame:
    """Volume, pace and agreement of the reviews of a job."""
    seconds = F.col("pass_1_seconds") + F.col("pass_2_seconds") + F.col("adjudication_seconds")
    return reviews.groupBy(*by).agg(
        F.count("*").alias("total_reviewed"),
        F.avg(seconds).alias("avg_seconds"),
        ratio(F.count_if(F.col("status") == "agreed"), F.count("*")).alias("agreement_rate"),
        ratio(F.count_if(F.col("status") == "adjudicated"), F.count("*")).alias("adjudication_rate"),
        ratio(F.count("*") * 3600, F.sum(seconds)).alias("pages_per_hour"),
    )


def page_of_results(results: DataFrame, order_by: list[str], page: int, per_page: int) -> DataFrame:
    """One page of an ordered result, pages counted from 1."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    return results.orderBy(*order_by).offset((page - 1) * per_page).limit(per_page)
