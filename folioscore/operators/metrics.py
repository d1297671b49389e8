"""Transcription metrics as ratios of sums, so that every one combines before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.functions.edits import (
    ratio, row_cer, with_char_features, with_ned, with_row_features, with_word_features,
)
from folioscore.functions.text import normalize_slices
from folioscore.operators.onerow import beside
from folioscore.operators.ordering import running_sums

ALL = "__all__"
HIGH_CONFIDENCE = 0.9
ABSTAIN_BELOW = 0.5


# --- single metrics ----------------------------------------------------------------------


def _or_all_wrong(value: Column) -> Column:
    """An empty input counts as fully wrong, as a metric over no rows is undefined."""
    return F.when(F.count("*") == 0, F.lit(1.0)).otherwise(value)


def character_error_rate(df: DataFrame, *by: str) -> DataFrame:
    totals = ratio(F.sum("char_edits"), F.sum("ref_chars"))
    return with_char_features(df).groupBy(*by).agg(_or_all_wrong(totals).alias("cer"))


def word_error_rate(df: DataFrame, *by: str) -> DataFrame:
    totals = ratio(F.sum("word_edits"), F.sum("ref_words"))
    return with_word_features(df).groupBy(*by).agg(_or_all_wrong(totals).alias("wer"))


def normalized_edit_distance(df: DataFrame, *by: str) -> DataFrame:
    mean = _or_all_wrong(F.avg("ned")).alias("normalized_edit_distance")
    return with_ned(df).groupBy(*by).agg(mean)


def macro_line_cer(df: DataFrame, *by: str) -> DataFrame:
    rows = with_char_features(df).withColumn("line_cer", row_cer(F.col("char_edits"), F.col("ref_chars")))
    return rows.groupBy(*by).agg(
        F.avg("line_cer").alias("mean_line_cer"),
        F.avg(F.greatest(F.lit(0.0), 1 - F.col("line_cer"))).alias("mean_character_accuracy"),
    )


def exact_match_rate(df: DataFrame, *by: str) -> DataFrame:
    return with_char_features(df).groupBy(*by).agg(
        F.count_if("exact").alias("exact_matches"),
        F.count_if(~F.col("exact")).alias("exact_errors"),
        F.avg(F.col("exact").cast("double")).alias("exact_match_rate"),
    )


# --- calibration ---------------------------------------------------------------------------


def confidence_bin(confidence: Column, n_bins: int = 10) -> Column:
    """0-based bin: the first one is closed at 0, the others are (lo, hi]."""
    if n_bins <= 0:
        raise ValueError("n_bins must be positive")
    step = 1.0 / n_bins
    above = [F.when(confidence > F.lit(i * step), 1).otherwise(0) for i in range(1, n_bins)]
    total = F.lit(0)
    for part in above:
        total = total + part
    return total


def reliability_table(df: DataFrame, *by: str, n_bins: int = 10) -> DataFrame:
    """Count, mean confidence and accuracy per confidence bin."""
    rows = with_char_features(df).withColumn("bin", confidence_bin(F.col("confidence"), n_bins))
    return rows.groupBy(*by, "bin").agg(
        F.count("*").alias("n"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("exact").cast("double")).alias("accuracy"),
    )


def calibration_error(df: DataFrame, *by: str, n_bins: int = 10) -> DataFrame:
    """Expected calibration error: weighted gap between accuracy and confidence per bin."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))
    total = F.coalesce(ratio(F.sum(gap), F.sum("n")), F.lit(0.0))
    return reliability_table(df, *by, n_bins=n_bins).groupBy(*by).agg(
        total.alias("calibration_error")
    )


def brier_score(df: DataFrame, *by: str) -> DataFrame:
    target = F.col("exact").cast("double")
    return with_char_features(df).groupBy(*by).agg(
        F.avg(F.pow(F.col("confidence") - target, F.lit(2))).alias("brier_score")
    )


def confidence_accuracy_mae(df: DataFrame, *by: str) -> DataFrame:
    rows = with_char_features(df)
    accuracy = F.greatest(F.lit(0.0), 1 - row_cer(F.col("char_edits"), F.col("ref_chars")))
    return rows.groupBy(*by).agg(
        F.avg(F.abs(F.col("confidence") - accuracy)).alias("confidence_accuracy_mae")
    )


def both_classes_present(df: DataFrame, *by: str) -> DataFrame:
    return with_char_features(df).groupBy(*by).agg(
        (F.min("exact") != F.max("exact")).alias("target_has_both_classes")
    )


def false_confidence_rate(df: DataFrame, *by: str, threshold: float = HIGH_CONFIDENCE) -> DataFrame:
    _unit_interval(threshold)
    high = F.col("confidence") >= threshold
    rate = ratio(F.count_if(high & ~F.col("exact")), F.count_if(high))
    return with_char_features(df).groupBy(*by).agg(
        F.coalesce(rate, F.lit(0.0)).alias("false_confidence_rate")
    )


def abstention_quality(df: DataFrame, *by: str, threshold: float = ABSTAIN_BELOW) -> DataFrame:
    _unit_interval(threshold)
    held = F.col("confidence") < threshold
    zero = F.lit(0.0)
    return with_char_features(df).groupBy(*by).agg(
        F.coalesce(ratio(F.count_if(held), F.count("*")), zero).alias("abstention_rate"),
        F.coalesce(ratio(F.count_if(held & ~F.col("exact")), F.count_if(held)), zero).alias(
            "correct_abstentions"
        ),
        F.coalesce(ratio(F.count_if(held & F.col("exact")), F.count_if(held)), zero).alias(
            "unnecessary_abstentions"
        ),
    )


def _unit_interval(threshold: float) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")


# --- operations -------------------------------------------------------------------------------


def confidence_summary(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("num_samples"), F.avg("confidence").alias("mean_confidence")
    )


def mean_cost(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("cost_per_page_usd").alias("cost_per_page_usd"))


def valid_output_rate(checked: DataFrame, errors: str = "errors") -> DataFrame:
    """Share of rows without a broken rule."""
    return checked.agg(
        ratio(F.count_if(F.size(errors) == 0), F.count("*")).alias("valid_output_rate")
    )


def _value_bucket(value: Column) -> Column:
    """Monotone bucket with a relative width of 1/30 of a percent; few thousand per decade."""
    magnitude = F.floor(F.log2(1 + F.abs(value)) * 2048)
    return F.when(value < 0, -magnitude - 1).otherwise(magnitude)


def exact_percentiles(
    df: DataFrame, value: str, percentages: dict[str, float], *by: str, mean: str | None = None
) -> DataFrame:
    """Exact linearly interpolated percentiles without one task holding a group.

    Equal values are counted first. Bucket totals then locate the ranks that are wanted, and
    only the buckets that hold one of them are sorted. `mean` names a column for the mean, which
    the counts give as well.
    """
    keys = list(by)
    # A bucket that can never be null spares an inferred filter, so both uses share one shuffle.
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_b", F.coalesce(_value_bucket(F.col("_v")), F.lit(0)))
    )
    one = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"), F.sum(F.col("_v") * F.col("_n")).alias("_bs"))
    buckets = buckets.withColumns(
        {
            "_sum": F.sum("_bs").over(one),
            "_before": F.coalesce(
                F.sum("_bn").over(one.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
            "_total": F.sum("_bn").over(one),
        }
    )
    # 0-based ranks around each percentile; a bucket keeps those that fall into it.
    wanted = F.array(
        *[
            F.struct(F.lit(n).alias("name"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("at"))
            for n, p in percentages.items()
        ]
    )
    end = F.col("_before") + F.col("_bn")
    inside = F.filter(
        wanted, lambda w: (F.ceil(w["at"]) >= F.col("_before")) & (F.floor(w["at"]) < end)
    )
    targets = buckets.withColumn("_w", inside).filter(F.size("_w") > 0).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k_b"), "_before", "_w",
        (F.col("_sum") / F.col("_total")).alias("_mean"),
    )
    match = F.col("_b") == F.col("_k_b")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    kept = counts.join(targets, match)
    local = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = kept.withColumn("_end", F.sum("_n").over(local) + F.col("_before"))
    hit = kept.select(*keys, "_v", "_n", "_end", "_mean", F.explode("_w").alias("w"))
    start = F.col("_end") - F.col("_n")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= start) & (rank < F.col("_end")), F.col("_v")))

    per_name = hit.groupBy(*keys, F.col("w.name").alias("_name"), F.col("w.at").alias("_at")).agg(
        value_at(F.floor("w.at")).alias("_lo"), value_at(F.ceil("w.at")).alias("_hi"), F.max("_mean").alias("_mean"),
    )
    share = F.col("_at") - F.floor("_at")
    per_name = per_name.withColumn("_p", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share)
    return per_name.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_p"))).alias(n) for n in percentages],
        *([F.max("_mean").alias(mean)] if mean else []),
    )


def latency_summary(df: DataFrame, *by: str) -> DataFrame:
    """p50, p95 and samples per minute (null when the mean latency is 0), from one pass; a group
    without any latency has no row."""
    found = exact_percentiles(
        df, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}, *by, mean="_latency"
    )
    return found.withColumn("samples_per_minute", ratio(F.lit(60000.0), F.col("_latency"))).drop("_latency")


# --- the full bundle -----------------------------------------------------------------------------


def _partial_sums(df: DataFrame, keys: Sequence[Column | str], more: Sequence[Column] = ()) -> DataFrame:
    """Everything the bundle needs, and `more` sums, per key and confidence bin."""
    rows = with_row_features(df).withColumn("_bin", confidence_bin(F.col("confidence")))
    confidence = F.col("confidence")
    high, held, ok = confidence >= HIGH_CONFIDENCE, confidence < ABSTAIN_BELOW, F.col("exact")
    return rows.groupBy(*keys, "_bin").agg(
        F.count("*").alias("n"),
        F.count("confidence").alias("n_conf"),
        F.sum("char_edits").alias("char_edits"),
        F.sum("ref_chars").alias("ref_chars"),
        F.sum("word_edits").alias("word_edits"),
        F.sum("ref_words").alias("ref_words"),
        F.sum("ned").alias("ned"),
        F.sum("confidence").alias("conf"),
        F.count_if(ok).alias("ok"),
        F.count_if(high).alias("high"),
        F.count_if(high & ~ok).alias("high_wrong"),
        F.count_if(held).alias("held"),
        F.count_if(held & ~ok).alias("held_wrong"),
        *more,
    )


def _bundle(parts: DataFrame, *by: str, more: Sequence[str] = ()) -> DataFrame:
    """Combine partial sums; confidence metrics are null when no confidence exists."""
    per_bin = parts.groupBy(*by, "_bin").agg(
        *[F.sum(c).alias(c) for c in parts.columns if c not in {*by, "_bin"}]
    )
    has_conf = F.sum("n_conf") > 0
    zero = F.lit(0.0)

    def confident(value: Column) -> Column:
        return F.when(has_conf, F.coalesce(value, zero))

    return per_bin.groupBy(*by).agg(
        F.sum("n").alias("num_samples"),
        ratio(F.sum("char_edits"), F.sum("ref_chars")).alias("cer"),
        ratio(F.sum("word_edits"), F.sum("ref_words")).alias("wer"),
        ratio(F.sum("ned"), F.sum("n")).alias("normalized_edit_distance"),
        confident(ratio(F.sum(F.abs(F.col("ok") - F.col("conf"))), F.sum("n"))).alias(
            "calibration_error"
        ),
        confident(ratio(F.sum("high_wrong"), F.sum("high"))).alias("false_confidence_rate"),
        confident(ratio(F.sum("held"), F.sum("n"))).alias("abstention_rate"),
        confident(ratio(F.sum("held_wrong"), F.sum("held"))).alias("correct_abstentions"),
        confident(ratio(F.sum(F.col("held") - F.col("held_wrong")), F.sum("held"))).alias(
            "unnecessary_abstentions"
        ),
        confident(ratio(F.sum("conf"), F.sum("n"))).alias("mean_confidence"),
        *[F.sum(name).alias(name) for name in more],
    )


def full_metrics(df: DataFrame) -> DataFrame:
    """The metric bundle over all rows."""
    return _bundle(_partial_sums(df, []))


def slice_metrics(
    df: DataFrame, slices: str = "slices", overall: str = ALL, more: dict[str, Column] | None = None
) -> DataFrame:
    """The bundle over all rows and per tag of a multi-valued slice column.

    Rows are summed per distinct tag set and bin first; only those sums are exploded, so a
    row with many tags is never copied, and a popular tag never concentrates rows. Tags are
    normalised in the sums, not in the rows. `more` names further aggregates that add up, such as
    sums and counts.
    """
    more = more or {}
    parts = _partial_sums(df, [F.col(slices).alias("_tags")], [c.alias(n) for n, c in more.items()])
    tags = F.concat(F.array(F.lit(overall)), normalize_slices(F.col("_tags")))
    exploded = parts.withColumn("slice", F.explode(tags)).drop("_tags")
    return _bundle(exploded, "slice", more=list(more))


# --- selective risk --------------------------------------------------------------------------------


def risk_coverage_curve(df: DataFrame) -> DataFrame:
    """Selective CER and coverage when accepting down to each distinct confidence."""
    per_value = (
        with_char_features(df)
        .groupBy("confidence")
        .agg(
            F.count("*").alias("n"),
            F.sum("char_edits").alias("edits"),
            F.sum("ref_chars").alias("chars"),
        )
    )
    total = per_value.agg(F.sum("n")).scalar()
    curve = running_sums(
        per_value,
        keys=[],
        order_by=[F.col("confidence").desc()],
        bucket=-F.floor(F.col("confidence") * 4096),
        sums={"accepted_samples": "n", "accepted_edits": "edits", "accepted_chars": "chars"},
    )
    return curve.select(
        "confidence",
        "accepted_samples",
        ratio(F.col("accepted_samples"), total).alias("coverage"),
        ratio(F.col("accepted_edits"), F.col("accepted_chars")).alias("selective_cer"),
    )
