"""Page pipeline: quality, layout, routing, block assembly and job progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscore import vocab
from folioscore.operators.ordering import position_within

HANDWRITING, PRINTED, MARGIN = "student_handwriting", "printed_text", "margin_insertion"
SECONDS_PER_PAGE = 2.5


# --- recogniser outputs -------------------------------------------------------------------


def sequence_confidence(log_probs: Column, token_ids: Column | None = None, pad_id: int | None = None) -> Column:
    """Geometric mean of the token probabilities; 0.5 when no token is active."""
    active = active_log_probs(log_probs, token_ids, pad_id)
    total = F.aggregate(active, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(active) == 0, F.lit(0.5)).otherwise(F.exp(total / F.size(active)))


def active_log_probs(log_probs: Column, token_ids: Column | None = None, pad_id: int | None = None) -> Column:
    """Scores of the tokens that are not padding; without a pad id, the non-zero scores."""
    if token_ids is None or pad_id is None:
        return F.filter(log_probs, lambda x: x != 0)
    pairs = F.arrays_zip(token_ids.alias("t"), log_probs.alias("s"))
    return F.transform(F.filter(pairs, lambda p: p["t"] != pad_id), lambda p: p["s"])


def token_confidences(log_probs: Column, token_ids: Column | None = None, pad_id: int | None = None) -> Column:
    return F.transform(active_log_probs(log_probs, token_ids, pad_id), F.exp)


def with_read_flags(df: DataFrame, uncertain_below: float = 0.7, unreadable_below: float = 0.4) -> DataFrame:
    """Flags by confidence; an unreadable text is replaced, its raw text is kept."""
    unreadable = F.col("confidence") < unreadable_below
    return df.withColumns(
        {
            "is_uncertain": F.col("confidence") < uncertain_below,
            "is_unreadable": unreadable,
            "text": F.when(unreadable, "[UNREADABLE]").otherwise(F.col("raw_text")),
        }
    )


VLM_BLOCK = (
    "array<struct<type:string,reading_order:int,text:string,confidence:double,"
    "bbox:array<int>,crossed_out:boolean>>"
)


def parse_page_model_output(df: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Blocks of a page model's JSON text, with defaults; broken text gives one fallback block."""
    body = F.regexp_replace(F.trim(F.col(raw)), r"^```(json)?|```$", "")
    parsed = F.from_json(F.trim(body), VLM_BLOCK, {"mode": "PERMISSIVE"})
    fallback = F.array(
        F.struct(
            F.lit(HANDWRITING).alias("type"),
            F.lit(1).alias("reading_order"),
            F.col(raw).alias("text"),
            F.lit(0.3).alias("confidence"),
            F.array(*[F.lit(v) for v in (0, 0, 100, 100)]).alias("bbox"),
            F.lit(False).alias("crossed_out"),
        )
    ).cast(VLM_BLOCK)
    rows = df.withColumn("b", F.explode(F.coalesce(parsed, fallback)))
    confidence = F.coalesce("b.confidence", F.lit(0.5))
    return rows.select(
        *[c for c in df.columns if c != raw],
        F.coalesce("b.type", F.lit(HANDWRITING)).alias("type"),
        F.coalesce("b.reading_order", F.lit(0)).alias("reading_order"),
        F.coalesce("b.text", F.lit("")).alias("text"),
        confidence.alias("confidence"),
        F.coalesce("b.bbox", F.array(*[F.lit(v) for v in (0, 0, 100, 100)])).alias("bbox"),
        F.coalesce("b.crossed_out", F.lit(False)).alias("crossed_out"),
        (confidence < 0.7).alias("is_uncertain"),
    )


# --- quality gate ---------------------------------------------------------------------------


def quality_issues(
    blur_below: float = 100.0,
    min_resolution: int = 640,
    max_skew: float = 15.0,
    dark_below: float = 40.0,
    bright_above: float = 220.0,
) -> Column:
    """Issues of a page from its measurements, in the order the checks run."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(c("blur") < blur_below, "blur"),
            F.when(F.least("width", "height") < min_resolution, "low_resolution"),
            F.when(F.abs(c("skew")) > max_skew, "skew"),
            F.when(c("brightness") < dark_below, "underexposed").when(
                c("brightness") > bright_above, "overexposed"
            ),
            F.when(c("has_glare"), "glare"),
            F.when(c("has_shadow"), "shadow"),
            F.when(c("is_blank"), "blank_page"),
        )
    )


def quality_score(issues: Column) -> Column:
    """1 minus the penalty of every issue, never below 0."""
    def penalty(issue: Column) -> Column:
        out = None
        for name, value in vocab.QUALITY_PENALTIES.items():
            out = F.when(issue == name, value) if out is None else out.when(issue == name, value)
        return out.otherwise(0.1)

    return F.greatest(F.lit(0.0), F.aggregate(issues, F.lit(1.0), lambda a, i: a - penalty(i)))


def quality_recommendation(issues: Column, score: Column) -> Column:
    return (
        F.when(F.array_contains(issues, "blank_page"), "skip")
        .when(score < 0.3, "re-upload")
        .when(score < 0.6, "vlm_fallback")
        .otherwise("process")
    )


def quality_passed(issues: Column, score: Column) -> Column:
    return (F.size(issues) == 0) | ((score > 0.5) & ~F.array_contains(issues, "blank_page"))


def assess_quality(measurements: DataFrame, **limits: float) -> DataFrame:
    rows = measurements.withColumn("issues", quality_issues(**limits))
    rows = rows.withColumn("score", quality_score(F.col("issues")))
    return rows.withColumns(
        {
            "recommendation": quality_recommendation(F.col("issues"), F.col("score")),
            "passed": quality_passed(F.col("issues"), F.col("score")),
        }
    )


# --- layout -----------------------------------------------------------------------------------


def bbox_columns(box: Column) -> dict[str, Column]:
    width, height = box[2] - box[0], box[3] - box[1]
    return {
        "box_width": width,
        "box_height": height,
        "box_area": width * height,
        "center_x": F.floor((box[0] + box[2]) / 2),
        "center_y": F.floor((box[1] + box[3]) / 2),
    }


def region_type(ink_density: Column, n_components: Column, width_std: Column) -> Column:
    """Blank without components, printed when regular and dense, else handwriting."""
    return (
        F.when(n_components == 0, "blank")
        .when((width_std < 0.3) & (ink_density > 0.15), PRINTED)
        .otherwise(HANDWRITING)
    )


def reading_order(lines: DataFrame, *tie: str, band: int = 64) -> DataFrame:
    """0-based position on the page by top, then left, then the tie columns."""
    box = F.col("bbox")
    ordered = position_within(
        lines, ["page_id"], [box[1], box[0], *[F.col(t) for t in tie]], F.floor(box[1] / band),
        name="reading_order",
    )
    return ordered.withColumn("reading_order", F.col("reading_order") - 1)


def crossed_out_lines(lines: DataFrame, strokes: DataFrame) -> DataFrame:
    """Lines with a stroke through the middle 40% of their height.

    Strokes reduce to one row per line before they meet the lines; both share `page_id`,
    `line_no`, and a stroke's `avg_y` counts from the top of its line.
    """
    height = F.col("bbox")[3] - F.col("bbox")[1]
    with_height = strokes.join(lines.select("page_id", "line_no", height.alias("h")), ["page_id", "line_no"])
    hit = (F.col("avg_y") >= F.col("h") * 0.3) & (F.col("avg_y") <= F.col("h") * 0.7)
    return with_height.groupBy("page_id", "line_no").agg(F.bool_or(hit).alias("is_crossed_out"))


def layout_totals(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("page_id").agg(
        F.count("*").alias("total_lines"),
        F.count_if(F.col("type") == HANDWRITING).alias("handwriting_lines"),
        F.count_if("crossed_out").alias("crossed_out_lines"),
    )


# --- routing ------------------------------------------------------------------------------------


def layout_features(blocks: DataFrame) -> DataFrame:
    """Per page: the counts that the complexity score needs."""
    kind = F.col("type")
    return blocks.groupBy("page_id").agg(
        sum((F.max((kind == t).cast("int")) for t in vocab.REGION_TYPES[1:]),
            F.max((kind == vocab.REGION_TYPES[0]).cast("int"))).alias("n_types"),
        F.count_if(kind == HANDWRITING).alias("handwriting_lines"),
        F.count_if("crossed_out").alias("crossed_out_lines"),
        F.count_if(kind == MARGIN).alias("insertions"),
        (F.bool_or(kind == PRINTED) & F.bool_or(kind == HANDWRITING)).alias("mixed"),
    )


def complexity_score(issues: Column) -> Column:
    """0 to 10; a page without lines scores one below its issues, as published."""
    none = F.lit(0)
    score = (
        F.size(issues) * 1.5
        + (F.coalesce("n_types", none) - 1) * 1.0
        + F.coalesce("crossed_out_lines", none) * 0.5
        + F.coalesce("insertions", none) * 1.0
        + F.when(F.coalesce("mixed", F.lit(False)), 2.0).otherwise(0.0)
    )
    return F.least(F.lit(10.0), score)


def route_pages(
    quality: DataFrame,
    features: DataFrame,
    page_model_cost: float = 0.01,
    line_model_cost: float = 0.0001,
) -> DataFrame:
    """Route, confidence, latency and cost per page; `force_vlm` is optional in `quality`."""
    rows = quality.join(features, "page_id", "left")
    if "force_vlm" not in rows.columns:
        rows = rows.withColumn("force_vlm", F.lit(False))
    rows = rows.withColumn("complexity", complexity_score(F.col("issues")))
    # A page without any line still plans for ten of them.
    lines = F.coalesce("handwriting_lines", F.lit(10)).cast("double")

    def decision(route: str, confidence: float, latency: Column, cost: Column, reason: str) -> Column:
        return F.struct(
            F.lit(route).alias("route"),
            F.lit(confidence).alias("route_confidence"),
            latency.cast("double").alias("latency_ms"),
            cost.cast("double").alias("cost_usd"),
            F.lit(reason).alias("reason"),
        )

    full = F.lit(page_model_cost)
    chosen = (
        F.when(F.col("force_vlm"), decision("vlm_fallback", 0.9, F.lit(2000.0), full, "forced"))
        .when(
            F.col("recommendation") == "re-upload",
            decision("human_only", 0.1, F.lit(0.0), F.lit(0.15), "quality_too_low"),
        )
        .when(
            F.col("complexity") < 3,
            decision("trocr_fast", 0.85, lines * 50.0, lines * line_model_cost, "simple_layout"),
        )
        .when(F.col("complexity") < 7, decision("hybrid", 0.7, F.lit(1500.0), full * 0.5, "moderate"))
        .otherwise(decision("vlm_fallback", 0.75, F.lit(2500.0), full, "complex_layout"))
    )
    return rows.withColumn("_d", chosen).select(*quality.columns, "complexity", "_d.*")


def needs_page_model(blocks: DataFrame, share: float = 0.3) -> DataFrame:
    """Pages with more than `share` uncertain blocks go to the page model as a whole."""
    uncertain = F.count_if("is_uncertain")
    return blocks.groupBy("page_id").agg(
        uncertain.alias("uncertain_blocks"),
        F.count("*").alias("blocks"),
        (uncertain > F.count("*") * share).alias("escalate"),
    )


def hybrid_blocks(line_blocks: DataFrame, page_blocks: DataFrame, share: float = 0.3) -> DataFrame:
    """Line-model blocks, replaced page by page where the line model was too uncertain."""
    verdict = needs_page_model(line_blocks, share).filter("escalate").select("page_id")
    kept = line_blocks.join(verdict, "page_id", "left_anti")
    replaced = page_blocks.join(verdict, "page_id", "left_semi")
    return kept.withColumn("block_source", F.lit("line")).unionByName(
        replaced.withColumn("block_source", F.lit("page"))
    )


# --- assembly --------------------------------------------------------------------------------------


def page_confidence(blocks: DataFrame, **more: Column) -> DataFrame:
    """Mean of the positive block confidences, rounded only after `needs_review` is decided.

    `more` are further aggregates of each page, from the same pass.
    """
    positive = F.avg(F.when(F.col("confidence") > 0, F.col("confidence")))
    per_page = blocks.groupBy("page_id").agg(
        F.coalesce(positive, F.lit(0.0)).alias("_mean"),
        F.count_if("is_uncertain").alias("uncertain_spans"),
        *[c.alias(n) for n, c in more.items()],
    )
    return per_page.select(
        "page_id", *more,
        F.round("_mean", 4).alias("confidence_score"),
        "uncertain_spans",
        ((F.col("uncertain_spans") > 0) | (F.col("_mean") < 0.8)).alias("needs_review"),
    )


def page_model_confidence(blocks: DataFrame) -> DataFrame:
    """Mean over all blocks of a page, zeros included."""
    return blocks.groupBy("page_id").agg(
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence")
    )


def transcript(keep_empty: bool = False) -> Column:
    """The text of a page as an aggregate over its blocks; null if no block counts."""
    counts = ~F.col("crossed_out") if keep_empty else ~F.col("crossed_out") & (F.col("text") != "")
    entries = F.array_sort(F.collect_list(F.when(counts, F.struct("reading_order", "block_no", "text"))))
    return F.when(F.size(entries) > 0, F.array_join(F.transform(entries, lambda e: e["text"]), "\n"))


def assemble_transcripts(blocks: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Page texts: blocks in reading order without crossed-out ones, joined by newlines.

    One row per page, whatever its length: the text is one value by definition, so a page's
    blocks meet in one row of an aggregation that can spill.
    """
    kept = blocks.filter(~F.col("crossed_out"))
    if not keep_empty:
        kept = kept.filter(F.col("text") != "")
    entries = F.array_sort(F.collect_list(F.struct("reading_order", "block_no", "text")))
    return kept.groupBy("page_id").agg(F.array_join(F.transform(entries, lambda e: e["text"]), "\n").alias("text"))


def job_progress(pages: DataFrame, *by: str) -> DataFrame:
    """Counters of a batch job from its page results, with the remaining-time estimate."""
    done = F.col("status") == "completed"
    failed = F.col("status") == "failed"
    waiting = ~(done | failed)
    return pages.groupBy(*by).agg(
        F.count("*").alias("pages_total"),
        F.count_if(done).alias("pages_completed"),
        F.count_if(done & F.col("needs_review")).alias("pages_needs_review"),
        F.count_if(failed).alias("pages_failed"),
        F.coalesce(F.avg(F.when(done, F.col("confidence_score"))), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.sum(F.when(done, F.col("processing_seconds"))), F.lit(0.0)).alias("processing_seconds"),
        (F.count_if(waiting) * SECONDS_PER_PAGE).alias("remaining_seconds"),
    )


# --- model registry -------------------------------------------------------------------------------


def champions(registry: DataFrame, promotions: DataFrame) -> DataFrame:
    """Latest promoted version per model type, with its metrics; unknown versions are ignored.

    `promoted_seq` is a number; of versions that share one the shorter, then smaller name wins: v9 before v10.
    """
    known = promotions.join(registry.select("version", "model_type", "metrics"), "version")
    order = F.when(F.col("promoted_seq").isNotNull(), F.struct(-F.col("promoted_seq"), F.length("version"), "version"))
    newest = F.min_by(F.struct("version", "metrics"), order)
    return known.groupBy("model_type").agg(newest.alias("c")).select("model_type", "c.*")


def best_version(registry: DataFrame, metric: str = "cer") -> DataFrame:
    """Version with the lowest metric per model type; ties go to the smaller name."""
    return registry.groupBy("model_type").agg(
        F.min_by("version", F.struct(F.col("metrics")[metric], F.col("version"))).alias("version"),
        F.min(F.col("metrics")[metric]).alias(metric),
    )

