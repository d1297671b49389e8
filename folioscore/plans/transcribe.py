"""From page measurements and recognised blocks to assembled page results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscore.operators.pages import assess_quality, layout_features, needs_page_model, page_confidence, route_pages, transcript


def page_results(measurements: DataFrame, line_blocks: DataFrame, page_blocks: DataFrame) -> DataFrame:
    """Quality, route, transcript and confidence per page.

    Line blocks serve the fast route, page blocks the fallback route, and the hybrid route
    takes line blocks unless too many of them are uncertain. Human-only pages get no text.
    """
    quality = assess_quality(measurements)
    routed = route_pages(quality, layout_features(line_blocks))
    # One row per page decides for all blocks, which meet it in one join.
    escalated = needs_page_model(line_blocks).select("page_id", "escalate")
    route = routed.select("page_id", "route").join(escalated, "page_id", "left")
    both = line_blocks.withColumn("_by_page", F.lit(False)).unionByName(page_blocks.withColumn("_by_page", F.lit(True)))
    fast, fallback, hybrid = (F.col("route") == r for r in ("trocr_fast", "vlm_fallback", "hybrid"))
    wanted = F.when(fast, False).when(fallback, True).when(hybrid, F.coalesce("escalate", F.lit(False)))
    blocks = both.join(route, "page_id").filter(F.col("_by_page") == wanted)
    return routed.join(page_confidence(blocks, text=transcript()), "page_id", "left")
