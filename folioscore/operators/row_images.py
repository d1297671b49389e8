"""Page measurements on images kept as one array per image row (page_id, y, levels).

A stencil along a row stays inside its array; only the rows above and below meet, over a window of
one row per image row. So a page costs one shuffle of its rows, not two of its pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.operators.pixels import GLARE_LEVEL, GLARE_SHARE


def rows_of_pixels(pixels: DataFrame) -> DataFrame:
    """Row arrays from a pixel table (page_id, y, x, v) without gaps."""
    cells = F.array_sort(F.collect_list(F.struct("x", "v")))
    return pixels.groupBy("page_id", "y").agg(F.transform(cells, lambda c: c["v"]).alias("levels"))


def _sum(values: Column, kind: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, v: a + v)


def row_exposure(rows: DataFrame) -> DataFrame:
    """Brightness, population contrast, saturated share and glare, from sums per row."""
    values = F.transform("levels", lambda v: v.cast("double"))
    sums = rows.select(
        "page_id", F.size("levels").alias("n"), _sum(values).alias("s"), _sum(F.transform(values, lambda v: v * v)).alias("q"),
        F.size(F.filter("levels", lambda v: v > GLARE_LEVEL)).alias("bright"),
    ).groupBy("page_id").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "bright")])
    mean, share = F.col("s") / F.col("n"), F.col("bright") / F.col("n")
    # Grey levels are small integers, so the sums of squares are exact.
    return sums.select(
        "page_id", mean.alias("brightness"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("contrast"),
        share.alias("saturated_share"), (share > GLARE_SHARE).alias("has_glare"),
    )


def _beside(values: Column, last: Column) -> tuple[Column, Column]:
    """Left and right neighbours of every cell, reflected at the ends; a lone cell is its own."""
    lone = last == 1
    left = F.concat(F.slice(values, 2, 1), F.slice(values, F.lit(1), last - 1))
    right = F.concat(F.slice(values, F.lit(2), last - 1), F.slice(values, F.greatest(last - 1, F.lit(1)), F.lit(1)))
    return F.when(lone, values).otherwise(left), F.when(lone, values).otherwise(right)


def row_blur_variance(rows: DataFrame) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian with reflected borders, per page."""
    order = W.partitionBy("page_id").orderBy("y")
    n = F.size("levels")
    left, right = _beside(F.col("levels"), n)
    inside = F.zip_with(F.zip_with(left, right, lambda a, b: a + b), F.col("levels"), lambda s, v: s - 4 * v)
    near = rows.withColumns({"inside": inside, "above": F.lag("levels").over(order), "below": F.lead("levels").over(order)})
    above, below = F.coalesce("above", "below", "levels"), F.coalesce("below", "above", "levels")
    lap = F.zip_with(F.zip_with(above, below, lambda a, b: a + b), F.col("inside"), lambda a, b: (a + b).cast("long"))
    sums = near.select("page_id", n.alias("n"), lap.alias("lap")).select(
        "page_id", "n", _sum(F.col("lap"), "long").alias("s"), _sum(F.transform("lap", lambda v: v * v), "long").alias("q")
    ).groupBy("page_id").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.col("s") / F.col("n")
    return sums.select("page_id", (F.col("q") / F.col("n") - mean * mean).alias("blur"))


def row_ink(rows: DataFrame, ink_below: int = 100) -> DataFrame:
    """Ink per image row and its extent, inside each array: no shuffle at all."""
    marks = F.transform("levels", lambda v: (v < ink_below).cast("int"))
    n = F.size("levels")
    # Positions count from 1; none is 0.
    first, from_end = F.array_position(marks, 1), F.array_position(F.reverse(marks), 1)
    found = first > 0
    return rows.select(
        "page_id", "y", _sum(marks, "long").alias("ink"), F.when(found, first - 1).alias("x_first"),
        F.when(found, n - from_end).alias("x_last"), n.cast("long").alias("width"),
    )


def row_text_lines(profile: DataFrame, min_height: int = 15, max_height: int = 200) -> DataFrame:
    """Text lines as runs of inked rows: one pass over each page's profile, collected in row order.

    A page has as many entries as image rows. A run that reaches the last row spans the full width.
    """
    entry = F.struct("y", "ink", "x_first", "x_last", "width")
    pages = profile.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    runs = F.aggregate(
        F.filter("rows", lambda r: r["ink"] > r["width"] * 0.01),
        F.array().cast("array<struct<y1:bigint,y2:bigint,x1:bigint,x2:bigint,width:bigint>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["y2"] == r["y"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_run(
                F.element_at(done, -1)["y1"], r, F.least(F.element_at(done, -1)["x1"], r["x_first"]), F.greatest(F.element_at(done, -1)["x2"], r["x_last"])
            ))),
        ).otherwise(F.concat(done, F.array(_run(r["y"], r, r["x_first"], r["x_last"])))),
    )
    lines = pages.select("page_id", F.element_at("rows", -1)["y"].alias("bottom"), F.explode(runs).alias("line")).select("page_id", "bottom", "line.*")
    last = F.col("y2") == F.col("bottom") + 1
    return lines.filter((F.col("y2") - F.col("y1")).between(min_height, max_height)).select(
        "page_id", F.when(last, 0).otherwise(F.col("x1")).alias("x1"), "y1", F.when(last, F.col("width")).otherwise(F.col("x2")).alias("x2"), "y2",
    )


def _run(y1: Column, row: Column, x1: Column, x2: Column) -> Column:
    long = lambda c: c.cast("bigint")
    return F.struct(
        long(y1).alias("y1"), (long(row["y"]) + 1).alias("y2"), long(x1).alias("x1"), long(x2).alias("x2"), long(row["width"]).alias("width")
    )
