"""Measurements on a pixel table (page_id, y, x, v) and on raw grey images.

Windows run along one image row or one image column, so their size is bounded by the image's
sides even when one page holds most of the pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.functions.digests import hash_uniform

GLARE_LEVEL, GLARE_SHARE = 250, 0.05
BOXES = 256


def exposure(pixels: DataFrame) -> DataFrame:
    """Mean brightness, population contrast, saturated share and the glare flag per page."""
    v = F.col("v").cast("double")
    saturated = F.avg((F.col("v") > GLARE_LEVEL).cast("double"))
    return pixels.groupBy("page_id").agg(
        F.avg(v).alias("brightness"),
        F.stddev_pop(v).alias("contrast"),
        saturated.alias("saturated_share"),
        (saturated > GLARE_SHARE).alias("has_glare"),
    )


def blur_variance(pixels: DataFrame) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian with reflected borders, per page."""
    row = W.partitionBy("page_id", "y").orderBy("x")
    column = W.partitionBy("page_id", "x").orderBy("y")
    v = F.col("v").cast("double")

    def both_sides(window: W, own: Column) -> Column:
        before, after = F.lag(v).over(window), F.lead(v).over(window)
        # Outside the image the neighbour is the one on the other side; a lone pixel is its own.
        left = F.coalesce(before, after, own)
        right = F.coalesce(after, before, own)
        return left + right

    horizontal = pixels.withColumn("_h", both_sides(row, v))
    full = horizontal.withColumn("_lap", F.col("_h") + both_sides(column, v) - 4 * v)
    return full.groupBy("page_id").agg(F.var_pop("_lap").alias("blur"))


def row_profile(pixels: DataFrame, ink_below: int = 100) -> DataFrame:
    """Ink per image row and its horizontal extent."""
    ink = F.col("v") < ink_below
    return pixels.groupBy("page_id", "y").agg(
        F.count_if(ink).alias("ink"),
        F.min(F.when(ink, F.col("x"))).alias("x_first"),
        F.max(F.when(ink, F.col("x"))).alias("x_last"),
        (F.max("x") + 1).alias("width"),
    )


def text_lines(profile: DataFrame, min_height: int = 15, max_height: int = 200) -> DataFrame:
    """Text lines as runs of inked rows, as [x1, y1, x2, y2] boxes.

    The window runs over the row profile of a page, which has one row per image row. A run
    that reaches the last row spans the full width.
    """
    page = W.partitionBy("page_id")
    order = page.orderBy("y")
    inked = F.col("ink") > F.col("width") * 0.01
    rows = profile.withColumns({"_ink": inked, "_bottom": F.max("y").over(page)})
    starts = F.col("_ink") & ~F.lag("_ink", 1, False).over(order)
    rows = rows.withColumn("_start", starts.cast("int")).withColumn(
        "_run", F.sum("_start").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    runs = rows.filter("_ink").groupBy("page_id", "_run").agg(
        F.min("y").alias("y1"),
        (F.max("y") + 1).alias("y2"),
        F.min("x_first").alias("x_first"),
        F.max("x_last").alias("x_last"),
        F.max("width").alias("width"),
        F.max("_bottom").alias("_bottom"),
    )
    last = F.col("y2") == F.col("_bottom") + 1
    return runs.filter((F.col("y2") - F.col("y1")).between(min_height, max_height)).select(
        "page_id",
        F.when(last, 0).otherwise(F.col("x_first")).alias("x1"),
        "y1",
        F.when(last, F.col("width")).otherwise(F.col("x_last")).alias("x2"),
        "y2",
    )


# --- augmentation plan ------------------------------------------------------------------------


def augmentation_plan(samples: DataFrame, seed: str = "42") -> DataFrame:
    """Which augmentations each sample gets and how strong, from hash-seeded uniform numbers."""
    digest = F.sha2(F.concat_ws("\0", F.lit("augment"), F.lit(seed), F.col("sample_id")), 256)
    more = F.sha2(F.concat_ws("\0", F.lit("augment-colour"), F.lit(seed), F.col("sample_id")), 256)
    rows = samples.select("sample_id", digest.alias("d"), more.alias("e"))
    u = lambda i: hash_uniform(F.col("d"), 1 + 6 * i, 6)
    # A second digest: no two strengths share a draw.
    w = lambda i: hash_uniform(F.col("e"), 1 + 6 * i, 6)
    on = u(0) <= 0.5

    def pick(gate: int, probability: float, value: Column) -> Column:
        return F.when(on & (u(gate) < probability), value)

    return rows.select(
        "sample_id",
        on.alias("augmented"),
        pick(1, 0.3, 0.5 + u(2) * 1.5).alias("blur_radius"),
        pick(3, 0.3, -5.0 + u(4) * 10.0).alias("rotation_degrees"),
        pick(5, 0.2, 5.0 + u(6) * 10.0).alias("noise_sigma"),
        pick(7, 0.2, (30 + F.floor(u(8) * 41)).cast("int")).alias("jpeg_quality"),
        pick(9, 0.3, 0.7 + w(0) * 0.6).alias("brightness_factor"),
        pick(9, 0.3, 0.7 + w(1) * 0.6).alias("contrast_factor"),
    )


# --- raw grey images (binary PGM) inside tasks ------------------------------------------------------


def read_pgm(content: bytes) -> np.ndarray:
    """Pixels of a binary grey image with one byte per pixel."""
    fields: list[bytes] = []
    at = 0
    while len(fields) < 4:
        end = at
        while content[end : end + 1] not in (b" ", b"\n", b"\t", b"\r"):
            end += 1
        if end > at:
            fields.append(content[at:end])
        at = end + 1
    if fields[0] != b"P5" or fields[3] != b"255":
        raise ValueError("not an 8-bit binary PGM image")
    width, height = int(fields[1]), int(fields[2])
    return np.frombuffer(content, np.uint8, width * height, at).reshape(height, width)


def write_pgm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape
    return f"P5\n{width} {height}\n255\n".encode() + pixels.astype(np.uint8).tobytes()


def image_features(images: DataFrame) -> DataFrame:
    """Size, exposure and blur of each image of a `binaryFile` scan (`path`, `content`)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                v = read_pgm(content).astype(np.float64)
                # Reflected without repeating the border pixel, as far as the image reaches.
                p = np.pad(v, 1, mode="reflect" if min(v.shape) > 1 else "edge")
                lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * v
                glare = float((v > GLARE_LEVEL).mean())
                rows.append(
                    (path, v.shape[1], v.shape[0], float(v.mean()), float(v.std()), glare, float(lap.var()))
                )
            yield pd.DataFrame(
                rows,
                columns=["path", "width", "height", "brightness", "contrast", "saturated_share", "blur"],
            )

    schema = (
        "path string, width int, height int, brightness double, contrast double, "
        "saturated_share double, blur double"
    )
    return images.select("path", "content").mapInPandas(measure, schema)


def image_pixels(images: DataFrame) -> DataFrame:
    """Pixel table of each image; one batch per image keeps memory at one image."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                v = read_pgm(content)
                y, x = np.indices(v.shape)
                yield pd.DataFrame(
                    {"page_id": path, "y": y.ravel(), "x": x.ravel(), "v": v.ravel().astype(np.int32)}
                )

    return images.select("path", "content").mapInPandas(spread, "page_id string, y int, x int, v int")


def crop_lines(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cuts line boxes out of their page image and hashes each cut.

    Boxes travel in arrays of at most `BOXES` line numbers, so an image is shipped to Python once
    for so many boxes, and no array grows with a page.
    """
    part = F.floor(F.col("line_no") / BOXES).alias("part")
    packed = boxes.groupBy("path", part).agg(F.collect_list(F.struct("line_no", "bbox")).alias("boxes"))
    joined = images.select("path", "content").join(packed.drop("part"), "path")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, lines in zip(batch["path"], batch["content"], batch["boxes"]):
                page = read_pgm(content)
                rows = []
                for line in lines:
                    left, top, right, bottom = line["bbox"]
                    rows.append((path, line["line_no"], write_pgm(page[top:bottom, left:right])))
                yield pd.DataFrame(rows, columns=["path", "line_no", "content"])

    cuts = joined.mapInPandas(cut, "path string, line_no int, content binary")
    return cuts.withColumn("sha256", F.sha2("content", 256))
