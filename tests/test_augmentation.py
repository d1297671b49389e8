"""Kernels against plain loops, and images kept as row arrays against the pixel table."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscore.operators import augmentation as A, pixels as X, row_images as RI

RNG = np.random.default_rng(11)


def images(n, height, width):
    return RNG.integers(0, 256, (n, height, width)).astype(float)


def test_blur_against_loops():
    stack, sigmas = images(3, 7, 9), np.array([0.5, 1.3, 2.0])
    got = A.gaussian_blur(stack, sigmas)
    for image, sigma, out in zip(stack, sigmas, got):
        reach = math.ceil(3 * sigma)
        weights = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)}
        total = sum(weights.values())
        height, width = image.shape
        for y in range(height):
            for x in range(width):
                want = sum(
                    weights[a] * weights[b] * image[min(max(y + a, 0), height - 1), min(max(x + b, 0), width - 1)]
                    for a in weights for b in weights
                ) / total**2
                assert out[y, x] == pytest.approx(want)


def test_rotation_against_loops():
    stack, degrees = images(3, 6, 10), np.array([-5.0, 3.3, 90.0])
    got = A.rotation(stack, degrees)
    for image, angle, out in zip(stack, degrees, got):
        height, width = image.shape
        level = lambda y, x: image[y, x] if 0 <= y < height and 0 <= x < width else 255.0
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        for y in range(height):
            for x in range(width):
                u, v = x - (width - 1) / 2, y - (height - 1) / 2
                sx = min(max(c * u - s * v + (width - 1) / 2, -1), width)
                sy = min(max(s * u + c * v + (height - 1) / 2, -1), height)
                x0, y0 = math.floor(sx), math.floor(sy)
                fx, fy = sx - x0, sy - y0
                want = (level(y0, x0) * (1 - fx) + level(y0, x0 + 1) * fx) * (1 - fy) + (level(y0 + 1, x0) * (1 - fx) + level(y0 + 1, x0 + 1) * fx) * fy
                assert out[y, x] == pytest.approx(want, abs=1e-6)
    square = images(1, 5, 5)
    assert np.allclose(A.rotation(square, np.array([90.0]))[0], np.rot90(square[0]))


def test_compression_against_loops():
    stack, qualities = images(2, 8, 8), np.array([30.0, 70.0])
    got = A.block_compression(stack, qualities)
    scale = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    wave = lambda i, k: math.cos((2 * i + 1) * k * math.pi / 16)
    for image, quality, out in zip(stack, qualities, got):
        factor = 5000 / quality if quality < 50 else 200 - 2 * quality
        kept = np.zeros((8, 8))
        for u in range(8):
            for v in range(8):
                value = sum((image[y, x] - 128) * wave(y, u) * wave(x, v) for y in range(8) for x in range(8)) * scale(u) * scale(v) / 4
                step = min(max(math.floor((A.LUMINANCE[u, v] * factor + 50) / 100), 1), 255)
                kept[u, v] = np.round(value / step) * step
        want = [[128 + sum(scale(u) * scale(v) * kept[u, v] * wave(y, u) * wave(x, v) for u in range(8) for v in range(8)) / 4 for x in range(8)] for y in range(8)]
        assert np.allclose(out, want)
    # Sizes that are no multiple of eight, and a flat image, which survives.
    assert A.block_compression(images(2, 13, 5), qualities).shape == (2, 13, 5)
    assert np.allclose(A.block_compression(np.full((1, 9, 9), 77.0), np.array([70.0])), 77, atol=8)


def test_draws_are_independent(spark):
    samples = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("sample_id"))
    plan = X.augmentation_plan(samples).toPandas()
    strengths = ["blur_radius", "rotation_degrees", "noise_sigma", "jpeg_quality", "brightness_factor", "contrast_factor"]
    corr = plan[strengths].astype(float).corr(min_periods=30).to_numpy()
    assert np.nanmax(np.abs(corr - np.eye(len(strengths)))) < 0.35
    assert abs(np.corrcoef(*plan[["brightness_factor", "contrast_factor"]].dropna().to_numpy(float).T)[0, 1]) < 0.12


def test_a_batch_of_many_sizes(spark):
    """Every image comes out as if it were alone."""
    rows = [(f"{i:064x}", bytearray(X.write_pgm(images(1, 3 + i % 3, 4 + i % 2)[0]))) for i in range(40)]
    files = spark.createDataFrame(rows, "sample_id string, content binary")
    plan = X.augmentation_plan(files)
    got = {r["sample_id"]: bytes(r["content"]) for r in A.augment(files, plan).collect()}
    table = plan.toPandas()
    for sample_id, content in rows:
        row = table[table["sample_id"] == sample_id]
        alone = A.augmented(X.read_pgm(bytes(content))[None], row)[0]
        assert got[sample_id] == X.write_pgm(alone)
    changed = table["augmented"]
    assert all(got[s] == bytes(dict(rows)[s]) for s in table[~changed]["sample_id"]) and changed.any()


def pixel_table(spark, pages):
    rows = [(p, y, x, int(v)) for p, a in pages.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["page_id", "y", "x", "v"]), "page_id string, y long, x long, v int")


@pytest.fixture(scope="module")
def pages(spark):
    inked = np.full((60, 40), 255)
    inked[3:9, 4:30] = 10
    inked[20:22, 0:40] = 0
    inked[50:60, 7:9] = 20
    shapes = {"one": (1, 1), "row": (1, 6), "column": (5, 1), "two": (2, 2), "odd": (7, 11)}
    made = {k: RNG.integers(0, 256, s) for k, s in shapes.items()} | {"inked": inked, "blank": np.full((4, 4), 255)}
    return pixel_table(spark, made)


def same(a, b, *keys):
    names = sorted(a.columns)
    left, right = (f.select(*names).toPandas().sort_values(list(keys)).reset_index(drop=True) for f in (a, b))
    pd.testing.assert_frame_equal(left, right, check_dtype=False, atol=1e-9)


def test_row_arrays_measure_the_same(spark, pages):
    rows = RI.rows_of_pixels(pages)
    same(RI.row_exposure(rows), X.exposure(pages), "page_id")
    same(RI.row_blur_variance(rows), X.blur_variance(pages), "page_id")
    same(RI.row_ink(rows), X.row_profile(pages), "page_id", "y")
    same(RI.row_text_lines(RI.row_ink(rows), 1), X.text_lines(X.row_profile(pages), 1), "page_id", "y1")


def test_one_shuffle_of_rows(spark, pages):
    rows = spark.createDataFrame(RI.rows_of_pixels(pages).toPandas(), "page_id string, y long, levels array<int>")
    plan = RI.row_blur_variance(rows)._jdf.queryExecution().executedPlan().toString()
    # The window's own shuffle serves the sums of each page as well.
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in RI.row_ink(rows)._jdf.queryExecution().executedPlan().toString()
