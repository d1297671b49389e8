"""Augmentation of grey images: blur, rotation, noise, block compression, brightness and contrast.

The kernels work on stacks of images of one size (image, row, column), so a batch takes a few array
operations, whatever its number of images; every image has its own strength.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from folioscore.operators.pixels import read_pgm, write_pgm

PAPER = 255.0
# Pixels of one stack: bounds a task's memory, a larger image is a stack of its own.
STACK_PIXELS = 4_000_000

# The luminance quantisation table of baseline block compression, row by row.
LUMINANCE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
], float)


def gaussian_blur(stack: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
    """Separable blur; each image has its sigma, and border pixels go on outside."""
    reach = max(1, int(np.ceil(3 * sigmas.max())))
    steps = np.arange(-reach, reach + 1)
    weights = np.exp(-0.5 * (steps / sigmas[:, None]) ** 2)
    weights[np.abs(steps) > np.ceil(3 * sigmas)[:, None]] = 0
    weights /= weights.sum(axis=1, keepdims=True)
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (reach, reach)
        wide, size = np.pad(stack, pad, mode="edge"), stack.shape[axis]
        stack = sum(weights[:, i, None, None] * np.take(wide, range(i, i + size), axis) for i in range(2 * reach + 1))
    return stack


def rotation(stack: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Counter-clockwise about the centre, bilinear, with paper where nothing was."""
    n, height, width = stack.shape
    turn = np.deg2rad(degrees)[:, None, None]
    y, x = (np.arange(s) - (s - 1) / 2 for s in (height, width))
    y, x = y[None, :, None], x[None, None, :]
    source_x = np.cos(turn) * x - np.sin(turn) * y + (width - 1) / 2
    source_y = np.sin(turn) * x + np.cos(turn) * y + (height - 1) / 2
    # One pixel of paper around the image takes part in the interpolation.
    wide = np.pad(stack, [(0, 0), (1, 1), (1, 1)], constant_values=PAPER)
    source_x, source_y = np.clip(source_x + 1, 0, width + 1), np.clip(source_y + 1, 0, height + 1)
    left, top = np.minimum(source_x.astype(int), width), np.minimum(source_y.astype(int), height)
    dx, dy = source_x - left, source_y - top
    which = np.arange(n)[:, None, None]
    upper = wide[which, top, left] * (1 - dx) + wide[which, top, left + 1] * dx
    lower = wide[which, top + 1, left] * (1 - dx) + wide[which, top + 1, left + 1] * dx
    return upper * (1 - dy) + lower * dy


def _cosines() -> np.ndarray:
    """The orthonormal cosine transform of eight values."""
    k, i = np.arange(8)[:, None], np.arange(8)[None, :]
    table = np.cos((2 * i + 1) * k * np.pi / 16) / 2
    table[0] /= np.sqrt(2)
    return table


def block_compression(stack: np.ndarray, qualities: np.ndarray) -> np.ndarray:
    """What lossy 8 x 8 block compression leaves of the images, without the entropy coder."""
    n, height, width = stack.shape
    scale = np.where(qualities < 50, 5000 / qualities, 200 - 2 * qualities)[:, None, None]
    table = np.clip(np.floor((LUMINANCE * scale + 50) / 100), 1, 255)[:, None, None]
    padded = np.pad(stack, [(0, 0), (0, -height % 8), (0, -width % 8)], mode="edge") - 128
    rows, columns = padded.shape[1] // 8, padded.shape[2] // 8
    blocks = padded.reshape(n, rows, 8, columns, 8).transpose(0, 1, 3, 2, 4)
    c = _cosines()
    kept = np.round(c @ blocks @ c.T / table) * table
    back = (c.T @ kept @ c).transpose(0, 1, 3, 2, 4).reshape(padded.shape) + 128
    return back[:, :height, :width]


def augmented(stack: np.ndarray, plan: pd.DataFrame) -> np.ndarray:
    """Applies a plan (`pixels.augmentation_plan`) to images of one size, in its order."""
    out = stack.astype(np.float64)

    def change(column: str, fn) -> None:
        mine = plan[column].notna().to_numpy()
        if mine.any():
            # Every step gives whole grey levels, as an image file would hold them.
            out[mine] = np.clip(np.round(fn(out[mine], plan.loc[mine, column].to_numpy(float), plan[mine])), 0, 255)

    def noise(images, sigmas, rows):
        draws = [np.random.default_rng(int(s[:15], 16)).normal(0, sigma, images.shape[1:]) for s, sigma in zip(rows["sample_id"], sigmas)]
        return images + np.stack(draws)

    def contrast(images, factors, rows):
        mean = images.mean(axis=(1, 2), keepdims=True)
        return mean + (images - mean) * factors[:, None, None]

    change("blur_radius", lambda images, sigmas, _: gaussian_blur(images, sigmas))
    change("rotation_degrees", lambda images, degrees, _: rotation(images, degrees))
    change("noise_sigma", noise)
    change("jpeg_quality", lambda images, qualities, _: block_compression(images, qualities))
    change("brightness_factor", lambda images, factors, _: images * factors[:, None, None])
    change("contrast_factor", contrast)
    return out.astype(np.uint8)


def augment(images: DataFrame, plan: DataFrame) -> DataFrame:
    """sample_id and content of every image that the plan names; noise is seeded by the sample, so a
    task that runs again gives the same bytes."""

    def stacks(frame: pd.DataFrame, arrays: list[np.ndarray]) -> Iterator[list[int]]:
        sizes: dict[tuple, list[int]] = {}
        for i, a in enumerate(arrays):
            sizes.setdefault(a.shape, []).append(i)
        for (height, width), members in sizes.items():
            step = max(1, STACK_PIXELS // max(1, height * width))
            for at in range(0, len(members), step):
                yield members[at:at + step]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = [read_pgm(c) for c in batch["content"]]
            for members in stacks(batch, arrays):
                rows = batch.iloc[members]
                done = augmented(np.stack([arrays[i] for i in members]), rows)
                yield pd.DataFrame({"sample_id": rows["sample_id"].to_numpy(), "content": [write_pgm(d) for d in done]})

    return images.select("sample_id", "content").join(plan, "sample_id").mapInPandas(run, "sample_id string, content binary")
