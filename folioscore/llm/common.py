"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioscore.session import shared_dir, ship_package

MASK = (1 << 64) - 1
# An odd multiplier has an inverse modulo 2**64, which turns prefix hashes into range hashes.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def own_name(use: str) -> str:
    """A column name that no table has."""
    return f"_{use}_{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the cluster's checkpoint folder: short lineage, safe from lost executors."""
    ship_package(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint()


def first_of_each(batches):
    """One row of each hexadecimal key, the first column, in this task."""
    seen = set()
    for batch in batches:
        fresh = []
        for i, key in enumerate(batch.column(0).to_pylist()):
            digest = bytes.fromhex(key)
            if digest not in seen:
                seen.add(digest)
                fresh.append(i)
        yield batch if len(fresh) == batch.num_rows else batch.take(pa.array(fresh, pa.int64()))


def crc_bucket(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; null values fall into bucket 0."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.pmod(F.crc32(text.cast("string")), F.lit(modulus)), F.lit(0)).cast("int")


def crc_remainder(value: object, modulus: int) -> int:
    """The same number in Python."""
    return 0 if value is None else zlib.crc32(str(value).encode()) % modulus


def mixed(keys: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of keys."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((salt * BASE) & MASK)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    filled = 1
    with np.errstate(over="ignore"):
        while filled < n:
            step = min(filled, n - filled)
            out[filled:filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
    return out[:n]


class RangeHash:
    """Hashes of any byte ranges of one buffer: equal ranges have equal hashes."""

    _up = powers(1 << 12)
    _down = powers(1 << 12, BASE_INVERSE)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(RangeHash._up) < n:
            RangeHash._up = powers(n)
            RangeHash._down = powers(n, BASE_INVERSE)
        self.down = RangeHash._down
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(n, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * RangeHash._up[:n - 1], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.prefix[end] - self.prefix[start]) * self.down[start])


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words between ASCII white space.

    A text with fewer words has one shingle of all of them; a text without words has none.
    """
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
    if not joined:
        return np.empty(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(data)]))
    take = min(words, len(starts))
    return np.unique(RangeHash(data).of(starts[:len(starts) - take + 1], ends[take - 1:]))
