"""Set reconciliation: the few rows in which two large tables differ, without grouping the tables.

Every table becomes a sketch of a fixed number of cells (an invertible Bloom lookup table): a row's
id goes into one cell of each third, where counts, ids and checks of ids add up. Adding up combines
in the map tasks, so a sketch costs one pass and shuffles cells only; it can be stored with a table,
which then need not be read again. The difference of two sketches holds what the tables do not
share: a cell with one kind of row gives its id away, is taken out everywhere, and so on. Sums, not
exclusive ors, so rows that occur more often on one side are found too. The ids pick the rows, which
are then compared exactly. If the difference is too large for the sketch, more cells are tried, and
beyond the bound all rows are grouped: the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, functions as F

from folioscore.operators.fingerprints import table_difference

THIRDS = 3
CELLS = 3 * 2048
MOST_CELLS = 3 * 65_536
SKETCH = "cell long, n long, low long, high long, checks long"


def row_id(columns: Iterable[str]) -> Column:
    """A 64-bit id of a row's values; nulls count as values."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def sketch(df: DataFrame, cells: int = CELLS, columns: Iterable[str] | None = None) -> DataFrame:
    """At most `cells` rows, a multiple of three; cells that no row meets are left out."""
    third = cells // THIRDS
    ids = df.select(row_id(columns or df.columns).alias("id"))
    text = F.col("id").cast("string")
    place = F.array(*[F.pmod(F.crc32(F.concat(text, F.lit(f":{j}"))), F.lit(third)) + j * third for j in range(THIRDS)])
    spread = ids.select("id", F.crc32(text).alias("check"), F.explode(place).alias("cell"))
    return spread.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum(F.col("id").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright("id", 32)).alias("high"),
        F.sum("check").alias("checks"),
    )


def sketch_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells of the left without those of the right; cells that agree are left out."""
    values = ("n", "low", "high", "checks")
    negated = right.select("cell", *[(-F.col(v)).alias(v) for v in values])
    sums = left.select("cell", *values).unionByName(negated).groupBy("cell").agg(*[F.sum(v).alias(v) for v in values])
    return sums.filter(" or ".join(f"{v} <> 0" for v in values))


def peeled(cells: Iterable[Row], total: int) -> dict[int, int] | None:
    """Row ids with their surplus, or None if the cells do not come apart."""
    third = total // THIRDS
    table = {c["cell"]: [c["n"], c["low"], c["high"], c["checks"]] for c in cells}

    def only(cell: int) -> int | None:
        n, low, high, checks = table[cell]
        if n == 0 or low % n or high % n or checks % n:
            return None
        number = (high // n << 32) + low // n
        return number if zlib.crc32(str(number).encode()) == checks // n else None

    found: dict[int, int] = {}
    waiting = list(table)
    while waiting:
        cell = waiting.pop()
        if cell not in table or not any(table[cell]) or (number := only(cell)) is None:
            continue
        n = table[cell][0]
        found[number] = found.get(number, 0) + n
        share = (n, n * (number & 0xFFFFFFFF), n * (number >> 32), n * zlib.crc32(str(number).encode()))
        for j in range(THIRDS):
            place = zlib.crc32(f"{number}:{j}".encode()) % third + j * third
            left = table.setdefault(place, [0, 0, 0, 0])
            for i, value in enumerate(share):
                left[i] -= value
            waiting.append(place)
    return None if any(any(v) for v in table.values()) else {k: v for k, v in found.items() if v}


def differing_ids(left: DataFrame, right: DataFrame, cells: int) -> dict[int, int] | None:
    """Ids with their surplus from two sketches of `cells` cells, or None. The cells are bounded by
    the parameter, and pass through the driver only where the tables differ."""
    return peeled(sketch_difference(left, right).collect(), cells)


def differing_rows(
    left: DataFrame, right: DataFrame, *, cells: int = CELLS, most_cells: int = MOST_CELLS, left_sketch: DataFrame | None = None,
) -> DataFrame:
    """The rows that two tables do not share, with `surplus` (above zero: the left has more).

    `left_sketch` is a stored sketch of the left with `cells` cells.
    """
    columns = left.columns
    right = right.select(*columns)
    while cells <= most_cells:
        ids = differing_ids(left_sketch if left_sketch is not None else sketch(left, cells), sketch(right, cells, columns), cells)
        if ids is not None:
            break
        cells, left_sketch = cells * 4, None
    else:
        return table_difference(left, right)
    # As many ids as cells at most, so the broadcast is bounded by the parameter.
    wanted = F.broadcast(left.sparkSession.createDataFrame([(i,) for i in ids], "wanted_id long"))
    picked = [side.join(wanted, row_id(columns) == F.col("wanted_id"), "left_semi") for side in (left, right)]
    return table_difference(*picked)
