"""Pages of an ordered result by a rank index, without sorting the result for each page.

The result is stored once in its order, in ranges of rows, each with the position of every row.
The index has one row for each range: its first position, its number of rows and its least key.
A page reads the ranges that hold its positions; the page after a key (keyset paging) finds the
key's range in the index first. Either way a page costs a few files, whatever its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscore.operators.ordering import global_position

RANGE_ROWS = 100_000


def store_ranked(results: DataFrame, order_by: Sequence[str], path: str, range_rows: int = RANGE_ROWS) -> None:
    """Writes `path`/rows, in ranges of `range_rows`, and `path`/index. Keys ascend, nulls first."""
    keys = [F.col(c) for c in order_by]
    placed = global_position(results, keys, "position")
    ranged = placed.withColumn("range", F.floor((F.col("position") - 1) / range_rows))
    # Consecutive positions already lie together; a range ends up in one file, sorted.
    ranged.repartition("range").sortWithinPartitions("range", "position").write.partitionBy("range").parquet(f"{path}/rows")
    stored = results.sparkSession.read.parquet(f"{path}/rows")
    index = stored.groupBy("range").agg(
        F.min("position").alias("first_position"), F.count("*").alias("rows"), F.min(F.struct("position", *order_by)).alias("least"),
    )
    index.select("range", "first_position", "rows", *[F.col(f"least.{c}").alias(c) for c in order_by]).write.parquet(f"{path}/index")


def _between(spark: SparkSession, path: str, first: int, rows: int) -> DataFrame:
    """Positions `first` to `first + rows - 1`, from the ranges that hold them."""
    index = spark.read.parquet(f"{path}/index")
    last = first + rows - 1
    held = index.filter((F.col("first_position") <= last) & (F.col("first_position") + F.col("rows") > first))
    # As many ranges as the page touches.
    ranges = [r["range"] for r in held.select("range").collect()]
    stored = spark.read.parquet(f"{path}/rows").filter(F.col("range").isin(ranges) if ranges else F.lit(False))
    return stored.filter(F.col("position").between(first, last)).drop("range")


def page(spark: SparkSession, path: str, number: int, per_page: int) -> DataFrame:
    """Page `number`, counted from 1, with `position`; beyond the end it is empty."""
    if number < 1 or per_page < 1:
        raise ValueError("number and per_page start at 1")
    return _between(spark, path, (number - 1) * per_page + 1, per_page)


def _above(order_by: Sequence[str], after: Sequence) -> Column:
    """Keys after `after` in ascending order."""
    above = F.lit(False)
    for name, value in reversed(list(zip(order_by, after))):
        # Nulls come first, so every other value is above a null.
        more = F.col(name).isNotNull() if value is None else F.coalesce(F.col(name) > F.lit(value), F.lit(False))
        above = more | (F.col(name).eqNullSafe(F.lit(value)) & above)
    return above


def page_after(spark: SparkSession, path: str, order_by: Sequence[str], after: Sequence, per_page: int) -> DataFrame:
    """The `per_page` rows that follow the key `after`, also if no row has that key."""
    index = spark.read.parquet(f"{path}/index")
    above = _above(order_by, after)
    # The last range that does not begin after the key holds the first row that does, or the next one.
    own = index.filter(~above).agg(F.max("range")).first()[0] or 0
    stored = spark.read.parquet(f"{path}/rows").filter(F.col("range").isin(own, own + 1))
    first = stored.filter(above).agg(F.min("position")).first()[0]
    return _between(spark, path, first or (1 << 62), per_page)


def total_rows(spark: SparkSession, path: str) -> DataFrame:
    """`total` and the number of `ranges`, from the index alone."""
    return spark.read.parquet(f"{path}/index").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"), F.count("*").alias("ranges"))
