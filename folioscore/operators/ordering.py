"""Ordered operators that never put a whole group, or the whole table, into one task.

A plain window over a hot key sorts that key's rows in a single task. The operators here
split every group by an order-preserving bucket, work inside (group, bucket), and carry the
running totals between buckets over a table that holds one row per bucket only. The bucket
must be monotone in the ordering and take a bounded number of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.session import shared_dir


def _bucketed(df: DataFrame, keys: Sequence[str], bucket: Column) -> tuple[DataFrame, list[str]]:
    return df.withColumn("_bucket", bucket), [*keys, "_bucket"]


def _preceding(keys: Sequence[str], order: Sequence[Column] | None = None):
    ordering = order or [F.col("_bucket").asc()]
    window = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return window.orderBy(*ordering).rowsBetween(W.unboundedPreceding, -1)


def position_within(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    bucket: Column,
    name: str = "position",
    bucket_order: Sequence[Column] | None = None,
) -> DataFrame:
    """`row_number` of each row inside its group, starting at 1, safe for hot groups."""
    df, parts = _bucketed(df, keys, bucket)
    inner = W.partitionBy(*parts)
    ranked = df.withColumns(
        {
            "_rank": F.row_number().over(inner.orderBy(*order_by)).cast("long"),
        }
    )
    sizes = df.groupBy(*parts).agg(F.count("*").alias("_size"))
    offsets = sizes.withColumn(
        "_before", F.coalesce(F.sum("_size").over(_preceding(keys, bucket_order)), F.lit(0))
    ).drop("_size")
    return (
        _join_parts(ranked, offsets, parts)
        .withColumn(name, F.col("_rank") + F.col("_before"))
        .drop("_rank", "_before", "_bucket")
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    bucket: Column,
    sums: dict[str, str],
    bucket_order: Sequence[Column] | None = None,
) -> DataFrame:
    """Inclusive running sums in order: `sums` maps each output name to its input column."""
    df, parts = _bucketed(df, keys, bucket)
    inner = W.partitionBy(*parts).orderBy(*order_by)
    within = df.withColumns(
        {
            f"_in_{out}": F.sum(src).over(inner.rowsBetween(W.unboundedPreceding, W.currentRow))
            for out, src in sums.items()
        }
    )
    totals = df.groupBy(*parts).agg(*[F.sum(s).alias(f"_sz_{o}") for o, s in sums.items()])
    preceding = _preceding(keys, bucket_order)
    carried = totals.select(
        *parts,
        *[
            F.coalesce(F.sum(f"_sz_{o}").over(preceding), F.lit(0)).alias(f"_be_{o}")
            for o in sums
        ],
    )
    joined = _join_parts(within, carried, parts)
    done = joined.withColumns({o: F.col(f"_in_{o}") + F.col(f"_be_{o}") for o in sums})
    return done.drop("_bucket", *[f"_in_{o}" for o in sums], *[f"_be_{o}" for o in sums])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    bucket: Column,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """`lag`/`lead` by one row, carried across buckets; maps output name to input column."""
    previous, following = previous or {}, following or {}
    df, parts = _bucketed(df, keys, bucket)
    inner = W.partitionBy(*parts).orderBy(*order_by)
    payload = sorted({*previous.values(), *following.values()})
    packed = df.withColumn("_row", F.struct(*payload))
    near = packed.withColumns(
        {"_lag": F.lag("_row").over(inner), "_lead": F.lead("_row").over(inner)}
    ).drop("_row")
    # The first row of a bucket has no lag and the last one no lead: those two rows are the
    # bucket's edges, so the edge table is a filter on the window and not another sort.
    edges = (
        packed.withColumns(
            {"_lag": F.lag("_row").over(inner), "_lead": F.lead("_row").over(inner)}
        )
        .filter(F.col("_lag").isNull() | F.col("_lead").isNull())
        .groupBy(*parts)
        .agg(
            F.max(F.when(F.col("_lag").isNull(), F.struct("_row"))).alias("_first"),
            F.max(F.when(F.col("_lead").isNull(), F.struct("_row"))).alias("_last"),
        )
    )
    across = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    across = across.orderBy("_bucket")
    carried = edges.select(
        *parts,
        F.lag("_last").over(across)["_row"].alias("_from_before"),
        F.lead("_first").over(across)["_row"].alias("_from_after"),
    )
    joined = _join_parts(near, carried, parts)
    before = F.coalesce("_lag", "_from_before")
    after = F.coalesce("_lead", "_from_after")
    joined = joined.withColumns(
        {
            **{out: before[src] for out, src in previous.items()},
            **{out: after[src] for out, src in following.items()},
        }
    )
    return joined.drop("_bucket", "_lag", "_lead", "_from_before", "_from_after")


def _join_parts(rows: DataFrame, per_part: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Attach one row per (group, bucket), null-safe in the group keys."""
    renamed = per_part.select(
        *[F.col(p).alias(f"_k_{p}") for p in parts],
        *[c for c in per_part.columns if c not in parts],
    )
    condition = F.lit(True)
    for p in parts:
        condition = condition & F.col(p).eqNullSafe(F.col(f"_k_{p}"))
    return rows.join(renamed, condition, "left").drop(*[f"_k_{p}" for p in parts])


def hash_bucket(hash_column: Column, hex_digits: int = 3) -> Column:
    """Order-preserving bucket of a uniform hex digest: 16**digits even parts."""
    return F.substring(hash_column, 1, hex_digits)


def global_position(
    df: DataFrame, order_by: Sequence[Column], name: str = "position", keep: Sequence[str] | None = None
) -> DataFrame:
    """Position of each row in a total order of the whole table, starting at 1; of its columns those in `keep`, or all.

    Range partitioning spreads the sort; the sorted partitions are checkpointed in the shared
    folder, because positions are only right if every pass sees the same partition bounds.
    Only the partition sizes, one row per partition, pass through a single task.
    """
    shared_dir(df.sparkSession)
    ranged = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .select(*(df.columns if keep is None else keep), F.monotonically_increasing_id().alias("_seq"))
        .checkpoint()
    )
    # The id counts up inside a partition, in the sorted order, from part * 2**33.
    ranged = ranged.withColumn("_part", F.shiftright("_seq", 33).cast("int")).withColumn("_rank", F.col("_seq") - F.shiftleft(F.col("_part").cast("long"), 33) + 1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.select(
        F.col("_part").alias("_k_part"),
        F.coalesce(
            F.sum("_size").over(
                W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    # One row per partition, so the number of partitions bounds the broadcast.
    joined = ranged.join(F.broadcast(offsets), F.col("_part") == F.col("_k_part"))
    return joined.withColumn(name, F.col("_rank") + F.col("_before")).drop(
        "_part", "_k_part", "_seq", "_rank", "_before"
    )
