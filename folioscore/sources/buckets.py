"""Tables laid out by their key, so that joins on the key move no rows.

A table is stored in as many buckets as its joins need, each sorted by the key. Two tables with the
same key and number of buckets join bucket by bucket. The rows are shuffled once, when the table is
written, not in every later join.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from folioscore.functions.digests import packed_texts, unpacked_texts
from folioscore.session import CODEC, staging_path

BUCKETS = 32


def store_by_key(df: DataFrame, keys: Sequence[str], name: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Writes `df` bucketed and sorted by `keys` under `path` (the shared folder by default), and
    returns it as a table. The table's own name is unique; `name` is for people. Digests move as bytes."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    # One task writes one bucket, so a bucket is one file and its sort order is kept.
    bucket = F.pmod(F.hash(*keys), F.lit(buckets))
    moved = packed_texts(df.withColumn("_bucket", bucket)).repartitionById(buckets, F.col("_bucket"))
    dealt = unpacked_texts(moved, df)
    out = dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("compression", CODEC)
    out.option("path", path or staging_path(spark, name)).saveAsTable(table)
    return spark.table(table)
