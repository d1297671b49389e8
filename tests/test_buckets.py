"""Joins over tables stored by key move no rows and give the rows of ordinary joins."""

import pytest
from pyspark.sql import functions as F

from folioscore.operators import inference
from folioscore.sources.buckets import store_by_key


@pytest.fixture(scope="module")
def sides(spark):
    """Larger than a broadcast would take."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("sample_id"), F.sha2(F.col("id").cast("string"), 256).alias("source_sha256"),
        F.concat(F.lit("r"), F.col("id")).alias("reference"), F.array(F.lit("a")).alias("slices"), F.lit("p").alias("prediction"),
    )
    # Nine in ten, some with another hash, one key with many rows.
    partial = rows.filter("cast(sample_id as long) % 10 <> 0").withColumn(
        "source_sha256", F.when(F.col("sample_id").endswith("7"), F.lit("0" * 64)).otherwise(F.col("source_sha256"))
    )
    partial = partial.unionByName(partial.filter("sample_id = '1'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n"))
    yield rows, partial
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_joins_without_an_exchange(spark, sides):
    rows, partial = sides
    by_id = [store_by_key(df, ["sample_id"], name, 4) for df, name in ((rows, "rows"), (partial, "partial-rows"))]
    by_both = [store_by_key(df, ["sample_id", "source_sha256"], "both", 4) for df in (rows, partial)]
    left = inference.remaining(by_id[0], by_id[1])
    mismatches = inference.partial_mismatches(by_id[1], by_id[0])
    gold = inference.join_gold(by_both[1].drop("reference", "slices"), by_both[0])
    for df, plainly in (
        (left, inference.remaining(rows, partial)), (mismatches, inference.partial_mismatches(partial, rows)),
        (gold, inference.join_gold(partial.drop("reference", "slices"), rows)),
    ):
        assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)
        same(df, plainly)


def test_empty_tables(spark, sides):
    empty = store_by_key(sides[0].limit(0), ["sample_id"], "none", 4)
    assert empty.count() == 0 and inference.remaining(store_by_key(sides[0], ["sample_id"], "some", 4), empty).count() == 400


def test_buckets_grow_with_the_texts(spark, small, monkeypatch):
    from folioscore.queries import diagnosis as D
    from folioscore.queries.inputs import Inputs

    t = Inputs(spark, small)
    (size,) = t.table("documents").agg(F.sum(F.octet_length("text"))).first()
    monkeypatch.setattr(D, "BUCKET_BYTES", size // 20)
    ids = spark.range(5_000).select(F.col("id").cast("string").alias("sample_id"))
    assert len(D._by_id(t, ids, "ids").inputFiles()) == size // (size // 20)
