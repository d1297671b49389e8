"""Digests move and are kept as half their text, without a change of any value."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from folioscore.functions.digests import packed, unpacked
from folioscore.operators import inference, manifest
from folioscore.operators.rules import InvalidRows
from folioscore.queries.inputs import Inputs
from folioscore.sources import sinks
from folioscore.sources.buckets import store_by_key

DIGEST = "0123456789abcdef" * 4


def written(spark, run):
    """What `run` gives, and the bytes that its tasks shuffle."""
    total = lambda: sum(e.totalShuffleWrite() for e in [executors().apply(0)])
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    before = total()
    return run(), total() - before


def test_any_text_comes_back(spark):
    texts = [DIGEST, DIGEST.upper(), DIGEST[1:], "ab", "abc", "", None, "\0", "\1ab", "0g", "é", "ab ", "00", "a" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", packed(F.col("t")).alias("p"))
    got = dict(rows.select("i", unpacked(F.col("p"))).collect())
    assert [got[i] for i in range(len(texts))] == texts
    assert rows.filter("length(p) = 33").count() == 1


def test_buckets_are_dealt_as_bytes(spark, tmp_path):
    rows = spark.range(20_000).select(*[F.sha2(F.concat(F.lit(c), "id"), 256).alias(c) for c in ("sample_id", "source_sha256")], (F.col("id") % 7).alias("n"))
    rows = rows.unionByName(spark.createDataFrame([(None, "not a digest", 1), ("AB", None, None)], rows.schema))
    table, moved = written(spark, lambda: store_by_key(rows, ["sample_id", "source_sha256"], "digests", 8, str(tmp_path / "t")))
    assert table.exceptAll(rows).isEmpty() and rows.exceptAll(table).isEmpty()
    assert moved < 20_000 * 100
    files = list((tmp_path / "t").glob("*.parquet"))
    # One file a bucket, or the sort order of a bucket would be lost.
    assert len(files) == 8 and sum(f.stat().st_size for f in files) < 20_000 * 100


def _manifest(spark, n):
    digest = lambda c: F.sha2(F.concat(F.lit(c), "id"), 256)
    return spark.range(n).select(
        digest("s").alias("sample_id"), digest("f").alias("source_sha256"), F.lit("the same words").alias("reference"),
        F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"),
    )


def test_a_manifest_table_moves_no_rows(spark, tmp_path):
    rows = _manifest(spark, 20_000)
    _, moved = written(spark, lambda: sinks.write_manifest_table(rows, str(tmp_path / "t")))
    assert moved == 0
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.select(rows.columns).exceptAll(rows).isEmpty() and table.count() == 20_000


def test_a_manifest_is_sorted_as_bytes(spark, tmp_path):
    odd = spark.createDataFrame([("Z", None, "", "test"), ("a", "b", "ab", None), (None, "c", None, "test"), ("0", "d", "x", "test")], "sample_id string, source_sha256 string, reference string, split string")
    rows = _manifest(spark, 20_000).unionByName(odd)
    _, moved = written(spark, lambda: sinks.write_manifest(rows, str(tmp_path / "m")))
    assert moved < 20_000 * 100
    lines = spark.read.schema(rows.schema).json(str(tmp_path / "m"))
    assert lines.exceptAll(rows).isEmpty() and lines.count() == 20_004
    files = sorted((tmp_path / "m").glob("*.gz"))
    kept = [json.loads(line)["sample_id"] for f in files for line in gzip.open(f, "rt")]
    assert kept[0] is None and kept[1:] == sorted(kept[1:])


def test_files_join_as_bytes(spark):
    labels = spark.range(20_000).select(F.col("id").cast("string").alias("filename"), F.lit("t").alias("text"), F.lit("w").alias("writer_id"), F.lit("a").alias("slices"))
    files = labels.select("filename", F.sha2("filename", 256).alias("source_sha256")).filter("filename <> '7'")
    files = files.unionByName(spark.createDataFrame([("7", "not a digest")], files.schema))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        identity = manifest.DatasetIdentity("lines", "v1", "x", "https://example.org", "line")
        found, moved = written(spark, lambda: manifest.build_manifest(labels, files, identity).select("image_path", "source_sha256").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {f"images/{r['filename']}": r["source_sha256"] for r in files.collect()}
    assert {r["image_path"]: r["source_sha256"] for r in found} == want and want["images/7"] == "not a digest"
    assert moved < 20_000 * 62


def _samples(spark, n):
    digest = lambda c: F.sha2(F.concat(F.lit(c), "id"), 256)
    return spark.range(n).select(digest("s").alias("sample_id"), digest("f").alias("source_sha256"), F.concat(F.lit("the same words "), "id").alias("reference"))


def test_a_resumed_run_compares_digests(spark):
    rows = _samples(spark, 20_000)
    done = rows.limit(6_000).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, moved = written(spark, lambda: inference.resume(rows, done).count())
        assert left == 14_000 and moved < 20_000 * 200
        for change in (
            done.withColumn("sample_id", F.lit("other")), done.withColumn("sample_id", F.lit(None).cast("string")),
            done.withColumn("source_sha256", F.lit("0" * 64)), done.withColumn("reference", F.lit("changed")),
        ):
            with pytest.raises(InvalidRows):
                inference.resume(rows, change)
        # As before, a hash that is not known on the side of the predictions is no mismatch.
        assert inference.resume(rows, done.withColumn("source_sha256", F.lit(None).cast("string"))).count() == 14_000
        # Nor may a second row of a sample in the manifest differ.
        twice = rows.unionByName(done.limit(1).withColumn("reference", F.lit("again")))
        with pytest.raises(InvalidRows):
            inference.resume(twice, done)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_published_ids_are_compared_by_digest(spark, tmp_path):
    rows = _samples(spark, 20_000)
    _, moved = written(spark, lambda: sinks.publish_predictions(rows, rows, str(tmp_path / "final")))
    assert moved < 20_000 * 2 * 40
    for partial in (rows.filter("reference <> 'the same words 7'"), rows.unionByName(rows.limit(1))):
        with pytest.raises(InvalidRows):
            sinks.publish_predictions(partial, rows, str(tmp_path / "other"))


def test_both_versions_of_a_line_stand_together(spark, small, tmp_path):
    """So a compressed file holds what they share once; the lines are derived once for both."""
    t = Inputs(spark, small)
    ids = [r["instance_id"] for r in t.instances.select("instance_id").limit(200).collect()]
    assert ids[::2] == ids[1::2]
    both = t.pairs.withColumn("model_version", F.lit("v1")).unionByName(t.baseline.withColumn("model_version", F.lit("v2")))
    key = lambda df, *c: df.select(*c, "confidence", "model_version")
    got, want = key(t.instances, "instance_id", "predicted_text", "reference_text"), key(both, "sample_id", "prediction", "reference")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
