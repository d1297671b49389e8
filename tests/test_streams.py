"""Streams that stop and start again."""

from pyspark.sql import functions as F

from folioscore.streaming import counters, tables, work

ITEM = "item_id string, confidence double, priority_score double"


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_the_queue_survives_a_restart(spark, tmp_path):
    source, kept, checkpoint = (str(tmp_path / n) for n in ("items", "queue", "checkpoint"))

    def run():
        stream = tables.read_files(spark, spark.createDataFrame([], ITEM).schema, source, files_per_trigger=1)
        # A new object each time, as in a new process.
        return [r["item_id"] for r in work.live_queue(stream, tables.KeptTable(spark, ITEM, kept), 3, checkpoint).orderBy("item_id").collect()]

    write(spark, [("a", 0.1, 0.9)], ITEM, source)
    write(spark, [("b", 0.1, 0.8), ("z", 0.1, 0.1)], ITEM, source)
    assert run() == ["a", "b", "z"]
    write(spark, [("c", 0.1, 0.7)], ITEM, source)
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]
    assert len(tables.numbered_folders(spark, kept, "v")) <= 2


def test_upserts_keep_one_version_and_go_on(spark, tmp_path):
    source, path = str(tmp_path / "pages"), str(tmp_path / "table")
    schema = "job_id string, status string, ts timestamp"

    def rows(*days):
        return [("j1", "completed" if d % 2 else "failed", f"2024-05-{d:02d} 10:00:00") for d in days]

    def add(days):
        frame = spark.createDataFrame(rows(*days), "job_id string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = tables.read_files(spark, spark.createDataFrame([], schema).schema, source, files_per_trigger=1)
        kept = tables.upsert_available(counters.job_counters(stream), ["window_start", "job_id"], path)
        return tuple(counters.job_totals(kept).head())

    add([1, 1, 2])
    add([3, 4])
    assert run() == ("j1", 5, 3, 2)
    add([4, 5])
    # The window of day 4 gets its new total, the others keep theirs.
    assert run() == ("j1", 7, 4, 3)
    # Later than the watermark: not counted.
    add([1])
    assert run() == ("j1", 7, 4, 3)
    assert tables.numbered_folders(spark, f"{path}/rows", "batch=") == []
