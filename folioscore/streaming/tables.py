"""Running streams over files, and tables that streams keep up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscore.session import CODEC

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# All stores of an executor share one bounded memory; otherwise each one keeps buffers of its own.
STATE = {
    STATE_STORE: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}


def read_files(spark: SparkSession, schema, path: str, files_per_trigger: int | None = None, name: str | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder; `name` keeps only matching files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path)


def run_available(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Process everything that is there, then stop; the checkpoint lets a later run go on."""
    conf = stream.sparkSession.conf
    before = {key: conf.get(key, None) for key in STATE}
    # Keyed state needs this store, off the heap; a query takes its settings along when it starts.
    for key, value in STATE.items():
        conf.set(key, value)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
    finally:
        for key, value in before.items():
            conf.set(key, value) if value else conf.unset(key)
    query.awaitTermination()


def append_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Each micro-batch into its own folder, so that a repeated batch replaces itself."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", CODEC).parquet(f"{path}/rows/batch={batch_id}")

    run_available(stream, write, f"{path}/checkpoint", mode)
    return spark.read.schema(f"{_ddl(stream)}, batch long").parquet(f"{path}/rows")


def upsert_available(stream: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The latest value per key of an aggregation that runs in update mode.

    After each run the new batches are merged into a kept table and dropped, so neither the
    stored rows nor the work of a later run grow with the number of batches.
    """
    spark = stream.sparkSession
    rows = append_available(stream, path, "update")
    kept = KeptTable(spark, _ddl(rows), f"{path}/latest")
    done, newest = kept.newest(), max(numbered_folders(spark, f"{path}/rows", "batch="), default=-1)
    if newest > done:
        fresh = rows.filter(F.col("batch") > done)
        values = [c for c in rows.columns if c not in keys]
        merged = kept.read().unionByName(fresh).groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
        kept.replace(merged.select(*keys, "v.*").select(*rows.columns), newest)
        drop_folders(spark, f"{path}/rows", "batch=", newest)
    return kept.read().drop("batch")


def numbered_folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished folders <prefix><number> under a path of any file system."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [f.getPath().getName() for f in system.listStatus(root)]
    found = [n for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()]
    done = [n for n in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[len(prefix):]) for n in done)


def drop_folders(spark: SparkSession, path: str, prefix: str, upto: int) -> None:
    """Deletes the folders <prefix><number> of a table of ours with numbers up to `upto`."""
    for n in numbered_folders(spark, path, prefix):
        if n <= upto:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}{n}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class KeptTable:
    """A small table that every micro-batch replaces by a function of itself and the batch.

    Versions are numbered by batch under a path of the caller's, so a later process with the same
    path goes on from the newest finished one, and a repeated batch starts from the version
    before it. The two newest versions are kept.
    """

    def __init__(self, spark: SparkSession, schema: str, path: str):
        self.spark, self.schema, self.path = spark, schema, path

    def newest(self, before: int | None = None) -> int:
        """The newest finished version (before a batch); -1 if there is none."""
        versions = [v for v in numbered_folders(self.spark, self.path, "v") if before is None or v < before]
        return max(versions, default=-1)

    def read(self, before: int | None = None) -> DataFrame:
        version = self.newest(before)
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version}")

    def replace(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
        drop_folders(self.spark, self.path, "v", self.newest(batch_id) - 1)
