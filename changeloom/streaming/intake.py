"""Incremental labelling with Structured Streaming."""

from __future__ import annotations

import hashlib
import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys of other runs are filed in so many buckets of their hash; a batch reads those that it touches.
KEY_BUCKETS = 256
# Keys seen are kept by executors in an embedded store that spills to disk; a batch saves what it changed.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_store(spark: SparkSession):
    """A query keeps the settings that hold when it starts."""
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _children(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def other_runs(spark: SparkSession, output: str, run: str) -> list[str]:
    """Folders of batches that runs with another checkpoint have written."""
    runs = [name for name in _children(spark, output) if name.startswith("run_id=") and name != f"run_id={run}"]
    return [f"{name}/{batch}" for name in runs for batch in _children(spark, f"{output}/{name}") if batch.startswith("batch_id=")]


def _keys_of_others(spark: SparkSession, output: str, folder: str, run: str, key: str) -> str | None:
    """Index of the keys that other runs have written, by bucket; made once, until others write again."""
    found = other_runs(spark, output, run)
    if not found:
        return None
    index = f"{folder}/{hashlib.md5(chr(10).join(found).encode()).hexdigest()}"
    if "_SUCCESS" not in _children(spark, index):
        keys = spark.read.option("basePath", output).parquet(*[f"{output}/{name}" for name in found]).select(key).distinct()
        bucketed = keys.withColumn("key_bucket", _bucket(key))
        bucketed.repartition("key_bucket").sortWithinPartitions("key_bucket", key).write.mode("overwrite").partitionBy(
            "key_bucket").parquet(index)
    return index


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def start_intake(stream: DataFrame, output: str, checkpoint: str, key: str = "example_key",
                 labelled: DataFrame | None = None):
    """Write every key once, across batches, restarts and new checkpoints.

    Keys are remembered as keyed state, so a batch looks up its own keys only, however many batches came before; nothing that
    this stream has written is read again.  A batch is stored as its own partition (run_id, batch_id).  The run is the
    stream's id, which lives in the checkpoint: a retried batch sees the state it saw before and replaces its partition, and
    a stream with a fresh checkpoint never touches older ones.  Keys that other runs had written before this start are looked
    up in an index beside the checkpoint.  Keys whose ``label`` is NULL are not labelled.
    """
    started, about = threading.Event(), {}

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        spark, fresh = batch.sparkSession, batch
        if labelled is not None:
            known = labelled.where("label IS NOT NULL") if "label" in labelled.columns else labelled
            fresh = fresh.join(known.select(key), key, "left_anti")
        if about["others"]:
            # At most KEY_BUCKETS numbers.
            touched = [row[0] for row in batch.select(_bucket(key).alias("b")).distinct().collect()]
            others = spark.read.schema(f"`{key}` {batch.schema[key].dataType.simpleString()}, key_bucket int").parquet(about["others"])
            fresh = fresh.join(others.where(F.col("key_bucket").isin(touched)).select(key), key, "left_anti")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{output}/run_id={about['run']}/batch_id={batch_id}")

    spark = stream.sparkSession
    with _state_store(spark):
        query = stream.dropDuplicates([key]).writeStream.foreachBatch(write).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    about["run"] = str(query.id)
    try:
        about["others"] = _keys_of_others(spark, output, f"{checkpoint.rstrip('/')}-others", about["run"], key)
    except BaseException:
        query.stop()
        raise
    finally:
        about.setdefault("others", None)
        started.set()
    return query


def running_counters(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Running ok, failed and token counts; state is one row per key."""
    return attempts.groupBy(*keys).agg(
        F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"),
        F.sum(F.when(F.col("ok"), F.col("tokens")).otherwise(0)).cast("bigint").alias("total_tokens"))


def start_counters(attempts: DataFrame, keys: list[str], output: str, checkpoint: str):
    """Keep the newest counters of every key in a table of changes.

    Update mode hands over changed rows only; the newest row per key is the largest batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return running_counters(attempts, keys).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_counters(spark: SparkSession, output: str, keys: list[str]) -> DataFrame:
    changes = spark.read.parquet(output)
    values = [c for c in changes.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("_v")
    return changes.groupBy(*keys).agg(newest).select(*keys, "_v.*")
