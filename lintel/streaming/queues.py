"""Durable queues as streams: ordered micro-batches, idempotent keys and per-entity state machines.

A stream's checkpoint replaces the recovery of a worker: after a restart a batch that was not committed runs again, and every sink here
is keyed by batch or entity, so that a repeat changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.relational import latest, upsert

# Allowed transitions of rematch runs, uploads, reviews and detailed jobs.
TRANSITIONS = {
    "rematch": [("pending", "running"), ("running", "completed"), ("running", "failed"), ("pending", "superseded"), ("running", "superseded"), ("failed", "pending"), ("superseded", "pending"), ("completed", "pending")],
    "upload": [("queued", "running"), ("running", "completed"), ("running", "failed"), ("failed", "queued")],
    "review": [("reviewing", "submitted"), ("changes_requested", "submitted"), ("submitted", "approved"), ("submitted", "changes_requested"), ("approved", "changes_requested")],
    "detailed": [("queued", "running"), ("running", "completed"), ("running", "failed"), ("running", "paused"), ("queued", "paused"), ("failed", "queued"), ("paused", "queued"), ("running", "queued")],
}


def illegal(events: DataFrame, machine: str) -> DataFrame:
    """Events whose step from the entity's status before is not allowed. events: entity, seq, status."""
    from pyspark.sql import Window

    allowed = events.sparkSession.createDataFrame(TRANSITIONS[machine], "was string, status string")
    steps = events.withColumn("was", F.lag("status").over(Window.partitionBy("entity").orderBy("seq"))).where("was IS NOT NULL")
    return steps.join(F.broadcast(allowed), ["was", "status"], "left_anti")


def recovered(events: DataFrame) -> DataFrame:
    """The state after a restart: what was running is queued again."""
    state = latest(events, ["entity"], [F.desc("seq")])
    return state.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def run_queue(stream: DataFrame, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], order: list[str], mode: str = "append"):
    """Works off what has arrived, in order within a batch; a batch that runs twice overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        work(df.orderBy(*order)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: str, buckets: int = 64):
    """Keeps one row of each key, the last by order, in buckets of keys. A batch writes anew only the buckets that it touches, as that
    batch's version of them; then versions that no later batch reads are deleted. A repeated batch gives the same versions."""

    def batch(df: DataFrame, number: int) -> None:
        spark, schema = df.sparkSession, df.schema
        dealt = latest(df, keys, [F.desc(order)]).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r["bucket"] for r in dealt.select("bucket").distinct().collect())  # at most `buckets`
        held = {b: v for b, v in _versions(spark, target, number - 1).items() if b in touched}
        paths = [f"{target}/version={v}/bucket={b}" for b, v in held.items()]
        old = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        fresh = upsert(old, dealt.drop("bucket"), keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number}")
        _delete(spark, [f"{target}/version={v}/bucket={b}" for b, v in _versions(spark, target, number - 2).items() if b in held and held[b] != v])

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, target: str, upto: int | None = None) -> dict[int, int]:
    """Of each bucket the newest version, of batches up to one."""
    store, path = _files(spark, target)
    found: dict[int, int] = {}
    if store.exists(path):
        for v in store.listStatus(path):
            number = int(v.getPath().getName().partition("=")[2])
            if upto is None or number <= upto:
                for b in store.listStatus(v.getPath()):
                    name, _, bucket = b.getPath().getName().partition("=")
                    if name == "bucket":
                        found[int(bucket)] = max(number, found.get(int(bucket), -1))
    return found


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        store, p = _files(spark, path)
        store.delete(p, True)


def kept(spark: SparkSession, target: str) -> DataFrame:
    """The table that keep_latest keeps."""
    return spark.read.parquet(*[f"{target}/version={v}/bucket={b}" for b, v in _versions(spark, target).items()])


def first_per_key(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Idempotent enqueueing: later rows of a key are dropped while the watermark remembers it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def status_counts(stream: DataFrame, time: str, every: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts of statuses in windows of event time."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, every), "status").agg(F.count(F.lit(1)).alias("n"))


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The events files of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
