"""Session defaults for local runs (on a cluster the submitted configuration wins), and tables in the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, app: str = "lintel", memory: str = "16g") -> SparkSession:
    """A local session with as many shuffle partitions as cores."""
    cpus = cpus or os.cpu_count() or 2
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in LOCAL.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python in Arrow batches of at most BATCH_BYTES (or one row), as its own bound of 64 MB, held twice in each
    of an executor's JVM and workers, is a good part of a small executor. A smaller bound that the session has is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).rstrip("bB")
    if not now.isdecimal() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: What this process has made in the shared folder and in the catalogue, until it is released.
_MADE: dict[str, list[str]] = {"folders": [], "tables": []}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one (spark.checkpoint.dir); a temporary one only in a session on one machine.

    It stays until `release` is called, as a result that was returned may not have been read yet."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lintel-")
    _MADE["folders"].append(f"{shared.rstrip('/')}/lintel-{name}-{uuid.uuid4().hex}")
    return _MADE["folders"][-1]


def deals(df: DataFrame, rows: int = 50_000) -> int:
    """As many partitions as the session shuffles into, or more, so that one has about `rows` rows of df at most."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back: a plan that uses it often computes it once, and a lost executor costs no more."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """A staged table in as many buckets of `key` as there are shuffle partitions: groupings and joins on the key need no shuffle.

    Rows that are dealt by the key into that many partitions already move no more."""
    spark = df.sparkSession
    table = f"lintel_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", scratch(spark, name)).saveAsTable(table)
    _MADE["tables"].append(table)
    return spark.table(table)


def release(spark: SparkSession) -> int:
    """Drops all tables and folders that this process has made for its queries; results that were not read before are lost. Gives how many."""
    tables, folders = _MADE["tables"], _MADE["folders"]
    _MADE["tables"], _MADE["folders"] = [], []
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(tables) + len(folders)
