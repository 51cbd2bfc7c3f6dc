"""What the training-data operators share: the cluster's shared folder, staged tables and gapless ranks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.session import small_batches  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where neither that setting nor a checkpoint folder exists, a session on one machine (tests) gets a temporary one; on a cluster,
    whose machines would each have their own, that is an error. A path without a scheme is one of the cluster's default file system."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lintel-"))
        named = spark.sparkContext.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lintel-{uuid.uuid4().hex}-{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: Iterable[str], name: str) -> str:
    """`name`, led by as many underscores as make it unlike every column; Spark does not tell upper from lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame, *without: str) -> list[Column]:
    """All columns as they are, names with dots included, but those in `without`."""
    away = {c.lower() for c in without}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in away]


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def rank_within(df: DataFrame, keys: list[str], order: list[str], into: str = "rank", rows: int | None = None, per_bucket: int = 4096) -> DataFrame:
    """Gapless 0-based ranks within each key, in no particular order, without sending a key's rows to one task.

    Rows are dealt by a hash of `order` into buckets of about `per_bucket` rows (the root of all rows, if that is more, so that
    buckets and their number grow alike); a window numbers each (key, bucket), and offsets, one row per (key, bucket), come from a
    prefix sum over the pre-aggregated counts."""
    rows = df.count() if rows is None else rows
    buckets = max(1, -(-rows // max(per_bucket, isqrt(rows))))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    local = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    counts = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return local.join(offsets, [*keys, "_b"]).withColumn(into, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")
