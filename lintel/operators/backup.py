"""Copies of tables that are verified and restored by a tree of digests over key ranges, and how many of them are kept.

A copy is a folder: rows by part (a run of key ranges, a folder each) and the tree. Its leaves are key ranges of SPAN keys with the digest of
their rows, in any order; an inner node has the digest of its FANOUT children. Two trees are compared from the root, level by level, and
only nodes below a difference are looked at; then only the ranges that differ are read, from the parts that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.session import staged

SPAN, FANOUT, LEAVES_A_PART = 256, 16, 64
#: Ranges are looked up by a broadcast if there are no more of them.
FEW = 2_000_000


def _row_digest(rows: DataFrame):
    """A digest of all columns, null told apart from every value."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(rows.columns)]
    return F.sha2(F.to_json(F.array(*cells)), 256)


def _combined(digest: str):
    """An order-free digest of digests: their number and, of four quarters, the sums of numbers in them, hashed."""
    quarters = [F.sum(F.conv(F.substring(F.col(digest), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *quarters), 256)


def digest_tree(rows: DataFrame, key: str) -> DataFrame:
    """level, node, digest, rows: leaves (level 0) and what is above them, up to one root (the level with node 0 alone)."""
    hashed = rows.select(F.floor(F.col(key) / SPAN).alias("node"), _row_digest(rows).alias("row"))
    leaves = staged(hashed.groupBy("node").agg(_combined("row").alias("digest"), F.count(F.lit(1)).alias("rows")), "leaves")
    levels, level = [leaves.select(F.lit(0).alias("level"), "node", "digest", "rows")], 0
    ends = leaves.agg(F.min("node").alias("a"), F.max("node").alias("b")).first()
    a, b = (ends["a"] or 0), (ends["b"] or 0)
    # keys on both sides of 0 end in two roots, -1 and 0
    while (a != b and (a, b) != (-1, 0)) or level == 0:
        a, b, level = a // FANOUT, b // FANOUT, level + 1
        named = levels[-1].select(F.floor(F.col("node") / FANOUT).alias("node"), F.sha2(F.concat_ws(":", F.col("node").cast("string"), "digest"), 256).alias("child"), "rows")
        levels.append(named.groupBy("node").agg(_combined("child").alias("digest"), F.sum("rows").alias("rows")).select(F.lit(level).alias("level"), "node", "digest", "rows"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def write_copy(rows: DataFrame, key: str, path: str) -> None:
    """Rows by part and their tree; the tree is written last, so a folder without one is no copy."""
    parted = rows.withColumn("_part", F.floor(F.col(key) / (SPAN * LEAVES_A_PART)))
    parted.repartition("_part").write.partitionBy("_part").parquet(f"{path}/rows")
    digest_tree(read_copy(rows.sparkSession, path).drop("_part"), key).write.partitionBy("level").parquet(f"{path}/tree")


def read_copy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node long, digest string, rows long, level int").parquet(f"{path}/tree")


def changed_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """node of the leaves in which two trees differ, found from the top down; of a level only nodes below a difference are joined."""
    tops = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    level = min(tops)
    different = None
    while level >= 0:
        sides = [t.where(F.col("level") == level).select("node", "digest") for t in (a, b)]
        if different is not None:
            # the children of a differing node, by number
            below = different.select(F.explode(F.sequence(F.col("node") * FANOUT, F.col("node") * FANOUT + FANOUT - 1)).alias("node"))
            sides = [s.join(F.broadcast(below) if below.count() <= FEW else below, "node", "left_semi") for s in sides]
        both = sides[0].join(sides[1].withColumnRenamed("digest", "other"), "node", "full").where("NOT digest <=> other")
        different = staged(both.select("node"), "ranges")
        level -= 1
    return different


def differences(spark: SparkSession, mine: str, other: str, key: str) -> DataFrame:
    """key, change (added, removed, changed) that make the copy `mine` the copy `other`; keys are unique. Only differing ranges are read."""
    ranges = changed_ranges(read_tree(spark, mine), read_tree(spark, other))
    wanted = ranges.select("node", F.floor(F.col("node") / LEAVES_A_PART).alias("_part"))
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted

    def side(path: str, digest: str) -> DataFrame:
        rows = read_copy(spark, path)
        found = rows.withColumn("node", F.floor(F.col(key) / SPAN)).join(wanted, ["_part", "node"], "left_semi")
        return found.select(key, _row_digest(rows.drop("_part")).alias(digest))

    both = side(mine, "old").join(side(other, "new"), key, "full").where("NOT old <=> new")
    return both.select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def restored(spark: SparkSession, damaged: str, good: str, key: str) -> DataFrame:
    """The rows of a damaged copy made good: what differs is taken from the good one, all else stays as it lies."""
    found = staged(differences(spark, damaged, good, key), "differences")
    away = found.select(key)
    kept = read_copy(spark, damaged).drop("_part").join(away, key, "left_anti")
    taken = read_copy(spark, good).drop("_part").join(found.where("change <> 'removed'").select(key), key, "left_semi")
    return kept.unionByName(taken)


def pruned(copies: DataFrame, keys: list[str], newest: int, days: int, now) -> DataFrame:
    """Copies (keys, made, id) that may go: all but the `newest` of each key, if they are older than so many days. Equal times go by id."""
    kept = latest_of(copies, keys, newest)
    return copies.join(kept.select(*keys, "made", "id"), [*keys, "made", "id"], "left_anti").where(F.col("made") < now - F.expr(f"INTERVAL {days} DAYS"))


def latest_of(copies: DataFrame, keys: list[str], newest: int) -> DataFrame:
    """The newest copies of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("made"), F.desc("id"))
    return copies.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= newest).drop("_n")
