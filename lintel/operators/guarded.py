"""Writes that count only if they name the state that they found.

Whether a write counts depends on all before it, yet no task has to go through an entity's history: a write that counts leaves a state
that is known beforehand, so the only one that can count next is the first later write that expects that state. These successors make a
forest, and what counts is the path from the entity's first state, found by doubling: in each pass all rows on the path name the row that
lies 2^i steps ahead. So a hot entity is spread over its states, and a history of n accepted writes takes log2(n) passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.session import staged


def accepted_writes(writes: DataFrame, initial: str) -> DataFrame:
    """writes (entity, seq, expected, state) with accepted; seq orders an entity's writes, `state` is what a write leaves, null never matches."""
    writes = staged(writes.select("entity", F.col("seq").cast("long").alias("seq"), "expected", "state"), "writes")
    start = writes.select("entity").distinct().select("entity", F.lit(None).cast("long").alias("seq"), F.lit(initial).alias("state"))
    # what is left at a place, and what is expected at a place; the next write that expects a state comes strictly later
    left = writes.select("entity", "seq", "state").unionByName(start).select("entity", F.col("state").alias("value"), "seq", F.lit(None).cast("long").alias("asks"))
    asked = writes.select("entity", F.col("expected").alias("value"), "seq", F.col("seq").alias("asks"))
    # the nearest place behind is the last one of a reversed order; at one place what is left stands before what is asked, as no write follows itself
    behind = Window.partitionBy("entity", "value").orderBy(F.col("seq").desc_nulls_last(), F.col("asks").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    rows = left.unionByName(asked).where("value IS NOT NULL").withColumn("next", F.last("asks", ignorenulls=True).over(behind))
    jumps = staged(rows.where("asks IS NULL").select("entity", "seq", "next"), "jumps")
    reached = staged(jumps.where("seq IS NULL AND next IS NOT NULL").select("entity", F.col("next").alias("seq")), "reached")
    jumps = jumps.where("seq IS NOT NULL AND next IS NOT NULL")
    while True:
        more = reached.join(jumps, ["entity", "seq"]).select("entity", F.col("next").alias("seq"))
        grown = staged(reached.unionByName(more).distinct(), "reached")
        if grown.count() == reached.count():
            break
        reached = grown
        further = jumps.select("entity", F.col("seq").alias("next"), F.col("next").alias("beyond"))
        jumps = staged(jumps.join(further, ["entity", "next"]).select("entity", "seq", F.col("beyond").alias("next")), "jumps")
    return writes.join(reached.withColumn("accepted", F.lit(True)), ["entity", "seq"], "left").na.fill(False, ["accepted"])
