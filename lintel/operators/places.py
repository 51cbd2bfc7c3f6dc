"""Where clauses stand in a source whose order is nearly, but not quite, theirs.

Source and clauses are compared by their letters and digits alone. The source's GRAM-letter pieces at every place are the index; a clause is
cut into such pieces side by side, and stands where all of them do, so no task needs the source whole. A clause that stands at one place only
is an anchor, wherever it is. Most anchors follow each other as their clauses do: the longest such chain is found in blocks of BLOCK anchors,
and then over the blocks, so a document of any length takes many tasks. What lies beside the chain has been moved (a table that floats).
Clauses that stand at several places are looked for between the chain's anchors around them, and taken in order if there are as many places
as clauses of that text; anything else is ambiguous and refused, as a wrong mark is worse than none."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.session import staged

GRAM, BLOCK = 8, 512


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def _grams(text: str) -> Column:
    """All overlapping pieces of GRAM characters, by one look-ahead over the text."""
    return F.regexp_extract_all(F.col(text), F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def candidates(sources: DataFrame, clauses: DataFrame) -> DataFrame:
    """doc, ord, start of every place at which a clause stands. sources: doc, text; clauses: doc, ord, text; texts are letters only."""
    held = sources.select("doc", F.posexplode(_grams("text")).alias("pos", "gram")).select("doc", "pos", F.xxhash64("gram").alias("gram"))
    size = F.char_length("text")
    cut = clauses.where(size >= GRAM).select("doc", "ord", size.alias("size"), F.posexplode(_grams("text")).alias("at", "gram"))
    tiles = cut.where((F.col("at") % GRAM == 0) | (F.col("at") == F.col("size") - GRAM)).select("doc", "ord", "size", "at", F.xxhash64("gram").alias("gram"))
    met = tiles.join(held, ["doc", "gram"]).select("doc", "ord", "size", (F.col("pos") - F.col("at")).alias("start"))
    wanted = F.ceil(F.col("size") / GRAM)  # pieces side by side, and one that ends with the text if they don't
    return met.groupBy("doc", "ord", "size", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == wanted).select("doc", "ord", "size", "start")


def _longest(starts: np.ndarray) -> np.ndarray:
    """Which places belong to a longest strictly ascending run of them."""
    tails: list = []
    at: list[int] = []
    before = np.full(len(starts), -1)
    for i, s in enumerate(starts):
        k = bisect_left(tails, s)
        if k == len(tails):
            tails.append(s)
            at.append(i)
        else:
            tails[k], at[k] = s, i
        before[i] = at[k - 1] if k else -1
    keep = np.zeros(len(starts), bool)
    i = at[-1] if at else -1
    while i >= 0:
        keep[i], i = True, before[i]
    return keep


def chain(anchors: DataFrame) -> DataFrame:
    """The anchors (doc, ord, start) of a longest chain in blocks, and of blocks in a document."""
    order = Window.partitionBy("doc", "range").orderBy("ord")
    # ranges of clause numbers; a block is a run of anchors in one of them
    cut = anchors.withColumn("range", F.floor(F.col("ord") / (8 * BLOCK))).withColumn("block", F.col("range") * 8 + F.floor((F.row_number().over(order) - 1) / BLOCK))

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        return rows[_longest(rows["start"].to_numpy())][["doc", "block", "ord", "start"]]

    kind = anchors.schema["doc"].dataType.simpleString()
    kept = cut.select("doc", "block", "ord", "start").groupBy("doc", "block").applyInPandas(within, f"doc {kind}, block long, ord long, start long")
    ends = kept.groupBy("doc", "block").agg(F.min("start").alias("a"), F.max("start").alias("b"), F.count(F.lit(1)).alias("n"))

    def over(rows: pd.DataFrame) -> pd.DataFrame:
        """The heaviest run of blocks that follow each other; a document has few blocks."""
        rows = rows.sort_values("block")
        a, b, n = (rows[c].to_numpy() for c in ("a", "b", "n"))
        best, before = n.copy(), np.full(len(rows), -1)
        for i in range(1, len(rows)):
            fit = np.flatnonzero(b[:i] < a[i])
            if len(fit) and best[fit].max() + n[i] > best[i]:
                before[i] = fit[best[fit].argmax()]
                best[i] = best[before[i]] + n[i]
        i, keep = int(best.argmax()), []
        while i >= 0:
            keep.append(i)
            i = before[i]
        return rows.iloc[keep][["doc", "block"]]

    chosen = ends.groupBy("doc").applyInPandas(over, f"doc {kind}, block long")
    return kept.join(chosen, ["doc", "block"], "left_semi").select("doc", "ord", "start")


def find_places(sources: DataFrame, clauses: DataFrame) -> DataFrame:
    """doc, ord, start (null if refused), status: exact, moved, repeated, ambiguous or absent. sources: doc, text; clauses: doc, ord (long), text.

    Clauses of fewer than GRAM letters are absent; a null document matches nothing."""
    said = staged(clauses.select("doc", F.col("ord").cast("long").alias("ord"), letters(F.col("text")).alias("text")), "clauses")
    found = staged(candidates(sources.select("doc", letters(F.col("text")).alias("text")), said).withColumn("start", F.col("start").cast("long")), "candidates")
    counts = found.groupBy("doc", "ord").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"))
    anchors = staged(counts.where("n = 1").select("doc", "ord", "start"), "anchors")
    line = staged(chain(anchors), "chain")
    single = anchors.join(line.select("doc", "ord", F.lit("exact").alias("status")), ["doc", "ord"], "left").na.fill("moved", ["status"])

    # repeated ones: between the anchors of the chain before and behind them
    asks = counts.where("n > 1").select("doc", "ord", F.lit(None).cast("long").alias("start"))
    marks = asks.unionByName(line)
    before = F.last("start", ignorenulls=True).over(Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    behind = F.last("start", ignorenulls=True).over(Window.partitionBy("doc").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1))
    gaps = marks.withColumn("low", F.coalesce(before, F.lit(-1))).withColumn("high", F.coalesce(behind, F.lit(1 << 62))).where("start IS NULL").select("doc", "ord", "low", "high")
    within = gaps.join(said.select("doc", "ord", F.xxhash64("text").alias("same")), ["doc", "ord"]).join(found, ["doc", "ord"]).where("start > low AND start < high AND start + size <= high")
    group = ["doc", "low", "same"]
    asked = within.select(*group, "ord").distinct().withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("ord")))
    there = within.select(*group, "start").distinct().withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("start")))
    even = asked.groupBy(*group).agg(F.count(F.lit(1)).alias("a")).join(there.groupBy(*group).agg(F.count(F.lit(1)).alias("b")), group).where("a = b").select(*group)
    placed = asked.join(there, [*group, "r"]).join(even, group).select("doc", "ord", "start", F.lit("repeated").alias("status"))
    known = single.select("doc", "ord", "start", "status").unionByName(placed)
    rest = said.select("doc", "ord").join(known, ["doc", "ord"], "left_anti").join(counts.select("doc", "ord", "n"), ["doc", "ord"], "left")
    refused = rest.select("doc", "ord", F.lit(None).cast("long").alias("start"), F.when(F.col("n").isNull(), "absent").otherwise("ambiguous").alias("status"))
    return known.unionByName(refused)
