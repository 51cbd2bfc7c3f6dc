"""What a row takes from rows before it, without one task seeing a whole document.

Places in a document are cut into blocks of SPAN. Windows run inside blocks; of each block one small row says what it leaves (the last value,
or values that appear in it for the first time); what lies before a block is a prefix over these rows, and a join brings it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 65_536


def filled_down(rows: DataFrame, keys: list[str], place: str, value: str, into: str, span: int = SPAN) -> DataFrame:
    """Adds `into`: the value of the row itself or of the last one before it in its keys that has one. Places are unique within keys."""
    cut = rows.withColumn("_block", F.floor(F.col(place) / span))
    last = F.last(value, ignorenulls=True)
    inside = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    left = cut.where(F.col(value).isNotNull()).groupBy(*keys, "_block").agg(F.max_by(value, place).alias("_left"))
    # a block without a value takes part too, as it asks for what lies before it
    every = cut.select(*keys, "_block").distinct().join(left, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "_block", F.last("_left", ignorenulls=True).over(before).alias("_carry"))
    return cut.withColumn("_here", last.over(inside)).join(carried, [*keys, "_block"]).withColumn(into, F.coalesce("_here", "_carry")).drop("_block", "_here", "_carry")


def values_before(rows: DataFrame, keys: list[str], place: str, value: str, into: str, span: int = SPAN) -> DataFrame:
    """Adds `into`: the distinct values, in order, of all rows before a row in its keys (an empty array if there are none).

    Only a value's first place counts, so each lies in one block; a block's sets are as small as its news."""
    cut = rows.withColumn("_block", F.floor(F.col(place) / span))
    first = cut.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(place).alias(place)).withColumn("_block", F.floor(F.col(place) / span))
    news = first.groupBy(*keys, "_block").agg(F.collect_set(value).alias("_news"))
    every = cut.select(*keys, "_block").distinct().join(news, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "_block", F.flatten(F.collect_list("_news").over(before)).alias("_carry"))
    marked = cut.join(first.drop("_block").withColumn("_first", F.col(value)), [*keys, value, place], "left")
    inside = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    here = F.collect_list("_first").over(inside)
    return marked.withColumn("_here", here).join(carried, [*keys, "_block"]).withColumn(into, F.array_sort(F.concat("_carry", "_here"))).drop("_block", "_first", "_here", "_carry")


def inherited_references(rows: DataFrame) -> DataFrame:
    """rows with notation: what a table row's material has to meet.

    rows: document, place, table, cells (number of columns, null for other rows), heading (a heading's kind, null for other rows), material,
    codes (of five-column rows). A row of five columns has its own codes. One of four, under a heading of four that asks for samples, takes
    those that earlier rows of five columns of its document gave for the same material; nothing is taken across documents."""
    headed = filled_down(rows, ["document", "table"], "place", "heading", "_under")
    given = headed.withColumn("_own", F.when(F.col("cells") == 5, F.col("codes")))
    held = values_before(given, ["document", "material"], "place", "_own", "_given")
    asks = (F.col("cells") == 4) & (F.col("_under") == "samples") & (F.size("_given") > 0)
    return held.withColumn("notation", F.when(F.col("_own").isNotNull(), F.col("_own")).when(asks, F.array_join("_given", "; "))).drop("_under", "_own", "_given")
