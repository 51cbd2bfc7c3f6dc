"""Joins of codes with prefixes: a prefix is an interval of sorted codes, and intervals meet codes in buckets of equal size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of codes; that many cut points reach the driver.
BUCKETS = 256
BYTES = 7
#: The root of BUCKETS.
STEP = 16


def _number(code: Column, filling: str) -> Column:
    """The first BYTES bytes of a code as a number, which orders codes as their bytes do; shorter ones are filled with a byte."""
    whole = F.rpad(F.substring(F.hex(F.encode(code, "UTF-8")), 1, 2 * BYTES), 2 * BYTES, filling)
    return F.conv(whole, 16, 10).cast("long")


def _counted(cuts: list[int], holds: Callable[[Column], Column]) -> Column:
    """How many of sorted cuts a comparison holds for, if it holds for the first ones: every STEPth is asked first, then those between two."""
    if not cuts:
        return F.lit(0)
    held = lambda some: F.array(*[F.lit(c).cast("long") for c in some])
    whole = STEP * F.size(F.filter(held(cuts[STEP - 1 :: STEP]), holds)) if len(cuts) >= STEP else F.lit(0)
    return whole + F.size(F.filter(F.slice(held(cuts), whole + 1, F.lit(STEP)), holds))


def longest_prefixes(rows: DataFrame, code: str, asked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows that a query's prefixes allow, each with query and the longest such prefix. asked: query, prefix (distinct).

    Rows are dealt into buckets between quantiles of their codes; a code that fills several buckets is spread over them. A prefix goes to the
    buckets that its interval meets, so a short one is copied to many buckets and a code meets only the prefixes near it."""
    numbered = rows.withColumn("_code", _number(F.col(code), "00"))
    cuts = numbered.agg(F.percentile_approx("_code", [(i + 1) / buckets for i in range(buckets - 1)], 10_000)).first()[0] or []
    below = lambda x: _counted(cuts, lambda c: c < x)
    upto = lambda x: _counted(cuts, lambda c: c <= x)
    spread = F.pmod(F.hash(*[F.col(f"`{c}`") for c in rows.columns]), upto(F.col("_code")) - below(F.col("_code")) + 1)
    dealt = numbered.withColumn("_bucket", below(F.col("_code")) + spread)
    intervals = asked.select("query", "prefix", F.explode(F.sequence(below(_number(F.col("prefix"), "00")), upto(_number(F.col("prefix"), "FF")))).alias("_bucket"))
    # the longest prefix first: of a query's prefixes in a bucket, kept together, the first that fits
    ordered = intervals.groupBy("query", "_bucket").agg(F.reverse(F.array_sort(F.collect_set(F.struct(F.char_length("prefix").alias("size"), "prefix")))).alias("_prefixes"))
    fit = F.get(F.filter("_prefixes", lambda p: F.startswith(F.col(code), p["prefix"])), 0)
    return dealt.join(ordered, "_bucket").withColumn("prefix", fit["prefix"]).where("prefix IS NOT NULL").drop("_code", "_bucket", "_prefixes")
