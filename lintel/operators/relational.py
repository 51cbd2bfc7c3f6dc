"""Query patterns of paging, context, sampling and change detection."""

from __future__ import annotations

import base64
import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.session import staged

#: So many keys, with 64 numbers each, may be sent to all tasks.
FEW_KEYS = 10_000


def spread_sample(df: DataFrame, keys: list[str], order: list[str], count: int, buckets: int = 64) -> DataFrame:
    """Evenly spaced rows of each key: `count` of them (the middle one if it is 1), all if there are fewer. Half-way indices go to even.

    Rows are dealt by approximate quantiles of the first order column, a number or date; counts of buckets say which buckets hold a
    wanted place, and only those are put in order, so no task sees all rows of a key. With no keys the table is one group. Approximate
    quantiles depend on the order in which parts are merged, so the cuts are staged: rows are counted and placed by the same ones."""
    first = F.col(order[0]).cast("double")
    by = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = staged(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(first, steps, F.lit(1000)).alias("_cuts")), "cuts")
    few = cuts.count() <= FEW_KEYS  # then their cuts go to the rows, and no row moves for them
    sent = F.broadcast if few else lambda df: df
    dealt = rows.join(sent(cuts), by).withColumn("_b", F.coalesce(F.size(F.filter("_cuts", lambda c: c < first)), F.lit(-1))).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "_b", "_n").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    if count == 1:
        spots = F.array(F.floor(F.col("_n") / 2))
    else:
        spots = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(count - 1), 0).cast("long"))
        spots = F.when(F.col("_n") <= count, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(spots)
    wanted = counts.withColumn("_spots", F.filter(F.array_distinct(spots), lambda s: (s >= F.col("_before")) & (s < F.col("_before") + F.col("_c")))).where(F.size("_spots") > 0)
    near = dealt.drop("_n").join(sent(wanted.select(*by, "_b", "_before", "_spots")), [*by, "_b"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)) - 1
    return near.withColumn("_i", place).where(F.array_contains("_spots", F.col("_i"))).select(*df.columns)


def stratified_sample(df: DataFrame, cohort: str, wanted: dict[str, int], order: list[str], total: int) -> DataFrame:
    """Evenly spaced rows of each cohort, as many as are wanted of it, and, if that makes fewer than `total`, evenly spaced ones of the rest."""
    parts = [spread_sample(df.where(F.col(cohort) == name), [cohort], order, n) for name, n in wanted.items()]
    chosen = staged(reduce(DataFrame.unionByName, parts), "chosen")
    missing = total - chosen.count()  # at most `total`
    if missing <= 0:
        return chosen
    return chosen.unionByName(spread_sample(df.join(F.broadcast(chosen.select(*order)), order, "left_anti"), [], order, missing))


def placed(df: DataFrame, keys: list[str], number: Column, then: list, into: str, within: bool = False, buckets: int = 64) -> DataFrame:
    """Numbers rows from 1 in the order of keys, a number and `then`; `within` begins anew for each combination of keys.

    Rows are dealt into buckets between approximate quantiles of the number (of each combination), which are put in order one by one; places
    of whole buckets come from a prefix sum over their counts, so no task sees all rows of a combination unless they share one number.
    The cuts are staged, as approximate quantiles made twice may differ."""
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    rows = df.withColumn("_v", number.cast("double"))
    cuts = staged(rows.groupBy(*keys).agg(F.percentile_approx("_v", steps, F.lit(1000)).alias("_cuts")), "cuts")
    sent = F.broadcast if cuts.count() <= FEW_KEYS else lambda df: df
    dealt = rows.join(sent(cuts), keys).withColumn("_b", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(-1))).drop("_cuts")
    before = (Window.partitionBy(*keys).orderBy("_b") if within else Window.orderBy(*keys, "_b")).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c")).select(*keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    own = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_v", *then)))
    return own.join(sent(counts), [*keys, "_b"]).withColumn(into, (F.col("_o") + F.col("_r")).cast("int")).drop("_v", "_b", "_o", "_r")


def optional_filters(df: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """Rows whose columns hold what is asked for, literally and in any case; what is empty or missing filters nothing."""
    for column, asked in filters.items():
        if asked:
            df = df.where(F.contains(F.lower(F.col(column)), F.lit(asked.lower())))
    return df


def holds_any(c: Column, words: list[str]) -> Column:
    """Whether a text holds one of some words, in any case."""
    flat = F.lower(c)
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(flat, w))


def named(rules: dict[str, Column], between: str) -> Column:
    """The names of the rules that hold, in their order."""
    return F.concat_ws(between, *[F.when(rule, F.lit(name)) for name, rule in rules.items()])


def tagged(parts: dict[str, DataFrame], column: str) -> DataFrame:
    """Tables of the same columns as one, with the name of each in a column."""
    rows = [df.select(F.lit(name).alias(column), *df.columns) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def partners(df: DataFrame, group: str, member: str) -> DataFrame:
    """group, member, partners: how many other members share the group."""
    rows = df.select(group, member).distinct()
    return rows.join(rows.groupBy(group).agg((F.count(F.lit(1)) - 1).alias("partners")), group)


def sharing_pairs(df: DataFrame, member: str, keys: list[str]) -> DataFrame:
    """Pairs a < b of members that share all keys, once each."""
    rows = df.select(member, *keys).distinct()
    a, b = rows.select(F.col(member).alias("a"), *keys), rows.select(F.col(member).alias("b"), *keys)
    return a.join(b, keys).where("a < b").select("a", "b").distinct()


def ordered_concat(order: list[str], value: str, between: str) -> Column:
    """Values of a group in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[value].cast("string")), between)


def rolled_digest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One SHA-256 of all rows, whatever their order: of the digests of buckets, each over its rows in order. Keys are dealt to 65,536 buckets."""
    bucket = F.substring(F.md5(F.col(key).cast("binary")), 1, 4)
    parts = df.groupBy(bucket.alias("_b")).agg(F.sha2(ordered_concat(order, order[-1], "\n"), 256).alias("_d"))
    return parts.agg(F.sha2(ordered_concat(["_b", "_d"], "_d", ""), 256).alias("digest"))


def keyset_page(df: DataFrame, first: str, second: str, limit: int, after: tuple | None = None) -> DataFrame:
    """The rows after a position, newest first, one more than asked so that a caller sees whether there are more."""
    if after is not None:
        df = df.where((F.col(first) < F.lit(after[0])) | ((F.col(first) == F.lit(after[0])) & (F.col(second) < F.lit(after[1]))))
    return df.orderBy(F.desc(first), F.desc(second)).limit(limit + 1)


def encode_cursor(position: tuple, filters: dict) -> str:
    """A position bound to the filters it belongs to."""
    signature = hashlib.sha256(json.dumps(filters, sort_keys=True).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps([*position, signature]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, filters: dict) -> tuple:
    try:
        *position, signature = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if signature != hashlib.sha256(json.dumps(filters, sort_keys=True).encode()).hexdigest()[:16]:
        raise ValueError("the cursor belongs to other filters")
    return tuple(position)


def page_with_total(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page whose rows carry the total; a page beyond the end is one row with the total and nulls."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return F.broadcast(total).join(df.orderBy(*order).offset(offset).limit(limit), F.lit(True), "left")


def neighbours(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Adds prev_ and next_ columns, over the whole group before any page is cut."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns], *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])


def last_where(value: Column, where: Column, w) -> Column:
    """The last value before a row for which a condition held."""
    return F.last(F.when(where, value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def multiset_diff(before: DataFrame, after: DataFrame, keys: list[str], fingerprint: str, order: str) -> DataFrame:
    """keys, fingerprint, n, before_order, after_order, change: equal fingerprints are matched occurrence by occurrence."""

    def numbered(df: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(*keys, fingerprint).orderBy(order)
        return df.select(*keys, fingerprint, F.row_number().over(w).alias("n"), F.col(order).alias(f"{side}_order"))

    both = numbered(before, "before").join(numbered(after, "after"), [*keys, fingerprint, "n"], "full")
    change = F.when(F.col("before_order").isNull(), "added").when(F.col("after_order").isNull(), "removed").when(F.col("before_order") != F.col("after_order"), "moved").otherwise("kept")
    return both.withColumn("change", change)


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, change: added, removed, changed or unchanged; nulls are values."""
    o = old.select(*keys, F.struct(*values).alias("o"), F.lit(True).alias("in_o"))
    n = new.select(*keys, F.struct(*values).alias("n"), F.lit(True).alias("in_n"))
    change = F.when(F.col("in_o").isNull(), "added").when(F.col("in_n").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return o.join(n, keys, "full").select(*keys, change.alias("change"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str, overwrite: bool = True) -> DataFrame:
    """The table after rows were inserted: the last of equal keys wins (or the row already there)."""
    both = table.withColumn("_new", F.lit(0)).withColumn("_o", F.lit(None).cast("long")).unionByName(rows.withColumn("_new", F.lit(1)).withColumn("_o", F.col(order).cast("long")))
    prefer = [F.desc("_new"), F.desc("_o")] if overwrite else ["_new", "_o"]
    return latest(both, keys, prefer).drop("_new", "_o")


def islands(df: DataFrame, keys: list[str], order: str, starts: Column, into: str = "island") -> DataFrame:
    """Numbers runs of rows: a row for which `starts` holds begins a new one."""
    return df.withColumn(into, F.sum(starts.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent, child[child_key] == parent[parent_key], "left_anti").where(F.col(child_key).isNotNull())
