"""Document fingerprints by winnowing, in DataFrame functions only.

Words are runs of bytes other than ASCII white space. A word's hash is 28 bits of its MD5; the hash of K words is a polynomial
modulo a prime, rolled up by doubling; of every WINDOW consecutive hashes the smallest is chosen, the rightmost of equal ones, and
its position is kept. So any passage of WINDOW + K - 1 words that two texts share gives them a fingerprint in common, and nothing
shorter than K words ever does. A hash and its position are packed into one number so that a minimum picks both.

Likeness is the Jaccard coefficient of the sets of hashes. The next document by ascending id is found without a global window:
ids are cut into ranges at their quantiles, windows run within ranges, and each range also sees the first row of the next one.

Defined results: a null text is empty; a text of fewer than K words is one gram, one without words has no fingerprint; two empty
fingerprints are alike (1), an empty one and another are not (0); equal ids are ordered by text, null ids come first; the only
document's next one is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, WINDOW = 4, 8
BASE, PRIME = 1_000_003, (1 << 31) - 1
LOW = 1 << 32


def _pairs(a: Column, n: Column, shift: int, f) -> Column:
    """f(a[i], a[i + shift]) for all i; n is the length of a."""
    m = F.greatest(n - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), m), F.slice(a, F.lit(1 + shift), m), f)


def with_fingerprint(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds array<bigint> `into`: the chosen hashes with their positions, in order."""
    base2 = BASE * BASE % PRIME
    roll = lambda b: lambda x, y: F.pmod(x * F.lit(b) + y, F.lit(PRIME))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    df = df.withColumn("_h", F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long")))
    n = F.size("_h")
    df = df.withColumn("_2", _pairs(F.col("_h"), n, 1, roll(BASE)))
    df = df.withColumn("_4", _pairs(F.col("_2"), F.size("_2"), 2, roll(base2)))
    short = F.array(F.aggregate("_h", F.lit(0).cast("long"), lambda a, x: F.pmod(a * F.lit(BASE) + x, F.lit(PRIME))))
    grams = F.when(n >= K, F.col("_4")).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_v", F.transform(grams, lambda g, i: g * F.lit(LOW) + (F.lit(LOW - 1) - i)))
    size = F.size("_v")
    for step in (1, 2, 4):  # minima of 2, 4 and 8 neighbours
        df = df.withColumn(f"_m{step}", _pairs(F.col("_v" if step == 1 else f"_m{step // 2}"), F.greatest(size - step + 1, F.lit(0)), step, lambda x, y: F.least(x, y)))
    chosen = F.when(size >= WINDOW, F.array_distinct("_m4")).when(size > 0, F.array(F.array_min("_v"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(into, chosen).drop("_h", "_2", "_4", "_v", "_m1", "_m2", "_m4")


def hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, 32)))


def written(fingerprint: str) -> Column:
    """"hash@position ...": positions count words from 0."""
    return F.array_join(F.transform(fingerprint, lambda v: F.concat(F.shiftright(v, 32).cast("string"), F.lit("@"), (F.lit(LOW - 1) - v.bitwiseAND(F.lit(LOW - 1))).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def with_ranges(docs: DataFrame, rows_per_range: int = 2000, most: int = 10_000) -> DataFrame:
    """docs with `_range` (ascending with doc_id) and `_next` (true: a copy of the first row of the range after)."""
    spark = docs.sparkSession
    total = docs.count()
    n = max(1, min(most, total // rows_per_range))
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)], 10 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    wide = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if groups:
        below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("doc_id")))
        heads = F.array(*[F.lit(g[0]) for g in groups])
        lists = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
        group = F.greatest(below(heads) - 1, F.lit(0))
        found = F.when(F.col("doc_id").isNull(), 0).otherwise(group * wide + below(F.element_at(lists, group + 1)))
    else:
        found = F.lit(0)
    ranged = docs.withColumn("_range", found.cast("int"))
    firsts = ranged.groupBy("_range").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null")).orderBy("_range").collect()  # n rows
    if not firsts:
        return ranged.withColumn("_next", F.lit(False))
    ahead = [(firsts[i - 1]["_range"], None if r["null"] else r["first"]) for i, r in enumerate(firsts)]
    table = spark.createDataFrame(ahead, f"_before int, _first {docs.schema['doc_id'].dataType.simpleString()}")
    copies = docs.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("_first"))).withColumn("_range", F.col("_before")).drop("_before", "_first")
    return ranged.withColumn("_next", F.lit(False)).unionByName(copies.withColumn("_next", F.lit(True)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("_range").orderBy("_next", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("_after", F.lead("text").over(order))
    rows = with_fingerprint(rows, "text", "_f")
    rows = rows.withColumn("_set", hashes("_f")).withColumn("_next_set", F.lead("_set").over(order)).where(~F.col("_next"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("_after"), F.lit(1), half))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("_edited"), "_f", "_set", "_next_set")
    rows = with_fingerprint(rows, "_edited", "_e").withColumn("_edited_set", hashes("_e"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), written("_f").alias("fingerprint"), written("_e").alias("edited_fingerprint"),
        likeness("_set", "_edited_set").alias("near_edited"), likeness("_set", "_next_set").alias("near_next"),
    )


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_fingerprint(source: str, text: str, prefix: str) -> str:
    """CTEs that give `source` a list {prefix}f of packed hashes."""
    base2 = BASE * BASE % PRIME
    return f"""
{prefix}h AS (SELECT *, list_transform(list_filter(string_split_regex({text}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''),
    lambda w: CAST('0x' || substr(md5(w), 1, 7) AS BIGINT)) AS {prefix}w FROM {source}),
{prefix}g AS (SELECT *, CASE WHEN len({prefix}w) >= {K} THEN
    list_transform(range(1, len({prefix}w) - 2), lambda i: ((({prefix}w[i] * {BASE} + {prefix}w[i + 1]) % {PRIME}) * {base2} + (({prefix}w[i + 2] * {BASE} + {prefix}w[i + 3]) % {PRIME})) % {PRIME})
    WHEN len({prefix}w) > 0 THEN [list_reduce(list_prepend(CAST(0 AS BIGINT), {prefix}w), lambda a, x: (a * {BASE} + x) % {PRIME})] ELSE CAST([] AS BIGINT[]) END AS {prefix}k FROM {prefix}h),
{prefix}v AS (SELECT *, list_transform({prefix}k, lambda g, i: g * {LOW} + ({LOW - 1} - (i - 1))) AS {prefix}n FROM {prefix}g),
{prefix}m AS (SELECT *, CASE WHEN len({prefix}n) >= {WINDOW} THEN list_transform(range(1, len({prefix}n) - {WINDOW - 2}), lambda i: list_min({prefix}n[i:i + {WINDOW - 1}]))
    WHEN len({prefix}n) > 0 THEN [list_min({prefix}n)] ELSE CAST([] AS BIGINT[]) END AS {prefix}a FROM {prefix}v),
{prefix}c AS (SELECT *, list_filter({prefix}a, lambda x, i: i = 1 OR {prefix}a[i - 1] <> x) AS {prefix}f FROM {prefix}m)"""


def _sql_written(f: str) -> str:
    return f"coalesce(array_to_string(list_transform({f}, lambda v: CAST(v // {LOW} AS VARCHAR) || '@' || CAST({LOW - 1} - v % {LOW} AS VARCHAR)), ' '), '')"


def _sql_likeness(a: str, b: str) -> str:
    s, t = f"list_distinct(list_transform({a}, lambda v: v // {LOW}))", f"list_distinct(list_transform({b}, lambda v: v // {LOW}))"
    both = f"len(list_intersect({s}, {t}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / (len({s}) + len({t}) - {both}) END"


OP7_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2) AS edited FROM o),
{_sql_fingerprint("e", "text", "a")},
{_sql_fingerprint("ac", "edited", "b")},
n AS (SELECT *, coalesce(lead(af) OVER w, first_value(af) OVER w) AS nf FROM bc WINDOW w AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {_sql_written("af")} AS fingerprint, {_sql_written("bf")} AS edited_fingerprint,
{_sql_likeness("af", "bf")} AS near_edited, {_sql_likeness("af", "nf")} AS near_next FROM n"""
