"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every window of WINDOW words the smallest hash of its K-grams is kept (the rightmost of equal ones), for documents and benchmark items
alike. A window that both share has the same smallest K-gram at the same place, so a join of these fingerprints misses no shared window.
Each hit is then extended over the words around it: every window of the document that holds the K-gram is compared, as a whole, with the
windows of the items. Longer shared spans are the union of their windows. Items of fewer than WINDOW words have no such window; they are
met by their only gram, for those lengths that the benchmark has.

Windows are compared by 64-bit hashes, and only where the hash of their K-gram agrees too. Windows that lie in the same items form one
class, and documents that hold the same classes one signature; ids are listed once for a signature. So a passage of a third of all
documents and of many items costs no row for each pair of them, and copies of a document cost one row each. Nothing but the lengths of
short items (at most WINDOW - 1 numbers) reaches the driver. Fingerprints and windows of the benchmark are broadcast if they are no more
than BROADCAST_ROWS; beyond that they are joined by shuffles.

Defined results: a null text has no words; an item without words has no windows; items are told apart by id, and those with a null id mark
words but are not listed; repeated rows of documents give a row each; an empty benchmark marks nothing; an empty table gives no rows; other
columns are ignored. A very long text is one row of arrays of its words' hashes, 8 bytes a word each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.common import staged

WINDOW, K = 10, 5
#: Grams in a window, the span over which a minimum is taken.
GRAMS = WINDOW - K + 1
LOW = 1 << 32
BROADCAST_ROWS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """array<bigint>: a hash of each word, A-Z in lower case."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
    # most words have no capitals; translate goes character by character
    return F.transform(words, lambda w: F.xxhash64(F.when(F.lower(w) == w, w).otherwise(F.translate(w, UPPER, LOWER))))


def _zipped(a: str, b: str, shift: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(a[i], b[i + shift]) for all i that have both."""
    n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return F.zip_with(F.slice(F.col(a), F.lit(1), n), F.slice(F.col(b), F.lit(1 + shift), n), f)


def _joined(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def with_grams(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds, to a column `_h` of word hashes, `_5` (hashes of K-grams), `_10` (of windows), `_m` (the chosen K-grams, each as 31 bits of
    its hash and its place from the end) and `_s{m}` for each short length m."""
    df = df.withColumn("_2", _zipped("_h", "_h", 1, _joined))
    df = df.withColumn("_4", _zipped("_2", "_2", 2, _joined))
    df = df.withColumn("_5", _zipped("_4", "_h", 4, _joined))
    df = df.withColumn("_10", _zipped("_5", "_5", K, _joined))
    df = df.withColumn("_v", F.transform("_5", lambda g, i: F.shiftrightunsigned(g, 33) * F.lit(LOW) + (F.lit(LOW - 1) - i)))
    df = df.withColumn("_v2", _zipped("_v", "_v", 1, _least))
    df = df.withColumn("_v4", _zipped("_v2", "_v2", 2, _least))
    df = df.withColumn("_m", F.array_distinct(_zipped("_v4", "_v4", GRAMS - 4, _least)))
    if short:
        df = df.withColumn("_s1", F.col("_h"))
        for m in range(2, max(short) + 1):
            df = df.withColumn(f"_s{m}", _zipped(f"_s{m - 1}", "_h", m - 1, _joined))
    return df.withColumn("_n", F.size("_h"))


def _place(v: Column) -> Column:
    return (F.lit(LOW - 1) - v.bitwiseAND(F.lit(LOW - 1))).cast("int")


def _cell(m: Column | int, key: Column, start: Column, windows: Column) -> Column:
    m = F.lit(m) if isinstance(m, int) else m
    return F.struct(m.cast("int").alias("m"), key.alias("key"), start.cast("int").alias("start"), windows.alias("windows"))


def _fingerprints() -> Column:
    """A cell for each chosen K-gram, with the windows that hold it. `_10` is named twice so that it isn't computed inside the function."""

    def cell(v: Column) -> Column:
        start = F.greatest(_place(v) - (WINDOW - K), F.lit(0))
        held = F.least(F.lit(GRAMS), F.size("_10") - start)
        return _cell(WINDOW, F.element_at("_5", _place(v) + 1), start, F.slice(F.col("_10"), start + 1, held))

    return F.transform("_m", cell)


def _short_grams(m: int) -> Column:
    return F.transform(f"_s{m}", lambda gram, at: _cell(m, gram, at, F.array(gram)))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """m, key, window, item: the distinct windows of items, with the fingerprint that leads to them; m is their length."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), word_hashes(F.col("text")).alias("_h"))
    rows = with_grams(rows, list(range(1, WINDOW))).where("_n > 0")
    whole = F.coalesce(*[F.when(F.col("_n") == m, F.element_at(f"_s{m}", 1)) for m in range(1, WINDOW)])
    only = F.array(_cell(F.col("_n"), whole, F.lit(0), F.array(whole)))
    cells = rows.select("item", F.explode(F.when(F.col("_n") < WINDOW, only).otherwise(_fingerprints())).alias("c"))
    return cells.select("item", "c.m", "c.key", F.explode("c.windows").alias("window")).distinct()


def window_classes(windows: DataFrame) -> DataFrame:
    """m, window, class: equal classes lie in the same items. A class is a hash of its set of ids, made without collecting them."""
    rows = windows.select("m", "window", "item").distinct()
    mark = lambda salt: F.coalesce(F.bit_xor(F.when(F.col("item").isNotNull(), F.xxhash64("item", F.lit(salt)))), F.lit(0))
    return rows.groupBy("m", "window").agg(F.xxhash64(F.count("item"), mark(1), mark(2)).alias("class"))


def _within(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row of docs gives one."""
    windows = staged(benchmark_windows(items), "windows")
    classes = staged(window_classes(windows), "classes")
    short = sorted(r["m"] for r in windows.where(F.col("m") < WINDOW).select("m").distinct().collect())  # at most WINDOW - 1

    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("_text"), word_hashes(F.col("text")).alias("_h"))
    rows = with_grams(rows, short)
    # a cell of length 0 stands for the document itself, so that one pass over the texts gives it and its hits
    itself = F.array(_cell(0, F.xxhash64("doc_id", "_text"), F.lit(0), F.array().cast("array<bigint>")))
    grams = [_short_grams(m) for m in short]
    cells = rows.select("doc_id", "_text", "_n", F.explode(F.concat(itself, _fingerprints(), *grams)).alias("c")).select("doc_id", "_text", "_n", "c.*")
    keys = _within(windows.select("m", "key").distinct()).withColumn("met", F.lit(True))
    cells = cells.join(keys, ["m", "key"], "left").where("met OR m = 0")
    around = cells.select("doc_id", "_text", "_n", "m", "start", F.posexplode_outer("windows").alias("i", "window"))
    hits = around.join(_within(classes), ["m", "window"], "left").where("class IS NOT NULL OR m = 0")

    begin = (F.col("start") + F.col("i")).cast("long")
    span = F.when(F.col("m") > 0, F.struct(begin.alias("start"), (begin + F.col("m")).alias("end")))
    found = hits.groupBy("doc_id", "_text").agg(
        F.max("_n").alias("_n"), F.count(F.when(F.col("m") == 0, 1)).alias("copies"),
        F.collect_set(span).alias("spans"), F.sort_array(F.collect_set("class")).alias("classes"),
    )
    none = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("total"))
    cover = lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["total"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["upto"]))).alias("total"))
    found = staged(found.select("doc_id", "copies", F.col("_n").cast("long").alias("n_words"), F.aggregate(F.sort_array("spans"), none, cover, lambda a: a["total"]).alias("n_hit"), "classes", F.md5(F.array_join("classes", ",")).alias("signature")), "found")

    lists = signature_items(found.where("n_hit > 0").select("signature", "classes").dropDuplicates(["signature"]), windows, classes)
    met = found.where("n_hit > 0").join(lists, "signature", "left")
    met = met.select("doc_id", "copies", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    clean = found.where("n_hit = 0").select("doc_id", "copies", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    # equal rows come back in two steps, as an array of all of them could be long
    out = met.unionByName(clean).withColumn("_many", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 4096))))
    out = out.withColumn("_one", F.explode(F.sequence(F.lit(1), F.least(F.lit(4096), F.col("copies") - F.col("_many") * 4096))))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def signature_items(signatures: DataFrame, windows: DataFrame, classes: DataFrame) -> DataFrame:
    """signature, n_items, items_sha256 of signatures (signature, classes); a class has the items of any window of it."""
    one = classes.groupBy("class").agg(F.min(F.struct("m", "window")).alias("w")).select("class", "w.m", "w.window")
    members = one.join(windows.select("m", "window", "item").where("item IS NOT NULL").distinct(), ["m", "window"]).select("class", "item")
    listed = signatures.select("signature", F.explode("classes").alias("class")).join(members, "class").groupBy("signature").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    return listed.select("signature", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

#: Every window of every length that the benchmark has, spelled out and joined.
OP12_SQL = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS m, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS k, doc_id, {_SQL_WORDS} AS w FROM documents),
dw AS (SELECT k, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT DISTINCT k, i, m, s FROM dw SEMI JOIN bw USING (m, s)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS p FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM hit JOIN bw USING (m, s) WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)"""
