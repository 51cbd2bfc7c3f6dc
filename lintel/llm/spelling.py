"""Spelling variants: words one edit apart are found by an even-partition pigeonhole join, in DataFrame functions only.

A word of length l is cut into two segments at floor(l / 2). One edit leaves one of them whole, so an indexed word is met by the probing
word's substring of that length: at the same place, or one further on if the probing word is one longer and the edit lies before it.
Groups of short segments are large (all words that begin with the same two letters), so words of a group are not compared with each
other: the part that holds the edit is cut evenly once more, and one of its two segments is whole again. A key is the length, which
segment and sub-segment are whole, and both of them, hashed; what meets is verified by the distance itself, so collisions do no harm.

Each word so gives four index rows and eight probes (four for words of its own length, four for those one shorter), whatever the groups.
Pairs are verified in the join and deduplicated after it; forms are then followed by doubling: each pass replaces a word's root by its
root's root, so chains of m forms take log2(m) passes, and as counts at least double from word to form, m is below log2(count).

Defined results: a null text has no runs; a null doc_id counts as the empty string in the checksum; repeated rows count again; a run that
loses its only letter is no word; an empty table gives no rows; other columns are ignored. A run of a million letters is a word like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.common import dropped, staged

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT = 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 97


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters, one in DAMAGE of them with a letter lost, by a checksum of document and run."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    # most runs have no capitals; translate goes character by character
    runs = runs.select("doc", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    lost = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), lost), F.substring(F.col("run"), lost + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key(length: Column, segment: int, sub: int, whole: Column, part: Column) -> Column:
    return F.xxhash64(length, F.lit(segment), F.lit(sub), whole, part)


def segment_keys(word: Column, length: Column, longer: bool) -> Column:
    """The four keys by which a word meets indexed words of `length` letters: its own length, or one less if it is `longer`.

    Substrings behind the edit lie one place further on in a longer word."""
    shift = 1 if longer else 0
    cut = F.floor(length / 2).cast("int")
    rest = (length - cut).cast("int")
    part = lambda start, size: F.substring(word, (start + 1).cast("int"), size.cast("int"))
    keys = []
    for segment, start, whole_size, edited, size in ((0, F.lit(0), cut, cut, rest), (1, cut + shift, rest, F.lit(0), cut)):
        whole, half = part(start, whole_size), F.floor(size / 2)
        keys.append(_key(length, segment, 0, whole, part(edited, half)))
        keys.append(_key(length, segment, 1, whole, part(edited + half + shift, size - half)))
    return F.array(*keys)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: distinct pairs of words (word, n) one edit apart, b the longer or the later of equally long ones."""
    length = F.char_length("word")
    index = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(segment_keys(F.col("word"), length, False)).alias("key"))
    probes = F.concat(segment_keys(F.col("word"), length, False), segment_keys(F.col("word"), length - 1, True))
    asking = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(probes).alias("key"))
    # a file of words is far smaller than the rows made of it, so Spark's estimate would send millions of probes through the driver
    index = index.hint("merge")
    one_edit = ((F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    met = index.join(asking, (index["key"] == asking["key"]) & one_edit)
    return met.select("a", "a_n", "b", "b_n").distinct()


def nearest_forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n."""
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    sides = pairs.select(F.explode(both).alias("s")).select("s.*")
    # of the largest count the first word; strings compare by bytes of UTF-8, which is the order of code points
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("near_n", -F.col("best.col1"))
    counts = F.col("near_n") >= 2 * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(counts, F.col("best.near")).alias("form"), F.when(counts, F.col("near_n")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root, the end of a word's chain of forms (word, form), by doubling."""
    links = staged(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links")
    while links.where("moved").limit(1).count():
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = staged(moved, "links")
        dropped(links)
        links = after
    return forms.join(links.select("word", "root").hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of docs (doc_id, text)."""
    words = staged(count_words(docs), "words")
    forms = staged(nearest_forms(words, near_pairs(words)), "forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Checksums by the usual table, made by eight steps a byte; near words by their deletions instead of segments.
OP13_SQL = """WITH RECURSIVE steps AS (SELECT i, 0 AS s, i AS c FROM (SELECT unnest(range(256)) AS i) UNION ALL
 SELECT i, s + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE s < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE s = 8),
runs AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM
 (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hex AS (SELECT run, k, hex(encode(doc || ':' || run)) AS x FROM runs),
summed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM hex, tab),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM summed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n FROM del a JOIN del b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM del a JOIN v b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM del a JOIN v b ON a.d = b.word),
best AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS r FROM near),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * v.n THEN near END AS form, CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n FROM v LEFT JOIN best b ON b.word = v.word AND r = 1),
walk AS (SELECT word, form AS root, 1 AS d FROM forms WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form, d + 1 FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT word, form, coalesce(arg_max(root, d), word) AS root, n, n_near, form_n FROM forms LEFT JOIN walk USING (word) GROUP BY word, form, n, n_near, form_n"""
