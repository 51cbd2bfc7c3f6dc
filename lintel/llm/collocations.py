"""Phrase collocations by Apriori passes: a phrase is counted only if both of its parts that are one word shorter are frequent.

Words are counted by DataFrame functions. Then each level reads the texts again: the frequent phrases of the level before are broadcast as
a set of their hashes, and a task emits a phrase of k words only if the phrases of its first and of its last k - 1 words are in that set.
Phrases travel as the two hashes of those parts and a count, 24 bytes each, summed up per batch first. What reaches LEAST occurrences
makes the table of the level, with its words and the counts of all its beginnings and endings from the tables before, so cuts are scored
without any further pass.

The broadcast set is an array of bits that hashes point to, of at most MOST_BITS bits (16 MB) whatever the corpus: phrases that share a bit
with a frequent one are counted as well and then fall below LEAST. It prunes and never decides, so counts are exact but for 64-bit hashes.

Defined results: a null text is empty; a null lang is `und`; equal rows count each; phrases of equal score and count are ordered by their
bytes; an empty table gives no rows; other columns are ignored. A very long text is cut at piece ends into slices of about SLICE bytes;
a piece without an end is worked off whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.llm.common import small_batches, staged

LEAST, LONGEST, TOP = 30, 4, 2000
#: Hundredths of a phrase's occurrences that lie in one longer candidate which then stands for it.
INSIDE = 80
SCALE = 2_000_000
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 27
SLICE = 1 << 20
MEMO = 400_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = ".,;:!?\n\x0b\f\r"

# The primes and rotations of the 64-bit xxHash, by which Spark hashes numbers.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hashed(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    h = (seed + P5 + np.uint64(8)) ^ (_turned(x * P2, 31) * P1)
    h = _turned(h, 27) * P1 + P4
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(a, b) of two arrays of uint64."""
    return _hashed(b, _hashed(a, np.uint64(SEED)))


class WordHashes(dict):
    """Spark's xxhash64(lang, word) of words, given as bytes; a piece's end is 0. Emptied when it holds MEMO words."""

    def __init__(self, lang: bytes):
        self.seed = xxhash.xxh64_intdigest(lang, SEED)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = 0 if word == b"." else xxhash.xxh64_intdigest(word, self.seed)
        return h


_ENDS_TO_DOTS = bytes.maketrans(ENDS.encode() + b"\t", b"." * len(ENDS) + b" ")


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The words of texts in lower case, with b"." where a piece ends; a slice ends with a piece."""
    whole = b".".join(texts).translate(_ENDS_TO_DOTS).lower()  # bytes have no other capitals than A-Z
    at = 0
    while at < len(whole):
        end = whole.find(b".", at + SLICE)
        end = len(whole) if end < 0 else end
        yield whole[at:end].replace(b".", b" . ").split()
        at = end


def bits_of(hashes: DataFrame) -> np.ndarray:
    """The set of hashes `h` as an array of bits, of 16 to 32 for each of them but MOST_BITS at most; a bit is the end of a hash."""
    size = min(MOST_BITS, max(FEWEST_BITS, 1 << (16 * hashes.count()).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(size - 1))
    words = hashes.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # at most MOST_BITS / 64 rows
    held = np.zeros(size // 64, np.int64)
    held[found["word"].to_numpy()] = found["bits"].to_numpy()
    return held.view(np.uint8)


def phrases(hashes: np.ndarray, k: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the phrases of k words in a slice whose two parts are in the set: hashes of the first and of the last k - 1 words, and counts."""
    part, whole = hashes, hashes != 0
    for _ in range(k - 2):
        part, whole = joined_hash(part[:-1], part[1:]), whole[:-1] & whole[1:]
    bit = part & np.uint64(len(bits) * 8 - 1)
    frequent = whole & ((bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    at = np.flatnonzero(frequent[:-1] & frequent[1:])
    first, second = part[at], part[at + 1]
    _, one, n = np.unique(joined_hash(first, second), return_index=True, return_counts=True)
    return first[one], second[one], n


def _emitter(k: int, bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: dict[bytes, WordHashes] = {}
        held = bits.value
        for batch in batches:
            by_lang: dict[bytes, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                if len(memos) > 16:  # langs can be many; words of one at a time are held
                    memos.clear()
                memo = memos.setdefault(lang, WordHashes(lang))
                for words in slices(texts):
                    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
                    if len(hashes) >= k:
                        first, second, n = phrases(hashes, k, held)
                        yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(n.astype(np.int64))], names=["first", "second", "f"])

    return emit


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of docs (lang, text)."""
    words = docs.select("lang", F.explode(F.split("text", r"[\t\x20.,;:!?\x0A-\x0D]+")).alias("word")).where("word <> ''")
    words = words.select("lang", F.when(F.lower("word") == F.col("word"), F.col("word")).otherwise(F.translate("word", UPPER, LOWER)).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))


def level_tables(docs: DataFrame, counts: DataFrame) -> list[DataFrame]:
    """For 1 to LONGEST words, as far as there are any: h, lang, words, begins, ends. h is a phrase's hash; begins and ends have the counts
    of its first and of its last 1, 2, ... words, the phrase itself at the end of both."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("lang").cast("binary"), F.col("text").cast("binary"))
    own = F.array("f")
    table = staged(counts.where(F.col("f") >= LEAST).select(F.xxhash64("lang", "word").alias("h"), "lang", F.array("word").alias("words"), own.alias("begins"), own.alias("ends")), "level")
    tables = []
    while not table.isEmpty():
        tables.append(table)
        k = len(tables) + 1
        if k > LONGEST:
            break
        bits = spark.sparkContext.broadcast(bits_of(table.select("h")))
        emitted = texts.mapInArrow(_emitter(k, bits), "first long, second long, f long")
        counted = emitted.groupBy("first", "second").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)
        first = table.select(F.col("h").alias("first"), "lang", F.col("words").alias("begin"), "begins")
        second = table.select(F.col("h").alias("second"), F.element_at("words", -1).alias("last"), "ends")
        met = counted.join(first, "first").join(second, "second")
        grown = lambda to: F.concat(to, F.array("f"))
        table = staged(met.select(F.xxhash64("first", "second").alias("h"), "lang", F.concat("begin", F.array("last")).alias("words"), grown(F.col("begins")).alias("begins"), grown(F.col("ends")).alias("ends")), "level")
        bits.unpersist()
    return tables


def _lowest_cut(k: int) -> Column:
    """score, cut, l, r of the lowest-scoring cut of a phrase of k words; products are decimals, as they may pass 64 bits."""

    def cut(i: int) -> Column:
        left, right = F.element_at("begins", i), F.element_at("ends", k - i)
        both = (left.cast("decimal(20,0)") + right.cast("decimal(20,0)")).cast("decimal(21,0)")
        product = F.element_at("begins", k).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(7,0)")
        score = F.call_function("div", product, both)
        return F.struct(score.cast("long").alias("score"), F.lit(i).alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*[cut(i) for i in range(1, k)]))


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each lang the TOP best phrases of 2 to LONGEST words."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = staged(word_counts(docs), "words")
    tables = level_tables(docs, counts)
    found = [t.select("lang", "words", F.element_at("begins", k).alias("a"), _lowest_cut(k).alias("c")) for k, t in enumerate(tables[1:], 2)]
    if not found:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found = reduce(DataFrame.unionByName, found)

    # a phrase inside a longer candidate that has nearly all of its occurrences
    inner = [F.slice("words", i + 1, m) for k in range(3, LONGEST + 1) for m in range(2, k) for i in range(k - m + 1)]
    sizes = [k for k in range(3, LONGEST + 1) for m in range(2, k) for i in range(k - m + 1)]
    inside = F.filter(F.array(*[F.when(F.size("words") == k, part) for k, part in zip(sizes, inner)]), lambda x: x.isNotNull())
    longer = found.where(F.size("words") > 2).select("lang", F.explode(inside).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("most"))
    apart = found.join(longer, ["lang", "words"], "left").where("most IS NULL OR 100 * CAST(most AS DECIMAL(20, 0)) < %d * CAST(a AS DECIMAL(20, 0))" % INSIDE)

    rows = apart.select("lang", F.array_join("words", " ").alias("phrase"), "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= TOP)
    # the best of each part of a lang first, so that no task sorts all phrases of one
    rows = ranked(ranked(rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))), "lang", "part"), "lang")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All phrases are counted, frequent parts or not.
OP11_SQL = f"""WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM
 (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, w[i:i + k - 1] AS ws, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k >= 2 AND f >= {LEAST}),
cuts AS (SELECT c.lang, c.k, c.ws, c.f AS a, s.i, l.f AS l, r.f AS r, CAST(c.f::HUGEINT * {SCALE} // (l.f + r.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS i FROM c) s JOIN c USING (lang, ws)
 JOIN g l ON l.lang = s.lang AND l.ws = s.ws[1:s.i] JOIN g r ON r.lang = s.lang AND r.ws = s.ws[s.i + 1:s.k]),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, i) = 1),
ins AS (SELECT lang, ws, max(a) AS most FROM (SELECT lang, words[i:i + m - 1] AS ws, a FROM (SELECT lang, ws AS words, f AS a, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k)) GROUP BY ALL),
kept AS (SELECT low.*, array_to_string(ws, ' ') AS phrase FROM low LEFT JOIN ins USING (lang, ws) WHERE most IS NULL OR 100 * most < {INSIDE} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN t USING (lang) QUALIFY rank <= {TOP}"""
