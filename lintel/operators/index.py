"""Term statistics and the two lexical scores, as joins on terms.

Postings are rows (doc, term, tf), and the index adds weights to them, dealt by document. A join on term is the look-up: the query side
is counted and sent to the documents, in blocks if it is large, so that scores are summed up where a document lies; only the best rows
of a query leave a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.session import bucketed, staged


def postings(docs: DataFrame, id_col: str, terms: Column, doc: str = "doc") -> DataFrame:
    """doc, term, tf."""
    rows = docs.select(F.col(id_col).alias(doc), F.explode(terms).alias("term"))
    return rows.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    """term, df."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def collection(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: n_docs, avg_len (documents without terms count)."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_terms"))).select(
        "n_docs", (F.col("n_terms") / F.greatest("n_docs", F.lit(1))).alias("avg_len")
    )


def tfidf_weights(posts: DataFrame, df: DataFrame, n_docs: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, term, weight, normalised to length 1: (1 + ln tf) * (ln((N + 1) / (df + 1)) + 1)."""
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    raw = posts.join(df, "term").crossJoin(F.broadcast(n_docs.select("n_docs"))).select(doc, "term", ((1 + F.log("tf")) * idf).alias("w"))
    norms = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, doc).select(doc, "term", (F.col("w") / F.col("norm")).alias("weight"))


#: Query terms that are sent to every task at once; more are asked for in blocks of queries.
ASKED_ROWS = 2_000_000
K1, B = 1.5, 0.75


def term_index(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """doc, term, tf, len, weight (normalised tf-idf), gain (BM25 of one query term), dealt by doc.

    One shuffle on term brings document frequencies, one on doc lengths and norms; whatever is asked then meets a document where it lies."""
    rows = posts.join(document_frequencies(posts), "term").crossJoin(F.broadcast(stats))
    n, df = F.col("n_docs"), F.col("df")
    raw = (1 + F.log("tf")) * (F.log((n + 1) / (df + 1)) + 1)
    own = Window.partitionBy("doc")
    rows = rows.withColumn("w", raw).withColumn("len", F.sum("tf").over(own)).withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(own)))
    gain = F.log(1 + (n - df + 0.5) / (df + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest("avg_len", F.lit(1e-9))))
    return rows.select("doc", "term", "tf", "len", (F.col("w") / F.col("norm")).alias("weight"), gain.alias("gain"))


def asked_terms(queries: DataFrame, posts: DataFrame, stats: DataFrame) -> DataFrame:
    """query, term, qtf, qlen, qweight (normalised tf-idf; terms that the index lacks do not count)."""
    of_query = Window.partitionBy("query")
    asked = queries.select("query", "term", F.col("tf").alias("qtf"), F.sum("tf").over(of_query).alias("qlen"))
    # only terms that are asked for are counted
    df = document_frequencies(posts.join(F.broadcast(asked.select("term").distinct()) if asked.count() <= ASKED_ROWS else asked.select("term").distinct(), "term", "left_semi"))
    rows = asked.join(df, "term").crossJoin(F.broadcast(stats.select("n_docs")))
    rows = rows.withColumn("w", (1 + F.log("qtf")) * (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1))
    return rows.select("query", "term", "qtf", "qlen", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_query))).alias("qweight"))


def pair_scores(asked: DataFrame, index: DataFrame) -> DataFrame:
    """query, doc, tfidf, bm25, overlap of all pairs that share a term, in one pass.

    Queries go to the documents: the sums of a pair are made where its document lies, and no pair is shuffled. Queries of more than
    ASKED_ROWS terms go in blocks. Overlap is 0.62 recall + 0.38 precision of the multisets, + 0.08 if a number is shared, at most 1."""
    blocks = max(1, -(-asked.count() // ASKED_ROWS))
    parts = [asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) for i in range(blocks)]
    out = []
    for part in parts:
        met = index.join(F.broadcast(part), "term")
        common = F.sum(F.least("qtf", "tf"))
        number = F.max(F.col("term").rlike(r"^\d").cast("int"))
        overlap = 0.62 * common / F.first("qlen") + 0.38 * common / F.first("len") + 0.08 * number
        sums = [F.sum(F.col("qweight") * F.col("weight")).alias("tfidf"), F.sum((1 + F.log("qtf")) * F.col("gain")).alias("bm25"), F.least(F.lit(1.0), overlap).alias("overlap")]
        out.append(met.groupBy("query", "doc").agg(*sums))
    return reduce(DataFrame.unionByName, out)


def sent(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has no more than ASKED_ROWS rows."""
    return F.broadcast(df) if df.count() <= ASKED_ROWS else df


def document_postings(docs: DataFrame, terms: Column, only: DataFrame | None = None) -> DataFrame:
    """doc, term, tf, len of docs (doc, unique, and what terms need), in buckets of doc; each document has one row more, with a null term.

    Texts are dealt by document once, so terms are counted and, later, scores summed up without another shuffle. With `only` (term, distinct)
    other terms count for the length alone and are dropped where they are cut."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.repartition(tasks, "doc").select("doc", terms.alias("terms"))
    rows = cut.select("doc", F.size("terms").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "terms")).alias("term"))
    if only is not None:
        rows = rows.join(sent(only).withColumn("wanted", F.lit(True)), "term", "left").where("wanted OR term IS NULL")
    return bucketed(rows.groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "doc", "postings")


def scan_scores(queries: DataFrame, docs: DataFrame, terms: Column, scores: tuple[str, ...]) -> DataFrame:
    """query, doc and the scores wanted (of tfidf, bm25, overlap) of all pairs that share a term, by one pass over docs (doc, ...).

    queries: query, term, tf. Only asked terms are kept of a document, unless tf-idf wants all of them for its norm; a pair's scores are
    sums over rows of its document, which lie in one bucket."""
    asked = staged(queries, "asked")
    only = asked.select("term").distinct()
    everything = document_postings(docs, terms, None if "tfidf" in scores else only)
    head = everything.where("term IS NULL").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("terms")).first()  # one row
    n, average = head["n"], max(head["terms"] / max(head["n"], 1), 1e-9)
    posts = everything.where("term IS NOT NULL")
    df = posts if "tfidf" in scores else posts.join(sent(only), "term", "left_semi")
    df = staged(df.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")

    of_query = Window.partitionBy("query")
    weight = lambda tf: (1 + F.log(tf)) * (F.log((n + 1) / (F.col("df") + 1)) + 1)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.select("query", "term", F.col("tf").alias("qtf"), F.sum("tf").over(of_query).alias("qlen")).join(df, "term").withColumn("qw", weight("qtf"))
    asked = staged(asked.withColumn("qw", F.col("qw") / F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(of_query))).withColumn("gain", (1 + F.log("qtf")) * idf * (K1 + 1)), "asked")

    common, number = F.sum(F.least("qtf", "tf")), F.max(F.col("term").rlike(r"^\d").cast("int"))
    sums = {
        "tfidf": F.sum(F.col("qw") * weight("tf")),
        "bm25": F.sum(F.col("gain") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / average))),
        "overlap": F.least(F.lit(1.0), 0.62 * common / F.first("qlen") + 0.38 * common / F.first("len") + 0.08 * number),
    }
    blocks = max(1, -(-asked.count() // ASKED_ROWS))
    parts = [asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) for i in range(blocks)]
    pairs = reduce(DataFrame.unionByName, [posts.join(F.broadcast(part), "term").groupBy("query", "doc").agg(*[sums[s].alias(s) for s in scores]) for part in parts])
    if "tfidf" not in scores:
        return pairs
    norms = posts.join(sent(df), "term").groupBy("doc").agg(F.sqrt(F.sum(weight("tf") * weight("tf"))).alias("norm"))
    return pairs.join(norms, "doc").select("query", "doc", *[(F.col(s) / F.col("norm") if s == "tfidf" else F.col(s)).alias(s) for s in scores])


def bm25_scores(queries: DataFrame, posts: DataFrame, stats: DataFrame) -> DataFrame:
    """query, doc, score; a query term weighs 1 + ln of its count."""
    return pair_scores(asked_terms(queries, posts, stats), term_index(posts, stats)).select("query", "doc", F.col("bm25").alias("score"))


def tfidf_scores(queries: DataFrame, posts: DataFrame, stats: DataFrame) -> DataFrame:
    """query, doc, score. Query terms that the index lacks do not count, in its length either."""
    return pair_scores(asked_terms(queries, posts, stats), term_index(posts, stats)).select("query", "doc", F.col("tfidf").alias("score"))


def top(scores: DataFrame, k: int, by: str = "score", query: str = "query", tie: str = "doc", decimals: int | None = 6) -> DataFrame:
    """Adds rank 1..k; scores are rounded first so that ties are ties."""
    rounded = scores.withColumn(by, F.round(by, decimals)) if decimals is not None else scores
    w = Window.partitionBy(query).orderBy(F.desc(by), tie)
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid_scores(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """0.82 tf-idf + 0.18 BM25 relative to the query's best. pairs: query, doc, tfidf, bm25. The best of each of the queries asked are
    sent to the pairs if they are no more than ASKED_ROWS."""
    best = pairs.groupBy("query").agg(F.max("bm25").alias("m"))
    few = asked.select("query").distinct().count() <= ASKED_ROWS
    share = F.when(F.col("m") > 0, F.col("bm25") / F.col("m")).otherwise(0.0)
    return pairs.join(F.broadcast(best) if few else best, "query").select("query", "doc", (0.82 * F.col("tfidf") + 0.18 * share).alias("score"))


def catalogue_routes(queries: DataFrame, posts: DataFrame, codes: DataFrame, stats: DataFrame, k: int = 5, prefixes: list[str] | None = None) -> DataFrame:
    """The k catalogue entries nearest to a query with a positive score; codes: doc, code. Ties by code, then by document.

    Codes are merged in, never broadcast, as a catalogue of any size can look small in its file; without prefixes only pairs whose
    score is among the k best of their query meet them, equal scores included."""
    scored = tfidf_scores(queries, posts, stats).withColumn("score", F.round("score", 6)).where(F.col("score") > 0)
    if not prefixes:
        scored = scored.withColumn("_r", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("_r") <= k).drop("_r")
    scored = scored.join(codes.hint("merge"), "doc")
    if prefixes:
        scored = scored.where(F.greatest(*[F.startswith("code", F.lit(p)) for p in prefixes], F.lit(False)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "code", "doc"))).where(F.col("rank") <= k)


def count_cosine(queries: DataFrame, posts: DataFrame) -> DataFrame:
    """Cosine of raw counts."""
    norm = lambda p, c, n: p.groupBy(c).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias(n))
    dots = queries.withColumnRenamed("tf", "qtf").join(posts, "term").groupBy("query", "doc").agg(F.sum(F.col("qtf") * F.col("tf")).alias("dot"))
    return dots.join(norm(queries, "query", "qn"), "query").join(norm(posts, "doc", "dn"), "doc").select("query", "doc", (F.col("dot") / (F.col("qn") * F.col("dn"))).alias("cosine"))


def token_coverage(queries: DataFrame, posts: DataFrame) -> DataFrame:
    """query, doc, coverage: the share of a query's distinct tokens that a document holds; pairs without a common token are left out."""
    sizes = queries.groupBy("query").agg(F.count(F.lit(1)).alias("kinds"))
    common = queries.select("query", "term").join(posts.select("doc", "term"), "term").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("n"))
    return common.join(sizes, "query").select("query", "doc", (F.col("n") / F.col("kinds")).alias("coverage"))


#: Vectors that ask at once: as many are broadcast; and those that meet a piece of the others in one matrix product.
ASKING_VECTORS, PIECE = 32_768, 1024


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, float).reshape(len(rows), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(held: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of what a row holds (ids, scores) and of new columns the k best, ties to the smaller id."""
    at = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ids ascend
    ids, scores = ids[at], np.take_along_axis(scores, at, 1)
    if held is not None:
        ids, scores = np.concatenate([held[0], ids], 1), np.concatenate([held[1], scores], 1)
        at = np.lexsort((ids, -scores), axis=1)[:, :k]
        ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
    return ids, scores


def nearest_vectors(vectors: DataFrame, k: int, asking: Column | None = None) -> DataFrame:
    """query, doc, score, rank: each vector's k nearest others by cosine, ties by id. vectors: id, embedding; all ask, or those for which
    `asking` holds.

    Those that ask are sent to all tasks, ASKING_VECTORS at a time; the others are scanned where they lie, and of each task only k rows a
    query move. What blocks of askers found is written, so that a plan stays small however many there are."""
    spark = vectors.sparkSession
    known = vectors.where("embedding IS NOT NULL").select("id", "embedding")
    asks = known if asking is None else known.where(asking)
    blocks = max(1, -(-asks.count() // ASKING_VECTORS))
    parts = []
    for b in range(blocks):
        part = asks if blocks == 1 else asks.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        rows = part.collect()  # about ASKING_VECTORS
        if not rows:
            continue
        sent_rows = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), _unit([r["embedding"] for r in rows])))

        def scan(batches: Iterator[pd.DataFrame], sent_rows=sent_rows) -> Iterator[pd.DataFrame]:
            ids, units = sent_rows.value
            held: list = [None] * -(-len(ids) // PIECE)
            for batch in batches:
                batch = batch.sort_values("id")
                docs, others = batch["id"].to_numpy(), _unit(batch["embedding"].tolist())
                for i in range(len(held)):
                    mine = slice(i * PIECE, (i + 1) * PIECE)
                    for j in range(0, len(docs), PIECE):
                        scores = np.round(np.clip(units[mine] @ others[j : j + PIECE].T, -1, 1), 6)
                        scores[ids[mine][:, None] == docs[None, j : j + PIECE]] = -np.inf
                        held[i] = _best(held[i], docs[j : j + PIECE], scores, k)
            for i, found in enumerate(held):
                if found is not None:
                    out = pd.DataFrame({"query": np.repeat(ids[i * PIECE : (i + 1) * PIECE], found[0].shape[1]), "doc": found[0].ravel(), "score": found[1].ravel()})
                    yield out[np.isfinite(out["score"])]

        found = known.mapInPandas(scan, "query long, doc long, score double")
        parts.append(found if blocks == 1 else staged(top(found, k), "nearest").drop("rank"))
    if not parts:
        parts = [spark.createDataFrame([], "query long, doc long, score double")]
    return top(reduce(DataFrame.unionByName, parts), k)


def group_scores(members: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """query, doc, score of members (query, doc, digest): the cosine of their text's vector (digest, embedding) and the one asked for."""
    scored = vectors.crossJoin(F.broadcast(asked.select(F.col("embedding").alias("other")))).select("digest", X.cosine(F.col("embedding"), F.col("other")).alias("score"))
    return members.join(scored, "digest").select("query", "doc", "score")


def latin_tokens(c: Column) -> Column:
    """Tokens of a text without the expansion of terms (the driver's corpora hold none of them)."""
    return X.word_tokens(c, expand=False)
