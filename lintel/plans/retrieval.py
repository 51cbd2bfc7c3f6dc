"""Retrieval over the driver's corpora: benchmark texts are clauses that ask, documents are sections that answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.operators import index as I
from lintel.operators import ranking as R
from lintel.operators.impact_index import ImpactIndex
from lintel.plans.registry import dealt, query, table
from lintel.session import deals, staged

TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[A-Za-z가-힣]{{2,}}|\d+(?:\.\d+)?')"
SQL_POSTS = f"""
dp AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({TOKENS.format("text")}) AS term FROM documents) GROUP BY doc, term),
qp AS (SELECT query, term, count(*) AS tf FROM (SELECT item_id AS query, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY query, term),
df AS (SELECT term, count(*) AS df FROM dp GROUP BY term),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM dp) / (SELECT count(*) FROM documents)::DOUBLE AS avg_len)"""
SQL_BM25 = """
ln AS (SELECT doc, sum(tf) AS len FROM dp GROUP BY doc),
bm AS (SELECT q.query, d.doc, sum((1 + ln(q.tf)) * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * ln.len / st.avg_len))) AS score
 FROM qp q JOIN dp d USING (term) JOIN df USING (term) JOIN ln ON ln.doc = d.doc, st GROUP BY q.query, d.doc)"""
SQL_TFIDF = """
dr AS (SELECT doc, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM dp JOIN df USING (term), st),
dw AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM dr),
qr AS (SELECT query, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM qp JOIN df USING (term), st),
qw AS (SELECT query, term, w / sqrt(sum(w * w) OVER (PARTITION BY query)) AS w FROM qr),
ti AS (SELECT query, doc, sum(qw.w * dw.w) AS score FROM qw JOIN dw USING (term) GROUP BY query, doc)"""


def _top_sql(source: str, k: int) -> str:
    return f"SELECT query, doc, score, CAST(n AS INT) AS rank FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS n FROM (SELECT query, doc, round(score, 6) AS score FROM {source})) WHERE n <= {k}"


#: Documents, or names of parts, that one task counts the terms of, whatever the size of the table.
DEALT, DEALT_NAMES = 5_000, 10_000


def _posts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of sections and clauses, and the collection's row. One file is one task: sections are dealt out before they are cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    posts = I.postings(dealt(docs, "doc_id", DEALT), "doc_id", I.latin_tokens(F.col("text")))
    asked = I.postings(table(spark, sf_dir, "benchmark"), "item_id", I.latin_tokens(F.col("text")), "query")
    return posts, asked, I.collection(docs, posts)


def _pairs(spark: SparkSession, sf_dir: str, *scores: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    asked = I.postings(table(spark, sf_dir, "benchmark"), "item_id", I.latin_tokens(F.col("text")), "query")
    return I.scan_scores(asked, docs, I.latin_tokens(F.col("text")), scores)


def _top(pairs: DataFrame, column: str, k: int) -> DataFrame:
    return I.top(pairs.select("query", "doc", F.col(column).alias("score")), k)


@query("R03_bm25_top3", f"WITH {SQL_POSTS}, {SQL_BM25} {_top_sql('bm', 3)}")
def bm25_top3(spark, sf_dir):
    return _top(_pairs(spark, sf_dir, "bm25"), "bm25", 3)


@query("A07_df_stats", f"WITH {SQL_POSTS} SELECT term, df FROM df WHERE df > 1")
def df_stats(spark, sf_dir):
    return I.document_frequencies(_posts(spark, sf_dir)[0]).where("df > 1")


@query("R01_tfidf_weights", f"WITH {SQL_POSTS}, {SQL_TFIDF} SELECT doc, count(*) AS terms, round(max(w), 6) AS heaviest FROM dw GROUP BY doc")
def tfidf_weights(spark, sf_dir):
    posts, _, stats = _posts(spark, sf_dir)
    return I.term_index(posts, stats).groupBy("doc").agg(F.count(F.lit(1)).alias("terms"), F.round(F.max("weight"), 6).alias("heaviest"))


@query("A08_l2_norms", f"WITH {SQL_POSTS} SELECT doc, round(sqrt(sum(tf * tf)), 6) AS norm FROM dp GROUP BY doc")
def l2_norms(spark, sf_dir):
    return _posts(spark, sf_dir)[0].groupBy("doc").agg(F.round(F.sqrt(F.sum(F.col("tf") * F.col("tf"))), 6).alias("norm"))


@query("R02_tfidf_top3", f"WITH {SQL_POSTS}, {SQL_TFIDF} {_top_sql('ti', 3)}")
def tfidf_top3(spark, sf_dir):
    return _top(_pairs(spark, sf_dir, "tfidf"), "tfidf", 3)


SQL_HYBRID = """
hy AS (SELECT query, doc, 0.82 * coalesce(t, 0) + 0.18 * CASE WHEN m > 0 THEN coalesce(b, 0) / m ELSE 0 END AS score FROM
 (SELECT query, doc, t, b, max(b) OVER (PARTITION BY query) AS m FROM (SELECT coalesce(ti.query, bm.query) AS query, coalesce(ti.doc, bm.doc) AS doc, ti.score AS t, bm.score AS b FROM ti FULL JOIN bm ON ti.query = bm.query AND ti.doc = bm.doc)))"""


@query("R04_hybrid_top3", f"WITH {SQL_POSTS}, {SQL_TFIDF}, {SQL_BM25}, {SQL_HYBRID} {_top_sql('hy', 3)}")
def hybrid_top3(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    return I.top(I.hybrid_scores(staged(_pairs(spark, sf_dir, "tfidf", "bm25"), "pairs"), asked), 3)


@query("U01_full_outer_scores", f"WITH {SQL_POSTS}, {SQL_TFIDF}, {SQL_BM25} SELECT query, count(*) AS docs, round(sum(b), 4) AS bm25 FROM (SELECT coalesce(ti.query, bm.query) AS query, coalesce(bm.score, 0) AS b FROM ti FULL JOIN bm ON ti.query = bm.query AND ti.doc = bm.doc) GROUP BY query")
def full_outer_scores(spark, sf_dir):
    """Both scores share their terms, so a pair that one of them knows is known to the other."""
    return _pairs(spark, sf_dir, "bm25").groupBy("query").agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum("bm25"), 4).alias("bm25"))


SQL_OVERLAP = """
ov AS (SELECT c.query, c.doc, least(1.0, 0.62 * common / ql + 0.38 * common / dl + 0.08 * num) AS score FROM
 (SELECT q.query, d.doc, sum(least(q.tf, d.tf)) AS common, max(CASE WHEN regexp_matches(term, '^[0-9]') THEN 1 ELSE 0 END) AS num FROM qp q JOIN dp d USING (term) GROUP BY q.query, d.doc) c
 JOIN (SELECT query, sum(tf) AS ql FROM qp GROUP BY query) a ON a.query = c.query JOIN (SELECT doc, sum(tf) AS dl FROM dp GROUP BY doc) b ON b.doc = c.doc)"""


@query("R20_token_overlap", f"WITH {SQL_POSTS}, {SQL_OVERLAP} {_top_sql('ov', 3)}")
def token_overlap(spark, sf_dir):
    return _top(_pairs(spark, sf_dir, "overlap"), "overlap", 3)


@query("R21_overlap_final", f"""WITH {SQL_POSTS}, {SQL_OVERLAP}, s AS (SELECT o.query, o.doc, round(CASE WHEN d.lang = 'en' THEN 1.0 ELSE 0.72 END * (0.84 * o.score + 0.08 * CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END), 6) AS score, o.score AS rel, d.source FROM ov o JOIN documents d ON d.doc_id = o.doc),
f AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, doc) AS u FROM s WHERE rel >= 0.1)
SELECT query, doc, score, CAST(n AS INT) AS rank FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS n FROM f WHERE u = 1) WHERE n <= 3""")
def overlap_final(spark, sf_dir):
    info = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang", "source")
    s = _pairs(spark, sf_dir, "overlap").where("overlap >= 0.1").join(info, "doc")
    in_scope = F.col("lang") == "en"
    s = s.withColumn("score", F.round(F.when(in_scope, 1.0).otherwise(0.72) * (0.84 * F.col("overlap") + 0.08 * F.coalesce(in_scope, F.lit(False)).cast("int")), 6))
    return I.top(R.first_per_key(s, ["query", "source"], [F.desc("score"), "doc"]), 3).select("query", "doc", "score", "rank")


SQL_GRAMS = """
k AS (SELECT p_partkey AS doc, regexp_replace(lower(p_name || ' ' || p_type), '[^0-9a-z가-힣]', '', 'g') AS k, p_brand AS code FROM part),
kp AS (SELECT doc, g AS term, count(*) AS tf FROM (SELECT doc, unnest(flatten([list_transform(range(1, length(k) - n + 2), lambda i: substr(k, i, n)) FOR n IN [2, 3, 4]])) AS g FROM k) GROUP BY doc, g),
s AS (SELECT n_nationkey AS query, regexp_replace(lower(n_name || ' promo steel'), '[^0-9a-z가-힣]', '', 'g') AS k FROM nation),
sp AS (SELECT query, g AS term, count(*) AS tf FROM (SELECT query, unnest(flatten([list_transform(range(1, length(k) - n + 2), lambda i: substr(k, i, n)) FOR n IN [2, 3, 4]])) AS g FROM s) GROUP BY query, g)"""


def _grams(spark, sf_dir):
    key = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z가-힣]", "")
    parts = table(spark, sf_dir, "part").select("p_partkey", key(F.concat_ws(" ", "p_name", "p_type")).alias("k"), "p_brand")
    named = dealt(parts.select("p_partkey", "k"), "p_partkey", DEALT_NAMES)
    asks = table(spark, sf_dir, "nation").select("n_nationkey", key(F.concat_ws(" ", "n_name", F.lit("promo steel"))).alias("k"))
    return parts, I.postings(named, "p_partkey", X.char_ngrams(F.col("k"))), I.postings(asks, "n_nationkey", X.char_ngrams(F.col("k")), "query")


@query("R05_catalog_router", f"""WITH {SQL_GRAMS}, df AS (SELECT term, count(*) AS df FROM kp GROUP BY term), st AS (SELECT count(*) AS n FROM k),
dr AS (SELECT doc, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM kp JOIN df USING (term), st), dw AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM dr),
qr AS (SELECT query, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM sp JOIN df USING (term), st), qw AS (SELECT query, term, w / sqrt(sum(w * w) OVER (PARTITION BY query)) AS w FROM qr),
r AS (SELECT query, dw.doc, round(sum(qw.w * dw.w), 6) AS score FROM qw JOIN dw USING (term) GROUP BY query, dw.doc)
SELECT query, doc, code, score, CAST(n AS INT) AS rank FROM (SELECT query, r.doc, code, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, code, r.doc) AS n FROM r JOIN k ON k.doc = r.doc WHERE score > 0) WHERE n <= 5""")
def catalog_router(spark, sf_dir):
    parts, posts, asked = _grams(spark, sf_dir)
    codes = parts.select(F.col("p_partkey").alias("doc"), F.col("p_brand").alias("code"))
    return I.catalogue_routes(asked, posts, codes, I.collection(parts, posts)).select("query", "doc", "code", "score", "rank")


SQL_COVER = r"""
kt AS (SELECT DISTINCT p_partkey AS doc, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{2,}|\d+(?:\.\d+)?')) AS t FROM part),
st AS (SELECT DISTINCT n_nationkey AS query, unnest(regexp_extract_all(lower(n_name || ' promo steel'), '[a-z]{2,}|\d+(?:\.\d+)?')) AS t FROM nation),
cv AS (SELECT st.query, kt.doc, count(*) / (SELECT count(*) FROM st x WHERE x.query = st.query) AS share FROM st JOIN kt USING (t) GROUP BY st.query, kt.doc)"""


@query("R07_stable_score", f"""WITH {SQL_GRAMS}, {SQL_COVER}, c AS (SELECT q.query, d.doc, sum(q.tf * d.tf) AS dot FROM sp q JOIN kp d USING (term) GROUP BY q.query, d.doc),
qn AS (SELECT query, sqrt(sum(tf * tf)) AS n FROM sp GROUP BY query), dn AS (SELECT doc, sqrt(sum(tf * tf)) AS n FROM kp GROUP BY doc)
SELECT c.query, c.doc, round((0.82 * least(1.0, 0.9 * least(1.0, 1.8 * dot / (qn.n * dn.n)) + 0.1 * coalesce(share, 0)) + 0.18) * CASE WHEN c.doc % 2 = 0 THEN 1 ELSE 0.72 END, 6) AS score FROM c JOIN qn ON qn.query = c.query JOIN dn ON dn.doc = c.doc LEFT JOIN cv ON cv.query = c.query AND cv.doc = c.doc""")
def stable_score(spark, sf_dir):
    _, posts, asked = _grams(spark, sf_dir)
    tokens = lambda df, i, to, *c: I.postings(df, i, F.array_distinct(I.latin_tokens(F.concat_ws(" ", *c))), to)
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_partkey", DEALT_NAMES)
    coverage = I.token_coverage(tokens(table(spark, sf_dir, "nation"), "n_nationkey", "query", "n_name", F.lit("promo steel")), tokens(parts, "p_partkey", "doc", "p_name", "p_type"))
    # a part meets a nation once at most, so tasks of pairs are as many as those of parts
    pairs = lambda df: df.repartition(deals(parts, DEALT_NAMES), "query", "doc")
    c = pairs(I.count_cosine(asked, posts)).join(pairs(coverage), ["query", "doc"], "left").na.fill(0.0, ["coverage"])
    yes, no = F.lit(True), F.lit(False)
    return c.select("query", "doc", F.round(R.stable_score(F.col("cosine"), F.col("coverage"), yes, no, F.col("doc") % 2 == 0, no, no), 6).alias("score"))


SQL_FUSED = """
l AS (SELECT query, doc, round(score, 6) AS score, 'scoped' AS source, 1.08 AS w, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS r FROM ti
 UNION ALL SELECT query, doc, round(score, 6), 'keyword', 1.35, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) FROM ov),
t AS (SELECT * FROM l WHERE r <= 20),
g AS (SELECT query, doc, sum(w / (60 + r)) AS p, max(CASE WHEN source = 'scoped' THEN score END) AS s, max(CASE WHEN source <> 'scoped' THEN score END) AS o, max(CASE WHEN source = 'keyword' THEN 1 ELSE 0 END) AS k FROM t GROUP BY query, doc),
x AS (SELECT query, doc, round(coalesce(s, o) + 0.08 * p / max(p) OVER (PARTITION BY query) + 0.16 * k, 6) AS final FROM g)"""


@query("R11_rrf_fusion", f"WITH {SQL_POSTS}, {SQL_TFIDF}, {SQL_OVERLAP}, {SQL_FUSED} SELECT query, doc, final, CAST(n AS INT) AS rank FROM (SELECT query, doc, final, row_number() OVER (PARTITION BY query ORDER BY final DESC, doc) AS n FROM x) WHERE n <= 10")
def rrf_fusion(spark, sf_dir):
    pairs = staged(_pairs(spark, sf_dir, "tfidf", "overlap"), "pairs")
    lists = [("scoped", "tfidf"), ("keyword", "overlap")]
    parts = [_top(pairs, c, 20).select("query", F.lit(i).alias("list_id"), F.lit(name).alias("source"), "doc", "score") for i, (name, c) in enumerate(lists)]
    return R.fuse(parts[0].unionByName(parts[1])).where("rank <= 10").select("query", "doc", "final", "rank")


@query("R10_weak_scope", f"WITH {SQL_POSTS}, {SQL_OVERLAP} SELECT query, (count(*) < 40 OR count(CASE WHEN s >= 0.25 THEN 1 END) < 3 OR max(s) < 0.45) AS weak FROM (SELECT query, round(score, 6) AS s, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS n FROM ov) WHERE n <= 40 GROUP BY query")
def weak_scope(spark, sf_dir):
    return R.weak_scope(_top(_pairs(spark, sf_dir, "overlap"), "overlap", 40), 40)


@query("R13_final_score", "SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_partkey % 50 = 0 THEN 1.0 ELSE round(greatest(0.0, least(1.0, 0.82 * (l_quantity / 50) * (1 - l_discount) + 0.08 * l_tax * 10 + 0.03 * (l_suppkey % 2) + 0.07 * (l_suppkey % 3 // 2))), 6) END AS score FROM lineitem")
def final_score(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    score = R.final_score(F.col("l_quantity") / 50, 1 - F.col("l_discount"), F.col("l_tax") * 10, F.col("l_suppkey") % 2, F.floor(F.col("l_suppkey") % 3 / 2), F.col("l_partkey") % 50 == 0)
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.round(score, 6).alias("score"))


@query("R14_embedding_blend", """SELECT id, round(CASE WHEN local >= 0.25 THEN greatest(0.25, 0.65 * local + 0.35 * sem) WHEN sem >= 0.62 THEN 0.65 * local + 0.35 * sem ELSE local END, 6) AS score FROM
(SELECT a.vec_id AS id, a.label / 10.0 AS local, greatest(-1.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS sem FROM embeddings a JOIN embeddings b ON b.vec_id = 0)""")
def embedding_blend(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings")
    b = a.where("vec_id = 0").select(F.col("embedding").alias("other"))
    sem = X.cosine(F.col("embedding"), F.col("other"))
    return a.crossJoin(F.broadcast(b)).select(F.col("vec_id").alias("id"), F.round(R.embedding_blend(F.col("label") / 10.0, sem), 6).alias("score"))


@query("T46_cosine_topk", """SELECT query, doc, score, CAST(n AS INT) AS rank FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS n FROM
(SELECT q.vec_id AS query, d.vec_id AS doc, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)) WHERE n <= 5""")
def cosine_topk(spark, sf_dir):
    """Every vector whose id is divisible by 100 asks all others."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return I.nearest_vectors(vectors, 5, asking=F.col("id") % 100 == 0)


@query("E01_rank_without_vectors", "SELECT o_orderkey AS id, round(coalesce(0.65 * (o_totalprice / 600000) + 0.35 * CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.5 END, o_totalprice / 600000), 11) AS score FROM orders WHERE o_totalprice >= 150000")
def rank_without_vectors(spark, sf_dir):
    local = F.col("o_totalprice") / 600000
    similarity = F.when(F.col("o_orderkey") % 4 != 0, F.lit(0.5))
    return table(spark, sf_dir, "orders").where("o_totalprice >= 150000").select(F.col("o_orderkey").alias("id"), F.round(R.embedding_blend(local, similarity), 11).alias("score"))


#: Lines of an order in one order, as their numbers repeat.
LINES = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS idx FROM lineitem)"


def _lines(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(w))


VERDICTS = "CASE l_returnflag WHEN 'A' THEN 'related' WHEN 'N' THEN 'uncertain' ELSE 'unrelated' END"


@query("R17_verdicts", f"SELECT query, idx, CAST(n AS INT) AS rank FROM (SELECT l_orderkey AS query, idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY idx) AS n FROM {LINES} WHERE {VERDICTS} <> 'unrelated' AND (l_discount < 0.05 OR {VERDICTS} IN ('related', 'partial'))) WHERE n <= 3")
def verdicts(spark, sf_dir):
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("query"), "idx", (F.col("l_discount") >= 0.05).alias("must_verify"), F.expr(VERDICTS).alias("relation"))
    return R.apply_verdicts(rows.drop("relation"), rows.select("query", "idx", "relation"), 3).select("query", "idx", "rank")


@query("R15_candidate_rows", f"""WITH r AS (SELECT l_orderkey AS query, l_suppkey AS code, l_returnflag AS key, l_quantity / 50 AS score, l_partkey % 41 = 0 AS explicit, l_linestatus = 'F' AS operation, l_tax >= 0.08 AS blocked, idx AS o FROM {LINES}),
p AS (SELECT *, CASE WHEN explicit AND row_number() OVER (PARTITION BY query, code, explicit ORDER BY o) = 1 THEN 0 WHEN operation THEN 1 ELSE 2 END AS level FROM r WHERE NOT blocked AND (explicit OR score >= 0.25)),
d AS (SELECT *, row_number() OVER (PARTITION BY query, code, key ORDER BY level, o) AS u FROM p)
SELECT query, o AS line, CAST(n AS INT) AS rank FROM (SELECT query, o, row_number() OVER (PARTITION BY query ORDER BY level, o) AS n FROM d WHERE u = 1) WHERE n <= 3""")
def candidate_rows(spark, sf_dir):
    r = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("code"), F.col("l_returnflag").alias("key"), (F.col("l_quantity") / 50).alias("score"),
        (F.col("l_partkey") % 41 == 0).alias("explicit"), (F.col("l_linestatus") == "F").alias("operation"), (F.col("l_tax") >= 0.08).alias("blocked"), F.col("idx").alias("order"),
    )
    return R.candidate_rows(r).select("query", F.col("order").alias("line"), "rank")


@query("R18_evidence_first", f"""WITH e AS (SELECT l_orderkey AS query, l_suppkey AS code, l_linestatus AS clause, idx AS rank, CASE WHEN l_partkey % 30 = 0 THEN 0 ELSE 1 END AS p FROM {LINES}),
d AS (SELECT *, row_number() OVER (PARTITION BY query, code, clause ORDER BY p, rank) AS u FROM e)
SELECT query, code, clause, CAST(n AS INT) AS rank FROM (SELECT query, code, clause, row_number() OVER (PARTITION BY query ORDER BY p, rank) AS n FROM d WHERE u = 1) WHERE n <= 3""")
def evidence_first(spark, sf_dir):
    r = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("code"), F.col("l_linestatus").alias("clause"), F.col("idx").alias("rank"), (F.col("l_partkey") % 30 == 0).alias("exact"))
    return R.with_evidence_first(r.where("exact").drop("exact"), r.where("not exact").drop("exact"))


@query("R24_embedding_groups", """WITH v AS (SELECT text, min(doc_id) % (SELECT count(*) FROM embeddings) AS vec FROM documents GROUP BY text), g AS (SELECT d.source AS query, d.doc_id AS doc, e.embedding FROM documents d JOIN v ON v.text = d.text JOIN embeddings e ON e.vec_id = v.vec),
b AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT query, count(*) AS docs, round(max(greatest(-1.0, least(1.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))))), 5) AS best FROM g, b GROUP BY query""")
def embedding_groups(spark, sf_dir):
    """Scores of the texts of each group: a text is embedded once, however many groups hold it, and its vector joined back by its digest."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("source").alias("query"), F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("digest"))
    e = table(spark, sf_dir, "embeddings")
    vectors = docs.groupBy("digest").agg((F.min("doc") % max(e.count(), 1)).alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id").select("digest", "embedding")
    scored = I.group_scores(docs, vectors, e.where("vec_id = 0").select("embedding"))
    return scored.groupBy("query").agg(F.count(F.lit(1)).alias("docs"), F.round(F.max("score"), 5).alias("best"))


def _terms(docs: DataFrame) -> DataFrame:
    return docs.repartition("doc_id").select(F.col("doc_id").alias("doc"), I.latin_tokens(F.coalesce("text", F.lit(""))).alias("terms"))


@query("J16_impact_index", f"WITH {SQL_POSTS}, {SQL_BM25} {_top_sql('bm', 3)}")
def impact_index(spark, sf_dir):
    """The rows of R03 from an index that is kept as tables; most postings of a query lie in blocks that bounds leave out."""
    index = ImpactIndex.build(_terms(table(spark, sf_dir, "documents")))
    asked = I.postings(table(spark, sf_dir, "benchmark"), "item_id", I.latin_tokens(F.col("text")), "query")
    return index.top(asked, 3)


#: What is in the corpus after three deltas: every seventh document has gone, every fifth of the others has the text of its benchmark twin.
SQL_UPKEEP = SQL_POSTS.replace("FROM documents)", "FROM docs)").replace("count(*) FROM documents)", "count(*) FROM docs)").replace("\ndp AS", """
docs AS (SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN coalesce(b.text, '') ELSE d.text END AS text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 97 WHERE doc_id % 7 <> 2),
dp AS""")


def kept_up_index(spark, sf_dir) -> ImpactIndex:
    """An index of two thirds of the documents, the others added, then every seventh removed, then texts of others replaced."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = ImpactIndex.build(_terms(docs.where("doc_id % 3 <> 1")))
    index.apply(_terms(docs.where("doc_id % 3 = 1")))
    index.apply(docs.where("doc_id % 7 = 2").select(F.col("doc_id").alias("doc"), F.lit(None).cast("array<string>").alias("terms")))
    changed = docs.where("doc_id % 7 <> 2 AND doc_id % 5 = 3").select("doc_id", (F.col("doc_id") % 97).alias("item_id")).join(bench, "item_id", "left")
    index.apply(_terms(changed))
    return index


@query("S14_index_after_deltas", f"WITH {SQL_UPKEEP}, {SQL_BM25} {_top_sql('bm', 3)}")
def index_after_deltas(spark, sf_dir):
    """The best rows by an index that deltas kept up: those that an index of the corpus as it is now would give."""
    asked = I.postings(table(spark, sf_dir, "benchmark"), "item_id", I.latin_tokens(F.col("text")), "query")
    return kept_up_index(spark, sf_dir).top(asked, 3)


@query("S14_frequencies_after_deltas", f"WITH {SQL_UPKEEP} SELECT term, df, st.n AS n_docs, round(avg_len, 6) AS avg_len FROM df, st WHERE df > 1")
def frequencies_after_deltas(spark, sf_dir):
    """Document frequencies and lengths after three deltas, from signed changes of them."""
    index = kept_up_index(spark, sf_dir)
    n, average = index.stats()
    return index.frequencies().where("df > 1").select("term", "df", F.lit(n).cast("long").alias("n_docs"), F.round(F.lit(average), 6).alias("avg_len"))
