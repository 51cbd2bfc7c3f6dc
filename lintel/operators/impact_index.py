"""A BM25 index that is kept: postings in blocks by impact, upper bounds that skip them, and upkeep from changed documents alone.

An index is a folder of Parquet tables, each in segments; a segment is what one build or one delta wrote.

* `forward`: a document's length and terms, or null terms if it went; the newest segment of a document counts
* `blocks`: of each term the postings (doc, tf, len) of one impact level, in chunks that stay bounded for frequent terms
* `levels`: how many postings a term has at a level, and the best impact among them
* `terms`: document frequencies, as signed changes
* `stats`: signed changes of the numbers of documents and terms, and the average length that impacts were taken at; written last, so that
  a segment without it does not exist, and is written anew when the delta runs again

Impact is the part of BM25 that a query has no say in, tf / (tf + K1 (1 - B + B len / avg)), and levels are quarters of its powers of two.
If the average length has grown since by a factor, impacts have grown by no more than that, so kept bounds hold after any deltas; postings
of an older version of a document only loosen them.

A query is answered in three steps. The levels of highest bounds give documents whose exact scores set a threshold: the k-th best of
them. Then levels are left out, those with most postings for their bound first, as long as all that a document could gain by them
stays below SHARE of the threshold; the other blocks are read, and documents whose sum with what was left out reaches the threshold stay.
These get exact scores from `forward`. Parts (hashes of term or document) are folders, so whatever is asked reads only the parts it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.operators.index import ASKED_ROWS, K1, B
from lintel.session import deals, scratch, staged

PARTS = 64
#: Postings of a term and level in one block, about.
CHUNK = 4096
LEVELS_PER_HALVING, DEEPEST = 4, 47
#: Documents that one task counts the terms of, and postings that one task puts into blocks, about, whatever the size of a segment.
DEALT, DEALT_POSTINGS = 5_000, 1_000_000
#: The share of the threshold that left out levels may make up: more skips more postings and keeps more documents to be scored.
SHARE = 0.75
#: Postings that are read and documents that are scored, per wanted row, to set the threshold.
PROBE_POSTINGS, PROBES = 500, 8
#: Scores are compared at six decimals, so what comes this near to the threshold is kept.
SLACK = 1e-6

SCHEMAS = {
    "forward": "doc long, len long, terms array<struct<term: string, tf: int>>, segment int, part int",
    "blocks": "term string, level int, chunk int, n int, best double, entries array<struct<doc: long, tf: int, len: long>>, segment int, part int",
    "levels": "term string, level int, n long, best double, segment int, part int",
    "terms": "term string, df long, segment int, part int",
    "stats": "docs long, terms long, average double, segment int",
}


def _part(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


def impact(average: float | Column) -> Column:
    average = F.greatest(average if isinstance(average, Column) else F.lit(float(average)), F.lit(1e-9))
    return F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / average))


def counted_terms(docs: DataFrame, tasks: int) -> DataFrame:
    """doc, len, terms (array of term and tf) of docs (doc, terms); null terms stay null. Documents are dealt once, so nothing else moves."""
    dealt = docs.repartition(tasks, "doc")
    words = dealt.where("terms IS NOT NULL").select("doc", F.size("terms").cast("long").alias("len"), F.explode_outer("terms").alias("term"))
    counts = words.groupBy("doc", "len", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    held = counts.groupBy("doc", "len").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("terms"))
    gone = dealt.where("terms IS NULL").select("doc", F.lit(-1).cast("long").alias("len"), F.lit(None).cast(held.schema["terms"].dataType).alias("terms"))
    return held.unionByName(gone)


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has no more than ASKED_ROWS rows."""
    return F.broadcast(df) if df.count() <= ASKED_ROWS else df


class ImpactIndex:
    """The index in a folder. Documents: doc (long, unique), terms (array of strings; null removes a document in a delta)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: tuple[int, int, float] | None = None

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None) -> ImpactIndex:
        index = cls(docs.sparkSession, path or scratch(docs.sparkSession, "index"))
        index._segment(0, docs.where("terms IS NOT NULL"), None, deals(docs.select("doc"), DEALT))
        return index

    def apply(self, changes: DataFrame) -> None:
        """A delta: new and changed documents with their terms, removed ones with null. Only their old rows and terms are read."""
        self._segment(self.segments() + 1, changes, self.documents(changes.select("doc")), deals(changes.select("doc"), DEALT))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}").where(F.col("segment") <= self.segments())

    def _state(self) -> tuple[int, int, float]:
        """The last whole segment, the number of documents and their average length, as of the last delta that this object made or met."""
        if self._known is None:
            rows = self.spark.read.schema(SCHEMAS["stats"]).parquet(f"{self.path}/stats").collect()  # a row a segment
            docs = sum(r["docs"] for r in rows)
            self._known = max(r["segment"] for r in rows), docs, sum(r["terms"] for r in rows) / max(docs, 1)
            self._averages = {r["segment"]: r["average"] for r in rows}
        return self._known

    def segments(self) -> int:
        return self._state()[0]

    def stats(self) -> tuple[int, float]:
        """Number of documents and average length."""
        return self._state()[1:]

    def frequencies(self) -> DataFrame:
        """term, df."""
        return self.table("terms").groupBy("part", "term").agg(F.sum("df").alias("df")).where("df > 0").select("term", "df")

    def documents(self, wanted: DataFrame | None = None) -> DataFrame:
        """doc, len, terms of the newest version of documents, or of those wanted (doc)."""
        rows = self.table("forward")
        if wanted is not None:
            rows = rows.join(_few(wanted.select("doc", _part("doc").alias("part")).distinct()), ["part", "doc"], "left_semi")
        if self.segments():  # else every document has one version
            rows = rows.join(rows.groupBy("part", "doc").agg(F.max("segment").alias("segment")), ["part", "doc", "segment"])
        return rows.select("doc", "len", "terms").where("terms IS NOT NULL")

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        # a part in one task and file, unless it is large: adaptive execution splits those
        df.hint("rebalance", "part").write.option("compression", "zstd").mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}/segment={number}")

    def _segment(self, number: int, docs: DataFrame, old: DataFrame | None, tasks: int) -> None:
        self._write(counted_terms(docs, tasks).withColumn("part", _part("doc")), "forward", number)
        new = self.spark.read.schema(SCHEMAS["forward"]).parquet(f"{self.path}/forward/segment={number}").where("terms IS NOT NULL").select("doc", "len", "terms")
        old = staged(old, "old") if old is not None else None  # before anything of this segment counts
        signed = new.select(F.lit(1).alias("sign"), "len", "terms")
        if old is not None:
            signed = signed.unionByName(old.select(F.lit(-1).alias("sign"), "len", "terms"))
        sums = signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("sign") * F.col("len")), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.when(F.col("sign") > 0, F.size("terms"))), F.lit(0)).alias("postings")).first()
        n, total = (self.stats() if number else (0, 0.0))
        docs_now = n + sums["docs"]
        average = (total * n + sums["terms"]) / max(docs_now, 1)

        frequencies = signed.select("sign", F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.sum("sign").alias("df")).where("df <> 0")
        self._write(frequencies.withColumn("part", _part("term")), "terms", number)
        held = self.spark.read.schema(SCHEMAS["terms"]).parquet(f"{self.path}/terms/segment={number}")
        # terms with more postings than a chunk are dealt into several; others are one
        many = held.where(F.col("df") > CHUNK).select("term", F.ceil(F.col("df") / CHUNK).cast("int").alias("chunks"))
        posts = new.select("doc", "len", F.explode("terms").alias("t")).select("doc", "len", "t.term", "t.tf").join(_few(many), "term", "left")
        posts = posts.withColumn("x", impact(average)).withColumn("level", F.least(F.lit(DEEPEST), F.floor(-LEVELS_PER_HALVING * F.log2("x"))).cast("int"))
        posts = posts.withColumn("chunk", F.pmod(F.xxhash64("doc"), F.coalesce("chunks", F.lit(1))).cast("int"))
        # dealt before they are grouped: a few files of terms are many postings, and a task would group all that it reads
        dealt = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-sums["postings"] // DEALT_POSTINGS))
        blocks = posts.repartition(dealt, "term", "level", "chunk").groupBy("term", "level", "chunk").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("x").alias("best"), F.array_sort(F.collect_list(F.struct("doc", "tf", "len"))).alias("entries"))
        self._write(blocks.withColumn("part", _part("term")), "blocks", number)
        written = self.spark.read.schema(SCHEMAS["blocks"]).parquet(f"{self.path}/blocks/segment={number}")
        levels = written.groupBy("part", "term", "level").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
        self._write(levels, "levels", number)
        stats = self.spark.createDataFrame([(sums["docs"], sums["terms"], float(average))], "docs long, terms long, average double")
        stats.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/segment={number}")
        self._known = None

    def _grown(self, average: float) -> Column:
        """By how much at most impacts of a row's segment have grown since it was written."""
        self._state()
        pairs = [x for segment, then in self._averages.items() for x in (F.lit(segment), F.lit(max(1.0, average / max(then, 1e-9))))]
        return F.element_at(F.create_map(*pairs), F.col("segment"))

    def weighted(self, asked: DataFrame) -> DataFrame:
        """query, part, term, w of asked (query, term, tf): what an impact of 1 is worth; terms that the index lacks are left out."""
        n, _ = self.stats()
        terms = _few(asked.select("term", _part("term").alias("part")).distinct())
        df = self.table("terms").join(terms, ["part", "term"], "left_semi").groupBy("part", "term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return asked.join(df, "term").select("query", "part", "term", ((1 + F.log("tf")) * idf * (K1 + 1)).alias("w"))

    def exact(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """query, doc, score of pairs (query, doc), from the documents themselves. asked: query, term, w."""
        _, average = self.stats()
        # few bytes that become many rows: dealt to a fixed number of tasks, which adaptive execution leaves as they are
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = pairs.repartition(tasks, "doc").join(self.documents(pairs), "doc").select("query", "doc", "len", F.explode("terms").alias("t")).select("query", "doc", "len", "t.term", "t.tf")
        return rows.join(_few(asked.select("query", "term", "w")), ["query", "term"]).groupBy("query", "doc").agg(F.sum(F.col("w") * impact(average)).alias("score"))

    def _read(self, levels: DataFrame) -> DataFrame:
        """query, doc, gain, left: the postings of levels (query, part, term, level, w, left), left being what their term was left out for."""
        _, average = self.stats()
        met = self.table("blocks").join(_few(levels), ["part", "term", "level"])
        rows = met.select("query", "w", "left", F.inline("entries"))
        return rows.select("query", "doc", (F.col("w") * impact(average)).alias("gain"), "left")

    def plan(self, asked: DataFrame, k: int) -> DataFrame:
        """query, part, term, level, w, n, bound, left, out, theta, rest of every level that a query (weighted) meets.

        out: no posting of the level is read; left: what a document can gain by the levels of the term that are out; rest: the sum of that."""
        _, average = self.stats()
        terms = _few(asked.select("part", "term").distinct())
        bounds = self.table("levels").withColumn("best", F.col("best") * self._grown(average)).join(terms, ["part", "term"], "left_semi").groupBy("part", "term", "level").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
        rows = asked.join(bounds, ["part", "term"]).withColumn("bound", F.col("w") * F.col("best"))
        # a level's bound holds for all deeper ones too, even if impacts of segments have grown unequally
        deeper = Window.partitionBy("query", "term").orderBy(F.desc("level"))
        rows = staged(rows.withColumn("bound", F.max("bound").over(deeper)), "levels")

        # the levels of highest bounds, down to so many postings a query, and one level at least
        highest = Window.partitionBy("query").orderBy(F.desc("bound"), "term", "level")
        first = rows.withColumn("so_far", F.sum("n").over(highest.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).where(F.col("so_far") < PROBE_POSTINGS * k)
        probes = self._read(first.select("query", "part", "term", "level", "w", F.lit(0.0).alias("left"))).groupBy("query", "doc").agg(F.sum("gain").alias("gain"))
        probes = probes.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "doc"))).where(F.col("r") <= PROBES * k)
        best = self.exact(staged(probes.select("query", "doc"), "probes"), asked).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("r") == k)
        rows = rows.join(best.select("query", (F.col("score") - SLACK).alias("theta")), "query", "left").na.fill(0.0, ["theta"])

        before = F.coalesce(F.lag("bound").over(deeper), F.lit(0.0))
        rows = rows.withColumn("price", F.col("bound") - before)
        rows = rows.withColumn("worth", F.sum("n").over(deeper) / F.greatest("bound", F.lit(1e-12)))
        # levels of a term go from the deepest on, each for the best that it or one above it opens the way to
        rows = rows.withColumn("worth", F.max("worth").over(deeper.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        order = Window.partitionBy("query").orderBy(F.desc("worth"), "term", F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("out", F.sum("price").over(order) < SHARE * F.col("theta"))
        rows = rows.withColumn("left", F.coalesce(F.max(F.when(F.col("out"), F.col("bound"))).over(Window.partitionBy("query", "term")), F.lit(0.0)))
        rest = F.coalesce(F.sum(F.when(F.col("out"), F.col("price"))).over(Window.partitionBy("query")), F.lit(0.0))
        return staged(rows.withColumn("rest", rest).drop("best", "price", "worth"), "plan")

    def top(self, asked: DataFrame, k: int) -> DataFrame:
        """query, doc, score, rank: the k best documents of each query by BM25, ties at six decimals by document. asked: query, term, tf."""
        asked = staged(self.weighted(asked), "weighted")
        plan = self.plan(asked, k)
        read = self._read(plan.where("NOT out").select("query", "part", "term", "level", "w", "left"))
        sums = read.groupBy("query", "doc").agg(F.sum(F.greatest(F.lit(0.0), F.col("gain") - F.col("left"))).alias("over"))
        limits = plan.groupBy("query").agg(F.first("theta").alias("theta"), F.first("rest").alias("rest"))
        near = sums.join(_few(limits), "query").where(F.col("over") + F.col("rest") >= F.col("theta")).select("query", "doc")
        scores = self.exact(staged(near, "near"), asked).withColumn("score", F.round("score", 6))
        return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
